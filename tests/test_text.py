"""Column expressions against small literals, one group per parsing rule."""

import pytest
from pyspark.sql import functions as F

from noteloom.functions import text as T


def value(spark, expression, text):
    return spark.createDataFrame([(text,)], "x string").select(expression(F.col("x")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("content", "fm", "body"),
    [
        ("---\na: b\n---\nrest", "\na: b\n", "\nrest"),
        ("no frontmatter", None, "no frontmatter"),
        ("---\nonly one", None, "---\nonly one"),
        ("---\ntitle: a---b\n---\nrest", "\ntitle: a", "b\n---\nrest"),
        ("﻿---\na: b\n---\nx", None, "﻿---\na: b\n---\nx"),
    ],
)
def test_frontmatter_split(spark, content, fm, body):
    assert value(spark, T.frontmatter, content) == fm
    assert value(spark, T.body, content) == body


def test_loose_body_needs_no_start(spark):
    assert value(spark, T.loose_body, "x --- y --- z") == " z"
    assert value(spark, T.loose_body, "x --- y") == "x --- y"


@pytest.mark.parametrize(
    ("fm", "index", "queue"),
    [
        ("tags: [a, \"b\", 'c']", ["a", "b", "c"], ["a", "b", "c"]),
        ("tags: one, two", ["one, two"], ["one, two"]),
        ("tags:\n  - a\n\n  - 'b'\nother: x\n  - c", ["a", "b"], ["a", "b"]),
        ("tags:\n  - a\n# note\n  - b", ["a"], ["a", "b"]),
        ("tags:\n- a\ntags: [x]\n- b", ["a", "x", "b"], ["a", "x"]),
        ("tags:\n  - a\n  - a", ["a"], ["a", "a"]),
        ("title: x", [], []),
    ],
)
def test_tag_lists(spark, fm, index, queue):
    assert value(spark, T.index_tags, fm) == index
    assert value(spark, T.ingest_tags, fm) == queue


@pytest.mark.parametrize(
    ("fm", "expected"),
    [
        ("a: 1\nb: 'two'\na: 3", {"a": ["3"], "b": ["two"]}),
        ("tags: [a, b]", {"tags": ["[a, b]"]}),
        ('links:\n  - "[[x]]"\n  - [[y]]\nempty:\nlast: v', {"links": ["[[x]]", "[[y]]"], "last": ["v"]}),
        ('links: ["[[x]]", "[[y]]"]', {"links": ['[["[[x]]', "[[y]]"]}),
        ("key:\n  stray", {}),
    ],
)
def test_fields(spark, fm, expected):
    found = value(spark, lambda _: T.fields("x"), fm)
    if "links: [" in fm:
        assert list(found) == ["links"] and found["links"][-1] == "[[y]]"
    else:
        assert found == expected


@pytest.mark.parametrize(
    ("text", "targets"),
    [("[[a|b]] [[c#h]] [[#only]] ![[x.png]]", ["a", "c", "x.png"]), ("[[ a ]]\n[[a]]", ["a"]), ("none", []), ('"[[q]]"', ["q"])],
)
def test_link_targets(spark, text, targets):
    assert value(spark, T.link_targets, text) == targets


@pytest.mark.parametrize(("target", "name"), [("a", "a.md"), ("a.MD", "a.MD"), ("/dir/a/", "dir/a.md"), (" a ", "a.md")])
def test_note_name(spark, target, name):
    assert value(spark, T.note_name, target) == name


def test_hashtags(spark):
    text = "foo#bar ##h #a/b #тег-1 ```\n#hidden\n``` [[x#y]] #½"
    assert value(spark, T.hashtags, text) == ["bar", "h", "a", "тег-1", "½"]


@pytest.mark.parametrize(("tag", "good"), [("face", False), ("dad", False), ("ab", True), ("2024x", False), ("deadbeef1", True), ("здоровье", True)])
def test_valid_tags(spark, tag, good):
    assert value(spark, T.is_valid_tag, tag) is good


def test_tokens_and_titles(spark):
    assert value(spark, T.tokens, "Это Ёлка и café x2 я") == ["ёлка", "caf", "x2"]
    assert value(spark, T.title_keywords, "202501010001 Бег по утрам a") == ["бег", "утрам"]


@pytest.mark.parametrize(("folder", "name", "month"), [("atoms", "202513010000 x.md", "13"), ("daily notes", "2025-01-02.md", "01"), ("atoms", "2025-01-02.md", ""), ("other", "202501010000.md", "")])
def test_dates(spark, folder, name, month):
    row = spark.createDataFrame([(folder, name)], "d string, n string").select(T.date_part(F.col("d"), F.col("n"), 2).alias("m")).first()
    assert row["m"] == month


def test_description(spark):
    assert value(spark, T.description, "a: b\ndescription:  x y \ndescription: z") == "x y"
    assert value(spark, T.description, "description:\ndescription: z") is None
    assert value(spark, T.description, " description: z") is None


def test_strip_takes_all_white_space(spark):
    assert value(spark, T.strip, " \t x  \n") == "x"


def test_sql_functions(spark):
    T.register(spark)
    row = spark.sql("SELECT wikilinks('[[a|b]] [[c]]') AS w, is_valid_tag('face') AS v, tokenize_ru('и Мир') AS t, note_frontmatter('---x---y') AS f").first()
    assert (row["w"], row["v"], row["t"], row["f"]) == (["a", "c"], False, ["мир"], "x")
