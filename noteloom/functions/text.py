"""Parsing of notes as column expressions, inside Catalyst throughout.

The frontmatter of a note is read by three parsers with rules of their own: the tag index's, the
ingest queue's, and the graph's, which keeps every field. They differ on inline lists and must
stay apart. Each is one fold over the frontmatter's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

STRINGS = "array<string>"
#: Fixed list: Russian words that carry no topic.
STOP_WORDS = tuple(
    """
    и в не на я что с как а то все она так но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из
    ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя
    ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под
    будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были
    куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про них какая
    много разве три эту моя свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между
    """.split()
)
#: Fixed list: words that the token count and similarity also leave out.
MORE_STOP_WORDS = tuple(
    """
    которые который которая которое которых которым которыми это ещё очень также свои нету например свой каждый любой
    впрочем достаточно вообще однако поэтому
    """.split()
)


def _none() -> Column:
    return F.expr(f"cast(array() as {STRINGS})")


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normal_newlines(x: Column) -> Column:
    return F.regexp_replace(x, r"\r\n?", "\n")


def frontmatter(content: Column) -> Column:
    """The text between the first two ``---`` of content that starts with one, else null."""
    cut = F.split(content, "---", 3)
    return F.when(content.startswith("---") & (F.size(cut) == 3), F.get(cut, F.lit(1)))


def body(content: Column) -> Column:
    cut = F.split(content, "---", 3)
    return F.when(content.startswith("---") & (F.size(cut) == 3), F.get(cut, F.lit(2))).otherwise(content)


def loose_body(content: Column) -> Column:
    """The text after the second ``---``, wherever the first stands."""
    cut = F.split(content, "---", 3)
    return F.when(F.size(cut) == 3, F.get(cut, F.lit(2))).otherwise(content)


def _unquote(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, '^"+|"+$', ""), "^'+|'+$", "")


def _tag_items(rest: Column) -> Column:
    """The items of what follows ``tags:`` on its line: an inline list, or the whole scalar."""
    inline = rest.startswith("[") & rest.endswith("]")
    inside = F.regexp_replace(rest, r"^\[|\]$", "")
    items = F.filter(F.transform(F.split(inside, ","), lambda t: strip(_unquote(strip(t)))), lambda t: t != "")
    return F.when(rest == "", _none()).when(inline, items).otherwise(F.array(rest))


def index_tags(fm: Column) -> Column:
    """Tags of a frontmatter by the index's rules (P2): distinct, in order of appearance.

    A ``tags:`` line with a value adds its items and leaves an open block list open; an empty one opens a block
    list, which any line that is neither an item nor blank ends.
    """
    start = F.struct(F.lit(False).alias("open"), _none().alias("tags"))

    def step(held: Column, line: Column) -> Column:
        line = strip(line)
        rest = strip(F.substring(line, 6, 1_000_000))
        item = strip(_unquote(strip(F.regexp_replace(line, "^-", ""))))
        head, is_item = line.startswith("tags:"), line.startswith("-") & held["open"]
        tags = F.when(head, F.concat(held["tags"], _tag_items(rest))).when(is_item, F.concat(held["tags"], F.array(item))).otherwise(held["tags"])
        opened = F.when(head, F.when(rest == "", F.lit(True)).otherwise(held["open"])).when(is_item | (line == ""), held["open"]).otherwise(F.lit(False))
        return F.struct(opened.alias("open"), tags.alias("tags"))

    found = F.aggregate(F.split(fm, "\n"), start, step, lambda held: held["tags"])
    return F.coalesce(F.array_distinct(F.filter(found, lambda t: t != "")), _none())


def ingest_tags(fm: Column) -> Column:
    """Tags of a frontmatter by the queue's rules (P2b): in order, repeated ones kept.

    A ``tags:`` line with a value closes a block list, and comment lines do not end one.
    """
    start = F.struct(F.lit(False).alias("open"), _none().alias("tags"))

    def step(held: Column, line: Column) -> Column:
        line = strip(line)
        rest = strip(F.substring(line, 6, 1_000_000))
        item = strip(_unquote(strip(F.regexp_replace(line, "^-", ""))))
        head, is_item = line.startswith("tags:"), line.startswith("-") & held["open"]
        tags = F.when(head, F.concat(held["tags"], _tag_items(rest))).when(is_item, F.concat(held["tags"], F.array(item))).otherwise(held["tags"])
        opened = F.when(head, rest == "").when(is_item | (line == "") | line.startswith("#"), held["open"]).otherwise(F.lit(False))
        return F.struct(opened.alias("open"), tags.alias("tags"))

    found = F.aggregate(F.split(fm, "\n"), start, step, lambda held: held["tags"])
    return F.coalesce(F.filter(found, lambda t: t != ""), _none())


#: The fold over a frontmatter's lines: the open list's key and items, and the fields so far.
FIELDS = r"""
aggregate(transform(split({text}, '\n'), l -> regexp_replace(l, '(?U)^\\s+|\\s+$', '')),
  named_struct('open', false, 'key', '', 'held', cast(array() AS array<string>), 'out', cast(map() AS map<string, array<string>>)),
  (h, l) -> CASE
    WHEN l = '' THEN h
    WHEN h.open AND startswith(l, '-') THEN named_struct('open', true, 'key', h.key, 'held', concat(h.held, filter({item}, x -> x <> '')), 'out', h.out)
    WHEN contains(l, ':') THEN named_struct('open', {value} = '', 'key', {key}, 'held', cast(array() AS array<string>),
      'out', CASE WHEN {value} = '' THEN {flushed} ELSE map_concat(map_filter({flushed}, (k, v) -> k <> {key}), map({key}, {whole})) END)
    ELSE named_struct('open', false, 'key', '', 'held', cast(array() AS array<string>), 'out', {flushed}) END,
  h -> {flushed})"""


def fields_sql(text: str) -> str:
    """Every field of a frontmatter's text as a map to lists (P3), in SQL; inline lists stay one string, the last of equal keys wins.

    A line with a colon sets a field; with nothing after it, it opens a block list, to which ``-`` lines add and which
    any other line ends. A list without items leaves no field. Values lose their quotes and are the wikilinks in them, or themselves (P4).
    """
    stripped = lambda x: f"regexp_replace({x}, '(?U)^\\\\s+|\\\\s+$', '')"
    bare = lambda x: stripped(f"""regexp_replace({stripped(x)}, '(?s)^(["\\'])(.*)\\\\1$', '$2')""")
    links = lambda x: f"regexp_extract_all({x}, '\\\\[\\\\[[^\\\\]]+\\\\]\\\\]', 0)"
    listed = lambda x: f"CASE WHEN size({links(bare(x))}) > 0 THEN {links(bare(x))} ELSE array({bare(x)}) END"
    value = stripped("regexp_replace(l, '(?s)^[^:]*:', '')")
    flushed = "(CASE WHEN h.open AND size(h.held) > 0 THEN map_concat(map_filter(h.out, (k, v) -> k <> h.key), map(h.key, h.held)) ELSE h.out END)"
    parts = {"{text}": text, "{item}": listed("substring(l, 2)"), "{value}": value, "{key}": stripped("substring_index(l, ':', 1)"), "{whole}": listed(value), "{flushed}": flushed}
    out = FIELDS
    for name, part in parts.items():
        out = out.replace(name, part)
    return out


def fields(name: str) -> Column:
    """``fields_sql`` of the column of that name."""
    return F.expr(fields_sql(f"`{name}`"))


def link_targets(text: Column) -> Column:
    """Distinct targets of the wikilinks in text (P5): before the first ``|`` and ``#``, stripped, not empty."""
    text = F.regexp_replace(text, r"""(?s)^(["'])(.*)\1$""", "$2")
    inner = F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), 1)
    return F.array_distinct(F.filter(F.transform(inner, lambda x: strip(F.substring_index(F.substring_index(x, "|", 1), "#", 1))), lambda x: x != ""))


def note_name(target: Column) -> Column:
    """A link target as a note's file name."""
    bare = F.regexp_replace(F.regexp_replace(strip(target), "^/+|/+$", ""), r"^\\+|\\+$", "")
    return F.when(F.lower(bare).endswith(".md"), bare).otherwise(F.concat(bare, F.lit(".md")))


def without_fences(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)```.*?```", "")


def without_links(x: Column) -> Column:
    return F.regexp_replace(x, r"(?d)\[\[.*?\]\]", "")


def hashtags(x: Column) -> Column:
    """Body hashtags (P9) outside fences and wikilinks."""
    return F.regexp_extract_all(without_links(without_fences(x)), F.lit(r"#([\p{L}\p{N}_-]+)"), 1)


def is_valid_tag(tag: Column) -> Column:
    """No leading digit, and no 3 to 8 hexadecimal digits (P10)."""
    return ~tag.rlike(r"^\p{Nd}") & ~tag.rlike(r"^[0-9a-fA-F]{3,8}$")


def tokens(x: Column, stop: tuple[str, ...] = STOP_WORDS + MORE_STOP_WORDS) -> Column:
    """Lower-cased words of Cyrillic or Latin letters and digits, two or more, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"[а-яёa-z0-9]{2,}"), 0), lambda w: ~w.isin(*stop))


def title_keywords(title: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words of a title without its time stamp, stop words and single letters."""
    words = F.split(strip(F.lower(F.regexp_replace(title, r"^\d{12}\s+", ""))), r"(?U)\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop)))


def date_part(source_dir: Column, fname: Column, group: int) -> Column:
    """Year (1), month (2) or day (3) of a note's name, by its folder's convention; empty where there is none."""
    return (
        F.when(source_dir == "atoms", F.regexp_extract(fname, r"^(\d{4})(\d{2})(\d{2})\d{4}", group))
        .when(source_dir == "daily notes", F.regexp_extract(fname, r"^(\d{4})-(\d{2})-(\d{2})", group))
        .otherwise(F.lit(""))
    )


def description(fm: Column) -> Column:
    """The value of the first line that starts with ``description:``; blank is null."""
    return F.nullif(strip(F.regexp_extract(fm, r"(?m)^description:([^\n]*)", 1)), F.lit(""))


def first_n(names: Column, n: int, dash: str = "—") -> Column:
    """The first n, comma-joined, or a dash."""
    return F.when(F.size(names) == 0, F.lit(dash)).otherwise(F.array_join(F.slice(names, 1, n), ", "))


def register(spark: SparkSession) -> None:
    """The expressions most of use in SQL, as functions that Catalyst inlines."""
    for name, argument, returns, expression in (
        ("wikilinks", "t STRING", "ARRAY<STRING>", r"array_distinct(filter(transform(regexp_extract_all(t, '\\[\\[([^\\]]+)\\]\\]', 1), x -> regexp_replace(split(split(x, '[|]', 2)[0], '#', 2)[0], '(?U)^\\s+|\\s+$', '')), x -> x <> ''))"),
        ("frontmatter_map", "t STRING", "MAP<STRING, ARRAY<STRING>>", fields_sql('t')),
        ("is_valid_tag", "t STRING", "BOOLEAN", r"NOT (t RLIKE '^\\p{Nd}') AND NOT (t RLIKE '^[0-9a-fA-F]{3,8}$')"),
        ("tokenize_ru", "t STRING", "ARRAY<STRING>", "filter(regexp_extract_all(lower(t), '[а-яёa-z0-9]{2,}', 0), w -> NOT array_contains(array(" + ", ".join(f"'{w}'" for w in STOP_WORDS + MORE_STOP_WORDS) + "), w))"),
        ("note_frontmatter", "t STRING", "STRING", "CASE WHEN startswith(t, '---') AND size(split(t, '---', 3)) = 3 THEN split(t, '---', 3)[1] END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument}) RETURNS {returns} RETURN {expression}")
