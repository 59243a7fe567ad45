"""License scans: the join against every block and template, base places, and cases with known answers (the query has its SQL)."""

import random
import re

from pyspark.sql import functions as F

from noteloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def every_block(text):
    held, out = words(text), []
    for block in range(-(-len(held) // licenses.STEP)):
        mine = set(held[block * licenses.STEP : block * licenses.STEP + licenses.BLOCK])
        for label, template in licenses.template_words():
            share = len(mine & set(template)) / len(template)
            if share >= licenses.CONTAINMENT - 1e-9:
                out.append((block, label, round(share, 9)))
    return sorted(out)


def places(text):
    held = words(text)
    return sorted((i, label) for phrase, label in licenses.PHRASES for i in range(len(held)) if held[i : i + len(phrase.split())] == phrase.split())


def check(found, text):
    base = places(text)
    assert found["n_words"] == len(words(text)) and found["n_base"] == len(base)
    assert (found["first_word"], found["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
    assert found["base_labels"] == sorted({label for _, label in base})
    blocks = sorted((b["block"], b["label"], round(b["containment"], 9)) for b in found["blocks"])
    assert blocks == every_block(text)
    assert found["labels"] == sorted({label for _, label in base} | {label for _, label, _ in blocks})
    assert abs(found["score"] - (1.0 if base else max((c for _, _, c in blocks), default=0.0))) < 1e-9


def test_every_block_that_meets_a_template_is_found(spark):
    made, texts = random.Random(2), []
    common = [w for _, held in licenses.template_words() for w in held]
    for k in range(250):
        text = [f"w{made.randrange(300)}" for _ in range(made.randrange(0, 200))]
        for _ in range(made.randrange(3)):
            passage = words(made.choice(licenses.TEMPLATES)[1])
            passage = [w if made.random() > 0.17 else made.choice(common) for w in passage]
            if made.random() < 0.3:
                made.shuffle(passage)
            at = made.randrange(len(text) + 1)
            text[at:at] = passage
        if made.random() < 0.4:
            at = made.randrange(len(text) + 1)
            text[at:at] = made.choice(("MIT License", "cc-by", "CC by cc  BY", "the Apache\nLicense.", "GNU general public license", "gnu general public")).split(" ")
        texts.append((k, made.choice((" ", ", ", "\n")).join(text)))
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for k, text in texts:
        check(found[k], text)
    assert sum(len(r["blocks"]) for r in found.values()) > 100


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (3, "-- !!"), (None, "MIT License"), (5, "mit license mit license"), (5, "Été ÀB mit licensed"), (6, "x " * 200_000 + "Released under the MIT License."), (7, "admit license, CC-BY")]
    held = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spaced": F.lit(1), "n_words": F.lit(2), "blocks": F.lit(3)})
    found = licenses.scan(held).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    for k in (1, 2, 3):
        check(by[k], "")
    check(by[None], "MIT License")
    check(by[6], rows[6][1])
    check(by[7], rows[7][1])
    two = sorted((r["n_base"], r["n_words"], r["first_word"], r["last_word"]) for r in found if r["doc_id"] == 5 and r["n_base"])
    assert two == [(2, 4, 0, 2)]
    assert licenses.scan(held.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    licenses.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string")).explain(True)
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
