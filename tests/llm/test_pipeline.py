"""The corpus pipeline as a whole: each stage's rows against a plain form of its rule over what the stage before it kept."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from noteloom.llm import queries, toxicity
from noteloom.llm.common import cut, table
from tests.conftest import SF


@pytest.fixture(scope="module")
def stages(spark):
    """The rows of documents and of each stage, every one made from the rows before it."""
    docs, out = table(spark, SF, "documents"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), f"test-{name}")
        out.append(docs.collect())
    return out


def words(text):
    return (text or "").encode().split()


def test_toxicity_rejects_what_its_score_calls_toxic(spark, stages):
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"), ~queries.held_out())
    clean = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] < queries.TOXIC}
    assert {r["doc_id"] for r in stages[1]} == clean and 0 < len(clean) < len(stages[0])
    before = {r["doc_id"]: r for r in stages[0]}
    assert all(r == before[r["doc_id"]] for r in stages[1])


def test_line_dedup_removes_later_matches_only(stages):
    earlier, wanted = [], {}
    for r in sorted(stages[1], key=lambda r: r["doc_id"]):
        kept = []
        for line in (r["text"] or "").split("\n"):
            mine = frozenset(words(line))
            if not mine or not any(len(mine & x) >= 0.8 * len(mine | x) - 1e-9 for x in earlier):
                kept.append(line)
            if mine:
                earlier.append(mine)
        wanted[r["doc_id"]] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] or "" for r in stages[2]} == wanted
    assert all(r["n_chars"] == len(r["text"] or "") for r in stages[2] if r["text"] != next(x["text"] for x in stages[1] if x["doc_id"] == r["doc_id"]))


def shingles(text):
    held = [w.lower() for w in words(text)]
    return {b" ".join(held[k : k + 5]) for k in range(max(1, len(held) - 4))} if held else set()


def test_near_dedup_keeps_the_first_of_each_group(stages):
    sets = {r["doc_id"]: shingles(r["text"]) for r in stages[2]}
    ids = sorted(sets)
    group = {i: i for i in ids}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if (not x and not y) or (x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9):
                one, two = sorted((top(a), top(b)))
                group[two] = one
    wanted = {i for i in ids if top(i) == i}
    kept = {r["doc_id"] for r in stages[3]}
    assert wanted <= kept  # no link below the limit
    assert len(kept - wanted) <= 0.1 * max(1, len(ids) - len(wanted))  # the candidates' recall
    texts = {r["doc_id"]: r for r in stages[2]}
    assert all(r == texts[r["doc_id"]] for r in stages[3])


def test_mixing_repeats_by_the_rate_of_the_source(stages):
    size = lambda r: len(words(r["text"]))
    order = sorted({r["source"] for r in stages[3]}, key=lambda s: (s is None, s))
    own = {s: sum(size(r) for r in stages[3] if r["source"] == s) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, rest, left = {}, 1.5 * sum(own.values()), set(order)
    while left:
        whole = sum(weight[s] for s in left)
        full = {s for s in left if rest * weight[s] / whole > 2 * own[s]}
        for s in full or left:
            target[s] = 2 * own[s] if full else rest * weight[s] / whole
        rest -= sum(target[s] for s in full)
        left = left - full if full else set()
    copies = Counter(r["doc_id"] for r in stages[4])
    for r in stages[3]:
        rate = target[r["source"]] / own[r["source"]]
        assert math.floor(rate - 1e-9) <= copies[r["doc_id"]] <= math.ceil(rate + 1e-9)
    for s in order:
        taken, most = sum(size(r) for r in stages[4] if r["source"] == s), max(size(r) for r in stages[3] if r["source"] == s)
        assert abs(taken - target[s]) <= max(0.02 * target[s], most)
    texts = {r["doc_id"]: r for r in stages[3]}
    assert all(r == texts[r["doc_id"]] for r in stages[4])


def test_packing_and_the_whole_run(spark, stages):
    rows = stages[5]
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in stages[4])
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    lengths = Counter()
    for r in rows:
        lengths[r["doc_id"]] += r["length"]
    assert len(places) <= 1.02 * sum(lengths.values()) / 1024 + 1
    found = corpus_pipeline.run(spark, SF).groupBy("doc_id", "piece", "start", "length", "ids_crc32").count().collect()
    assert Counter({tuple(r)[:5]: r["count"] for r in found}) == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert corpus_pipeline.run(spark, SF).agg(F.countDistinct("sequence_id")).first()[0] == len(places)
