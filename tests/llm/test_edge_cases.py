"""Every operator and pipeline stage on nulls, empty and long texts, ties, repeated rows, extra columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from noteloom.llm import gif, lines, mixing, packing, quality, queries, secrets, simhash, substring, toxicity, warc

LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [
    (1, "one two three four five six seven", "en", "a", 33),
    (2, "one two three four five six seven", "en", "a", 33),
    (2, "one two three four five six seven", "en", "a", 33),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "de", "b", 4),
    (6, LONG, "en", "b", len(LONG)),
    (None, "words of a row without a key stay here", "fr", None, 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_id` string, size string, row string, `_gone` string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 0, 1), (4, 0, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "lines": lambda d, _: lines.strip(d)[0],
    "toxicity": lambda d, l: toxicity.score(d, toxicity.train(d, l, ~queries.held_out())),
    "secrets": lambda d, _: secrets.scan(d),
    "mixing": lambda d, _: mixing.mixture(d, **queries.MIX),
    "simhash": lambda d, _: simhash.near_duplicates(d),
    "substring": lambda d, _: substring.strip(d),
    "quality": lambda d, _: quality.judge(d),
    "packing": lambda d, _: packing.pack_documents(d, **queries.tokenizer_files()),
    "gif": lambda d, _: gif.media_features(gif.store_texts(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, docs, labels, name):
    rows = OPERATORS[name](docs, labels).collect()
    assert {r["doc_id"] for r in rows} >= {1, 2, 3, 4, 5, 6}
    if name != "packing":
        assert len(rows) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, none, labels, name):
    assert OPERATORS[name](none, labels.limit(0)).count() == 0


def test_defined_results(spark, docs, labels):
    held = {r["doc_id"]: r for r in lines.strip(docs)[0].collect()}
    assert held[1]["_removed"] == 0 and held[2]["text"] == "" and held[3]["text"] is None and held[6]["_removed"] == 0
    held = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert held[2]["component_id"] == 1 and {held[k]["fingerprint"] for k in (3, 4, 5)} == {0} and held[5]["component_id"] == 3 and held[None]["component_id"] is None
    held = {r["doc_id"]: r for r in substring.strip(docs).collect()}
    assert held[6]["n_removed"] == 100_000 - 5 and held[2]["n_removed"] == 0 and held[3]["kept"] == ""
    held = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert held[3]["base_failed"] and not held[3]["kept"] and held[6]["base_failed"]
    sizes = {r["doc_id"]: (r["size"], r["source"]) for r in mixing.mixture(docs, **queries.MIX).collect()}
    assert sizes[3] == (0, None) and sizes[6] == (100_000, "b")


def test_pages(spark):
    big = "<p>" + "x" * 2000 + "</p>"
    rows = [(1, "http://b.example.com/x?y", big, "e"), (2, "http://a.example.com:8080/ x", big, "e"), (3, None, None, "e"), (4, "http://b.example.com/x?y", "small", "e"), (5, "nonsense\r\nWARC-Type: evil", "small", "e"), (None, "http://x/", "gone", "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string")
    found = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert set(found) == {None, 1, 2, 3, 4, 5} and found[None]["record_type"] == "response" and found[None]["payload_bytes"] == 4
    assert found[1]["record_type"] == "revisit" and found[1]["refers_to"] == 2 and found[2]["record_type"] == "response"
    assert found[1]["payload_bytes"] == found[2]["payload_bytes"] == 2007 and found[1]["payload_digest"] == found[2]["payload_digest"]
    assert found[4]["record_type"] == found[5]["record_type"] == "response" and found[3]["payload_bytes"] == 0
    assert warc.round_trip(pages.limit(0)).count() == 0
    other = "<p>" + "y" * 3000 + "</p>"
    held = spark.createDataFrame([(5, "http://a/", big), (5, "http://a/", other), (9, "http://b/", big), (10, "http://long/", "z" * 3_000_000)], "page_id long, url string, html string")
    found = warc.round_trip(held).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found if r["page_id"] == 5) == [(5, 2007, "revisit", 9), (5, 3007, "response", None)]
    assert {(r["page_id"], r["payload_bytes"], r["record_type"]) for r in found if r["page_id"] > 5} == {(9, 2007, "response"), (10, 3_000_000, "response")}
    folder, captures = warc.write(held)
    stored = warc.read_ranges(folder, captures).collect()
    assert {r["payload"].decode() for r in stored if r["payload"] is not None} == {big, other, "z" * 3_000_000}


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, tmp_path, docs, none, labels, number):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    name, stage = corpus_pipeline.STAGES[number]
    plain = docs  # with columns whose names clash with those that stages add
    found = stage(spark, plain, str(tmp_path))
    kept = found.collect()
    if name == "packing":
        assert {r["doc_id"] for r in kept} == {r[0] for r in ROWS}
    else:
        assert found.columns == plain.columns
        texts = [r["doc_id"] for r in kept]
        assert {"toxicity": lambda: 6 in texts, "line_dedup": lambda: len(kept) == len(ROWS), "simhash_near_dedup": lambda: sorted(x for x in texts if x) == [1, 3, 6], "mixing": lambda: 6 in texts}[name]()
    assert stage(spark, plain.filter(F.lit(False)), str(tmp_path)).count() == 0
