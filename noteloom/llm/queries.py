"""The registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteloom.llm import dialogs, gif, licenses, lines, mixing, packing, quality, runs, secrets, simhash, substring, toxicity, warc
from noteloom.llm.common import table
from noteloom.llm.oracle import ORACLE  # noqa: F401

#: Weights that the sources take in turn, the share of all sizes that the targets sum to, the cap per source.
MIX = {"weights": (5, 2, 1), "share": 1.5, "cap": 2.0}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixture(table(spark, sf_dir, "documents"), **MIX)
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n_lines, n_removed = lines.strip(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_removed).alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Documents are called toxic from this score on.
TOXIC = 0.3


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"), "n_owned", "n_live", "n_copied", secrets.listed(F.filter("spans", lambda s: s["verdict"] == "live")).alias("live"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, most=2)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.strip(table(spark, sf_dir, "documents"), width=20)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *quality.COUNTS, "base_failed", "kept", "distance")


def op9_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_features(gif.store_texts(table(spark, sf_dir, "documents")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"), least=1000)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with faults by a hash of conversation and turn; the rows to drop are marked ``dropped``."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    held = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), (fault == 0).alias("dropped"), F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return held.drop("copy")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports, edited = dialogs.repair(damaged(table(spark, sf_dir, "conversations")), dropped=F.col("dropped"))
    digests = dialogs.digests(edited).withColumnRenamed("conv_id", "_conv_id")
    return reports.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv_id"))).drop("_conv_id")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(table(spark, sf_dir, "documents"))
    listed = lambda name: F.array_join(name, ",").alias(name)
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", listed("base_labels"), listed("labels"), "score", F.size("blocks").cast("long").alias("n_blocks"))


def periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, of every tenth document by hash repeated with some period from some place on."""
    h, n = 1 if doc_id is None else crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.find(table(spark, sf_dir, "documents"), prepare=periodic)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    rows = rows.withColumn("best", F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def tokenizer_files() -> dict[str, str]:
    """The public byte-level BPE vocabulary, the same as ranks, and its splitting pattern."""
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), **tokenizer_files(), size=1024, closing_id=2)


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can express."""
    return op3_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can express; whether the words taken of a source come within 2 % or 1,000 words of its target."""
    rows = op4_mixing(spark, sf_dir)
    per = rows.groupBy("source").agg(F.sum("taken").alias("_all"), F.first("target").alias("_target")).withColumnRenamed("source", "_source")
    near = F.abs(F.col("_all") - F.col("_target")) <= F.greatest(0.02 * F.col("_target"), F.lit(1000.0))
    both = rows.join(per, F.col("source").eqNullSafe(F.col("_source")))
    return both.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), near.alias("near"), (F.col("taken") <= 2 * F.col("size")).alias("bounded"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can express."""
    return quality.measure(table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, "base_failed")


def packing_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8 has to keep: a piece 0 for each document, pieces and sequences without gaps, none longer than 1024."""

    def before(key: str, order: str) -> Column:
        return F.coalesce(F.sum("length").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    rows = op8_packing(spark, sf_dir)
    rows = rows.withColumn("_in_doc", before("doc_id", "piece")).withColumn("_in_sequence", before("sequence_id", "offset"))
    tests = {"documents": F.col("piece") == 0, "misplaced": F.col("start") != F.col("_in_doc"), "gaps": F.col("offset") != F.col("_in_sequence"), "overfull": F.col("offset") + F.col("length") > 1024}
    return rows.agg(*[F.sum(test.cast("long")).alias(name) for name, test in tests.items()])


def gif_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can express."""
    return op9_gif(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES = {
    f.__name__: f
    for f in (op1_lines, op2_toxicity, op3_secrets, op4_mixing, op5_simhash, op6_substring, op7_quality, op8_packing, op9_gif, op10_warc, op11_conversations, op12_licenses, op13_runs, secret_base_spans, mixing_targets, quality_counts, packing_invariants, gif_payloads)
}
