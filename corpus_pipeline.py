"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows to the
shared folder and reads them back as the next one's docs. All stages but the last return the columns
of ``documents``; rows that a stage keeps but shortens get their new n_chars.

Defined results: a null text is an empty one to every stage; documents without words stay and
become one group in near-dedup, of which the first stays; very long texts pass every stage whole; rows that
repeat a doc_id are scored, mixed and packed each, and do not remove each other's lines of one place; of equal lines and
groups the smallest doc_id is the first; rows without a doc_id stay; other columns, whatever their names, are carried along by
all stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm import lines, mixing, packing, queries, simhash, toxicity
from noteloom.llm.common import cut, ship, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~queries.held_out())
    return toxicity.keep_clean(docs, model, queries.TOXIC)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go."""
    rows, _, removed = lines.strip(docs)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by five-word shingles at 0.8, the smallest doc_id stays."""
    return simhash.keep_first(docs, width=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until their sources meet their target weights."""
    return mixing.repeat_documents(docs, **queries.MIX)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, **queries.tokenizer_files(), size=1024, closing_id=2)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
