"""Health checks (L1-L7); none changes anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.operators.tags import blank_is_null, stale

stale_tags = stale


def missing_descriptions(index: DataFrame) -> DataFrame:
    """One row: tags, and those without a description."""
    return index.agg(F.count(F.lit(1)).alias("tags"), F.count(F.when(blank_is_null(F.col("description")).isNull(), 1)).alias("missing"))


def broken_links(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """(src, dst) of links to no note; all are checked."""
    return edges.select("src", "dst").distinct().join(notes.select(F.col("fname").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst")


def orphan_count(orphans: DataFrame, nodes: DataFrame, daily: str = "daily notes") -> DataFrame:
    """One row: orphans that are no daily notes."""
    kept = orphans.join(nodes.filter(F.col("source_dir") != daily).select("fname"), "fname", "left_semi")
    return kept.agg(F.count(F.lit(1)).alias("orphans"))


def index_drift(index: DataFrame, consolidated: DataFrame) -> DataFrame:
    """One row: tag files, entries of the consolidated index, and whether there are no more entries than files."""
    files = index.agg(F.count(F.lit(1)).alias("files")).withColumn("k", F.lit(1))
    entries = consolidated.agg(F.count(F.lit(1)).alias("entries")).withColumn("k", F.lit(1))
    return files.join(entries, "k").select("files", "entries", (F.col("entries") <= F.col("files")).alias("consistent"))


def broken_moc(moc: DataFrame, notes: DataFrame) -> DataFrame:
    """(fname, linked): links shown in the hub index that lead to no note."""
    shown = moc.select("fname", F.explode("linked").alias("linked"))
    return shown.join(notes.select(F.col("fname").alias("linked")).distinct(), "linked", "left_anti").select("fname", "linked")


def malformed_links(notes: DataFrame) -> DataFrame:
    """(fname, item): items of a ``links:`` list that are not of the form "[[name]]" in double quotes.

    Of values on the line of ``links:`` itself, lists in brackets are not judged.
    """
    line_type = "array<string>"
    start = F.struct(F.lit(False).alias("open"), F.expr(f"cast(array() as {line_type})").alias("items"))

    def step(held, line):
        bare = T.strip(line)
        head = bare.startswith("links:")
        value = T.strip(F.regexp_replace(bare, "^links:", ""))
        is_item = held["open"] & bare.startswith("-")
        item = T.strip(F.regexp_replace(bare, "^-", ""))
        items = F.when(head & (value != "") & ~value.startswith("["), F.concat(held["items"], F.array(value))).when(is_item, F.concat(held["items"], F.array(item))).otherwise(held["items"])
        opened = F.when(head, value == "").when(is_item | (bare == ""), held["open"]).otherwise(F.lit(False))
        return F.struct(opened.alias("open"), items.alias("items"))

    fm = T.frontmatter(F.col("content"))
    items = F.aggregate(F.split(fm, "\n"), start, step, lambda held: held["items"])
    return notes.select("fname", F.explode(items).alias("item")).filter(~F.col("item").rlike(r'^"\[\[.+\]\]"$'))
