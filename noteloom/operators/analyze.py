"""Hubs, orphans and bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def degree() -> Column:
    return F.col("degree_in") + F.col("degree_out")


def hubs(nodes: DataFrame, n: int = 20) -> DataFrame:
    """The n notes of most links, ties by name."""
    return nodes.select("fname", degree().alias("degree"), "degree_out", "degree_in", "tags").orderBy(F.desc("degree"), "fname").limit(n)


def orphans(nodes: DataFrame) -> DataFrame:
    return nodes.filter((F.col("degree_in") == 0) & (F.col("degree_out") == 0)).select("fname").orderBy("fname")


def bridges(nodes: DataFrame, n: int | None = 20, share: float = 0.3, least: int = 3) -> DataFrame:
    """Notes linked both ways whose neighbours share few of their tags: (name, degree, tags, neighbor_tags, overlap).

    Neighbours are link targets, missing ones included, and linking notes. The overlap must hold fewer than
    ``share`` times the note's tags, repeated tags counted; untagged notes never qualify.
    """
    around = F.array_union("links_out", "links_in")
    held = nodes.select("fname", "tags", "degree_in", "degree_out", around.alias("around")).filter((F.col("degree_in") > 0) & (F.col("degree_out") > 0) & (F.size("tags") > 0) & (F.size("around") >= least))
    tagged = nodes.select(F.col("fname").alias("near"), F.explode("tags").alias("tag")).distinct()
    met = held.select("fname", F.explode("around").alias("near")).join(tagged, "near").groupBy("fname").agg(F.sort_array(F.collect_set("tag")).alias("neighbor_tags"))
    none = F.expr("cast(array() as array<string>)")
    rows = held.join(met, "fname", "left").withColumn("neighbor_tags", F.coalesce("neighbor_tags", none))
    rows = rows.withColumn("overlap", F.sort_array(F.array_intersect("tags", "neighbor_tags"))).filter(F.size("overlap") < share * F.size("tags"))
    found = rows.select(F.col("fname").alias("name"), degree().alias("degree"), "tags", "neighbor_tags", "overlap").orderBy(F.desc("degree"), "name")
    return found if n is None else found.limit(n)
