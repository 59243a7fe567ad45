"""Hub index (G10): notes of many links with what to show of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.config import Config
from noteloom.operators.analyze import degree


def moc_index(nodes: DataFrame, config: Config) -> DataFrame:
    """(rank, fname, degree, degree_out, degree_in, tags, cluster, cluster_size, linked, more), by degree, ties by name.

    nodes carry their cluster; a cluster's size counts all nodes.
    """
    sizes = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    rows = nodes.withColumn("degree", degree()).filter(F.col("degree") >= config.min_degree_for_moc).orderBy(F.desc("degree"), "fname").limit(config.max_moc_entries)
    more = F.greatest(F.size("links_out") - 5, F.lit(0)).cast("long")
    rows = rows.join(sizes, "cluster").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "fname")).cast("long"))
    return rows.select("rank", "fname", "degree", "degree_out", "degree_in", F.slice("tags", 1, 3).alias("tags"), "cluster", "cluster_size", F.slice("links_out", 1, 5).alias("linked"), more.alias("more"))
