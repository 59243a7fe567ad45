"""Link graph: edges, nodes, degrees and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(parsed: DataFrame) -> DataFrame:
    """Distinct (src, dst, path): the links of each file; dst may have no note. Files of equal names keep their own."""
    out = F.array_remove(F.array_union("links_fm", "links_body"), F.col("fname"))
    return parsed.select(F.col("fname").alias("src"), "path", F.explode(out).alias("dst"))


def winners(parsed: DataFrame) -> DataFrame:
    """One row per name: of files with equal names the one with the largest path."""
    keep = F.max_by(F.struct("path", "source_dir", "tags", F.sort_array(F.array_remove(F.array_union("links_fm", "links_body"), F.col("fname"))).alias("links_out")), "path")
    return parsed.groupBy("fname").agg(keep.alias("n")).select("fname", "n.*")


def nodes(parsed: DataFrame) -> DataFrame:
    """fname, path, source_dir, tags, links_out, links_in, degree_out, degree_in, cluster."""
    held = winners(parsed)
    incoming = held.select(F.col("fname").alias("src"), F.explode("links_out").alias("fname")).groupBy("fname").agg(F.sort_array(F.collect_set("src")).alias("links_in"))
    none = F.expr("cast(array() as array<string>)")
    rows = held.join(incoming, "fname", "left").withColumn("links_in", F.coalesce("links_in", none))
    return rows.withColumns({"degree_out": F.size("links_out").cast("long"), "degree_in": F.size("links_in").cast("long"), "cluster": F.lit(-1).cast("long")})


def edge_list(nodes: DataFrame) -> DataFrame:
    """Distinct (src, dst) of the nodes' links; dst may have no node."""
    return nodes.select(F.col("fname").alias("src"), F.explode("links_out").alias("dst"))


def stats(parsed: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of totals; edges count those of every file, equal names and missing targets included."""
    totals = nodes.agg(F.count(F.lit(1)).alias("total_nodes"), F.sum(F.when((F.col("degree_in") == 0) & (F.col("degree_out") == 0), 1).otherwise(0)).alias("orphans"))
    counted = edges(parsed).agg(F.count(F.lit(1)).alias("total_edges"))
    tagged = parsed.select(F.explode("tags").alias("tag")).agg(F.count_distinct("tag").alias("tags_indexed"))
    rows = totals.withColumn("k", F.lit(1)).join(counted.withColumn("k", F.lit(1)), "k").join(tagged.withColumn("k", F.lit(1)), "k")
    average = F.when(F.col("total_nodes") > 0, F.round(F.col("total_edges") / F.col("total_nodes"), 1)).otherwise(F.lit(0.0))
    return rows.select("total_nodes", "total_edges", F.coalesce(F.col("orphans"), F.lit(0)).cast("long").alias("orphan_nodes"), "tags_indexed", average.cast("double").alias("avg_degree"))


def links_between(nodes: DataFrame) -> DataFrame:
    """Undirected distinct (a, b) in both orientations between existing nodes."""
    out = edge_list(nodes)
    known = out.join(nodes.select(F.col("fname").alias("dst")), "dst", "left_semi")
    return known.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(known.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
