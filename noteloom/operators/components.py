"""Connected components (G5) by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.storage import cut

#: More rounds than a graph of 2^60 nodes needs; reached only if something is wrong.
MOST_ROUNDS = 60


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b) that is linked to another: root is the smallest node reachable.

    Both stars replace each link by a link to the smallest neighbour, so the number of links never grows
    and a node with very many links costs one partial aggregate, not a group in one task. Each round
    is written to the shared folder. Ties and repeated links change nothing; no edges give no rows.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    if links.isEmpty():
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    for _ in range(MOST_ROUNDS):
        links = cut(_small_star(_large_star(links)), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    tops = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(tops)


def _large_star(links: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; links run from larger to smaller."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(nodes: DataFrame, between: DataFrame) -> DataFrame:
    """(component, fname) for every node of nodes(fname): component is its smallest member."""
    found = roots(between).withColumnRenamed("node", "fname")
    return nodes.select("fname").join(found, "fname", "left").select(F.coalesce("root", "fname").alias("component"), "fname")


def size_classes(found: DataFrame) -> DataFrame:
    """One row: all components, the size of the largest of over one note, small ones (2 to 5), single ones (A10)."""
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    count = lambda test: F.count(F.when(test, 1))
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.max(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("long").alias("giant"), count(F.col("n").between(2, 5)).alias("small"), count(F.col("n") == 1).alias("isolated"))
