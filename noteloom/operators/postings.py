"""Posting lists of keys as sorted chunks with a directory, in place of one array for each key.

Rows (key, name) are range-partitioned and sorted, so a key of any number of names is spread over tasks; a name's place in its key's list follows from
its place in its partition and from how many names of the key the partitions before hold. Chunk k of a key has its names from k * chunk on, so
chunks do not depend on how the rows were dealt, and no row or group holds more than ``chunk`` names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.storage import cut

CHUNK = 1000


def build(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, chunk, n, first, last, names) of distinct rows(key, name); names are sorted."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "name").distinct().repartitionByRange(parts, "key", "name").sortWithinPartitions("key", "name")
    held = cut(dealt.select("key", "name", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "postings")
    counted = held.groupBy("key", "part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = held.join(counted.select("key", "part", "low", before.alias("before")), ["key", "part"]).select("key", "name", F.floor((F.col("before") + F.col("at") - F.col("low")) / chunk).alias("chunk"))
    lists = placed.groupBy("key", "chunk").agg(F.sort_array(F.collect_list("name")).alias("names"))
    return lists.select("key", "chunk", F.size("names").cast("long").alias("n"), F.element_at("names", 1).alias("first"), F.element_at("names", -1).alias("last"), "names")


def directory(chunks: DataFrame) -> DataFrame:
    """(key, chunks, n, first, last): one row for each key."""
    return chunks.groupBy("key").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def page(chunks: DataFrame, key: str, start: int, n: int, chunk: int = CHUNK) -> DataFrame:
    """(place, name): n names of the key's list from ``start`` on; only the chunks that hold them are opened."""
    held = chunks.filter((F.col("key") == key) & F.col("chunk").between(start // chunk, (start + n - 1) // chunk))
    rows = held.select(F.posexplode("names").alias("k", "name"), "chunk").select((F.col("chunk") * chunk + F.col("k")).alias("place"), "name")
    return rows.filter(F.col("place").between(start, start + n - 1)).orderBy("place")


def between(chunks: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """(name) of the key's list from low to high, both included; chunks outside are left by their first and last name."""
    held = chunks.filter((F.col("key") == key) & (F.col("last") >= low) & (F.col("first") <= high))
    return held.select(F.explode("names").alias("name")).filter(F.col("name").between(low, high))
