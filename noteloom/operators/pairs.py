"""Pairs of rows that share a key, with common keys split over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key that meet in one task; a task's pairs of a key are at most the square of this.
BLOCK = 2000


def meeting(rows: DataFrame, key: str, number: str, values: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """key, number and values of each two rows with the same key, as ``x_*`` and ``y_*``; every pair once, in no order.

    A key of more than ``block`` rows is dealt over blocks by a hash of ``number``, and every two blocks meet by themselves (a
    triangle of cells), so that no task gets all pairs of a common key. Cells are narrow and their pairs many, so the number of partitions is
    fixed: coalescing by bytes would put them back together. Keys of a single row end before the join. Rows of one key have distinct numbers.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.col("_n") / block).cast("int")
    dealt = rows.join(counts, key).withColumn("_k", blocks).withColumn("_b", F.pmod(F.xxhash64(number), F.col("_k")).cast("int"))

    def side(name: str, cells: Column, mine: str, other: str) -> DataFrame:
        named = [F.col(c).alias(f"{name}_{c}") for c in (number, *values)]
        cut = dealt.select(F.col(key).alias(f"_{key}"), F.col("_b").alias(mine), F.explode(cells).alias(other), *named)
        return cut.repartition(n, f"_{key}", "_i", "_j")

    left = side("x", F.sequence(F.col("_b"), F.col("_k") - 1), "_i", "_j")
    right = side("y", F.sequence(F.lit(0), F.col("_b")), "_j", "_i")
    met = left.join(right, [f"_{key}", "_i", "_j"]).filter(f"_i < _j OR x_{number} < y_{number}")
    return met.drop("_i", "_j").withColumnRenamed(f"_{key}", key)


def ordered(met: DataFrame, number: str, values: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of ``meeting`` with the smaller number as x."""
    first = F.col(f"x_{number}") < F.col(f"y_{number}")
    swapped = [F.when(first, F.col(f"{a}_{c}")).otherwise(F.col(f"{b}_{c}")).alias(f"{a}_{c}") for a, b in (("x", "y"), ("y", "x")) for c in (number, *values)]
    held = {f"{a}_{c}" for a in "xy" for c in (number, *values)}
    return met.select(*[c for c in met.columns if c not in held], *swapped)
