"""Mixing sources to target weights.

Tokens are aggregated per source, a repetition rate per source follows from its target, and
each document is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose
probability is the rate's fraction.

Defined results: a null text has size 0 and takes 0 words; a null source is a source of its
own that sorts last; a source whose documents have no words has target 0 and rate 0; an
empty table gives an empty result; repeated rows are judged each by its own key and source; very long
texts are counted whole; other columns of the input, whatever their names, are ignored by ``mixture`` and carried
along by ``repeat_documents``; a null doc_id is a key like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import WORD, cut, free

#: Seeds tried for each source: the one whose Bernoulli copies come nearest to the target is used.
SEEDS = 64


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size): size counts the words of the text, null counts as none."""
    return docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """One row per source: source_size, target and rate.

    The targets share ``share`` times all sizes by weight, none above ``cap`` times its source's size;
    what a capped source leaves is shared again by weight. Capped sources are those of smallest
    cap/weight, so with the sources in that order the first whose fair share stays below its cap
    fixes the water level; running sums over the rows of the sources (not of the documents) find it.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(listed) - 1) % len(weights) + 1).cast("int"))
    rows = per_source.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    rows = (
        rows.withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("left", F.col("all_size") * float(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.when(F.col("left") * F.col("weight") <= F.col("most") * F.col("open_weight"), F.col("left") / F.col("open_weight")))
    )
    rows = rows.withColumn("level", F.first("level", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    )


def draw(seed: Column | int) -> Column:
    """A number in [0, 1) that depends on the document's key and the seed alone."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), seed.cast("int")), F.lit(1 << 52)) / float(1 << 52)


def mixture(docs: DataFrame, weights: Sequence[float], share: float, cap: float, seeds: int = SEEDS, **names: str) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, rate, copies, taken.

    copies is floor(rate) plus a Bernoulli copy of probability rate - floor(rate), drawn from a hash of
    the document's key. Each source uses, of ``seeds`` seeds, the one whose total comes nearest to its
    target; the sums behind that choice are one aggregate of ``seeds`` columns per source.
    """
    sizes = cut(sized(docs, **names), "sizes")
    targets = cut(source_targets(sizes, weights, share, cap), "targets")
    fraction = F.col("rate") - F.floor("rate")
    with_rate = _join(sizes, targets)
    drawn = with_rate.groupBy("source").agg(*[F.sum(F.when(draw(k) < fraction, F.col("size")).otherwise(F.lit(0))).alias(f"s{k}") for k in range(seeds)])
    extra = F.col("target") - F.floor("rate") * F.col("source_size")
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{k}") - extra).alias("off"), F.lit(k).alias("seed")) for k in range(seeds)]))["seed"]
    chosen = cut(_join(targets, drawn).withColumn("seed", nearest).select("source", "source_size", "target", "rate", "seed"), "seeds")
    copies = (F.floor("rate") + F.when(draw(F.col("seed")) < fraction, 1).otherwise(0)).cast("int")
    return _join(sizes, chosen).withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def _join(left: DataFrame, right: DataFrame) -> DataFrame:
    """left with the row of right that has the same source, null included.

    right has a row per source; Spark broadcasts it only below its size threshold and else
    shuffles both, splitting a hot source under adaptive execution.
    """
    other = right.withColumnRenamed("source", "_source")
    return left.join(other, left["source"].eqNullSafe(other["_source"])).drop("_source")


def repeat_documents(docs: DataFrame, weights: Sequence[float], share: float, cap: float, seeds: int = SEEDS) -> DataFrame:
    """The rows of docs, each repeated as often as the mixture takes it, with the columns of docs."""
    key, source, copies, copy = (free(docs, n) for n in ("_key", "_source", "_copies", "_copy"))
    counted = mixture(docs, weights, share, cap, seeds).select(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("copies").alias(copies))
    # Rows that repeat a doc_id in one source have equal copies; a doc_id in two sources has copies in each by that source's rate.
    counted = counted.groupBy(key, source).agg(F.max(copies).alias(copies)).filter(F.col(copies) > 0)
    rows = docs.join(counted, F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").cast("string").eqNullSafe(F.col(source)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*columns)
