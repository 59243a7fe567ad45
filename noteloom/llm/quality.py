"""Quality rules by robust multivariate outliers.

Each text gets a vector of transformed statistics. Per language and source the location and scatter
of the vectors are estimated by minimum covariance determinants: from several starts, concentration
steps refit mean and covariance on the half of the rows that lie nearest, and after TRIED steps the start whose
covariance has the smallest determinant goes on. A step is two aggregates
over all rows, of bounded size per group whatever a group's share of the rows is: a histogram of
distances that gives the radius of the nearest half, then sums and products of the rows within it.
Rows whose Mahalanobis distance to their group exceeds the cutoff are rejected.

Groups too small for an estimate of their own take their language's, or all rows' estimate.

Defined results: a null, empty or blank text has no words and fails the base rules; null languages
and sources are groups of their own; repeated rows count each; very long texts are measured whole; a null doc_id stays
null; other columns, whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import cut, ship

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ]")
SYMBOLS = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VECTOR = ("f_word_length", "f_symbols", "f_dup_lines", "f_repeats", "f_capitals")
#: Rows that a group needs for its own estimate, for each dimension of the vector.
ROWS_PER_DIMENSION = 20
#: Share of the rows that a concentration step keeps, its rounds, and the bins of a histogram of distances.
SUPPORT, ROUNDS, BINS_PER_OCTAVE = 0.5, 10, 16
#: Steps that every start takes before the smallest determinant decides.
TRIED = 3
#: Scatter added to each direction, in the units of the transformed statistics.
FLOOR = (0.06, 0.03, 0.15, 0.15, 0.05)
#: The squared distance that a normal vector passes about once in a thousand million (chi-square, 5 degrees), and
#: the median of that law, to which the distances of each group are scaled.
CUTOFF, MEDIAN = 51.0, 4.351


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text, and the numbers of its capitals and lines with a word."""
    text = text or ""
    words = WORDS.findall(text)
    n = len(words)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if WORDS.search(line):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        twice = Counter(windows)
        if len(twice) < len(windows):
            hit = np.fromiter((twice[w] > 1 for w in windows), bool, len(windows))
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : k + len(windows)] |= hit
            repeat = int(cover.sum())
    return n, sum(map(len, words)), len(SYMBOLS.findall(text)), dup, repeat, len(CAPITALS.findall(text)), lines


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source), COUNTS, base_failed and VECTOR of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([counts(t.as_py()) for t in batch.column(3)], np.int64).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(made[:, k]) for k in range(7)]], ["doc_id", "lang", "source", *COUNTS, "n_capitals", "n_lines"])

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    rows = rows.mapInArrow(work, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_capitals", "n_lines")))
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    # Log and square-root transforms bring lengths and shares nearer to a normal law.
    return rows.select(
        "doc_id", "lang", "source", *COUNTS,
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.log((F.col("word_chars") + 1) / words).alias("f_word_length"),
        F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 1)).alias("f_symbols"),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 1)).alias("f_dup_lines"),
        F.sqrt(F.col("n_repeat_words") / words).alias("f_repeats"),
        F.sqrt(F.col("n_capitals") / (F.col("word_chars") + 1)).alias("f_capitals"),
    )



FIT = "level string, start int, " + ", ".join([*(f"x{k} double" for k in range(len(VECTOR))), *(f"w{i}_{j} double" for i in range(len(VECTOR)) for j in range(i, len(VECTOR))), "scale double", "determinant double"])


def _products() -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(len(VECTOR)), 2))


def _distance() -> Column:
    """Squared Mahalanobis distance by the fit whose columns stand beside the vector's."""
    off = [F.col(v) - F.col(f"x{k}") for k, v in enumerate(VECTOR)]
    return sum((off[i] * off[j] * F.col(f"w{i}_{j}") * (1 if i == j else 2) for i, j in _products()), F.lit(0.0))


def levels(rows: DataFrame, least: int) -> DataFrame:
    """(group, judge, feeds): for each language and source the level that judges it and those it feeds.

    A group of ``least`` rows or more that pass the base rules is a level of its own. Smaller ones are judged by
    their language's level, which all rows of the language feed, or if that is small by the level of all rows.
    """
    per_group = rows.groupBy("group", "lang").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n"))
    per_lang = per_group.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.max((F.col("n") < least).cast("int")).alias("lang_needed")).withColumn("_lang", F.col("lang")).drop("lang")
    everything = Window.partitionBy(F.lit(1))  # over the rows of the languages
    per_lang = per_lang.withColumn("all_needed", F.max(((F.col("lang_n") < least) & (F.col("lang_needed") == 1)).cast("int")).over(everything))
    lang_level = F.concat(F.lit("lang:"), F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")))
    table = per_group.join(per_lang, per_group["lang"].eqNullSafe(per_lang["_lang"]))
    judge = F.when(F.col("n") >= least, F.col("group")).when(F.col("lang_n") >= least, lang_level).otherwise(F.lit("all"))
    feeds = F.array(F.when(F.col("n") >= least, F.col("group")), F.when((F.col("lang_needed") == 1) & (F.col("lang_n") >= least), lang_level), F.when(F.col("all_needed") == 1, F.lit("all")))
    return table.select("group", judge.alias("judge"), F.array_compact(feeds).alias("feeds"))


def _refit(share: float, final: bool):
    """A function of one level's sums by bin of distance (at most a few hundred rows) to its fit."""

    def refit(key: tuple, table: pa.Table) -> pa.Table:
        d = len(VECTOR)
        held = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("level", "start")}
        order = np.argsort(held["bin"], kind="stable")
        running = np.cumsum(held["n"][order])
        if final:  # the fit stays, its distances are scaled to the law's median
            at = order[np.searchsorted(running, running[-1] / 2)]
            row = {c: held[c][0] for c in held if c[0] in "xwd"}
            row["scale"] = MEDIAN / max(MEDIAN, 2.0 ** ((held["bin"][at] + 1) / BINS_PER_OCTAVE))
        else:
            inside = order[: int(np.searchsorted(running, share * running[-1])) + 1]
            n = held["n"][inside].sum()
            mean = np.array([held[f"m{k}"][inside].sum() for k in range(d)]) / n
            scatter = np.empty((d, d))
            for i, j in _products():
                scatter[i, j] = scatter[j, i] = held[f"c{i}_{j}"][inside].sum() / n - mean[i] * mean[j]
            # What the nearest part lacks in spread, by the median of its own law, is given back by the final scale.
            spread = scatter + np.diag(np.square(FLOOR))
            inverse = np.linalg.inv(spread)
            row = {f"x{k}": mean[k] for k in range(d)} | {f"w{i}_{j}": inverse[i, j] for i, j in _products()} | {"scale": 1.0, "determinant": np.linalg.det(spread)}
        names = [x.split()[0] for x in FIT.split(", ")]
        return pa.table({"level": pa.array([key[0].as_py()], pa.string()), "start": pa.array([key[1].as_py()], pa.int32())} | {c: pa.array([float(row[c])]) for c in names[2:]})

    return refit


def fits(vectors: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT) -> DataFrame:
    """FIT of every level of vectors(level, VECTOR)."""
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"m{k}") for k, v in enumerate(VECTOR)], *[F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"c{i}_{j}") for i, j in _products()]]
    spark = vectors.sparkSession
    # Starts: distances to the coordinates' medians in units of the floor, to the medians in units of the mean distance from
    # them, and to the means in units of the deviations. Values are rounded, so that a median needs few distinct ones.
    near = lambda v: F.round(v, 3)
    middle = vectors.groupBy("level").agg(*[F.percentile(near(v), 0.5).alias(f"m{k}") for k, v in enumerate(VECTOR)], *[F.avg(v).alias(f"a{k}") for k, v in enumerate(VECTOR)], *[F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias(f"s{k}") for k, v in enumerate(VECTOR)])
    middle = cut(middle, "middles")
    around = vectors.join(middle, "level").groupBy("level").agg(*[F.avg(F.abs(F.col(v) - F.col(f"m{k}"))).alias(f"d{k}") for k, v in enumerate(VECTOR)])
    middle = cut(middle.join(around, "level"), "starts")
    d = range(len(VECTOR))
    starts = None
    for number, (place, unit) in enumerate((("m", None), ("m", "d"), ("a", "s"))):
        width = lambda i: F.lit(FLOOR[i] ** 2) if unit is None else F.col(f"{unit}{i}") ** 2 + FLOOR[i] ** 2  # noqa: B023, E731
        one = middle.select("level", F.lit(number).alias("start"), *[F.col(f"{place}{k}").alias(f"x{k}") for k in d], *[(1 / width(i) if i == j else F.lit(0.0)).alias(f"w{i}_{j}") for i, j in _products()], F.lit(1.0).alias("scale"), F.lit(0.0).alias("determinant"))
        starts = one if starts is None else starts.union(one)
    fit = starts
    ship(spark)
    for step in range(rounds + 1):
        final = step == rounds
        fit = cut(fit, "fits")
        if step == TRIED:
            best = fit.groupBy("level").agg(F.min(F.struct("determinant", "start")).alias("x")).select("level", "x.start")
            fit = fit.join(best, ["level", "start"])
        binned = vectors.join(fit, "level").withColumn("bin", F.floor(F.log2(F.greatest(_distance(), F.lit(1e-3))) * BINS_PER_OCTAVE))
        by = ["level", "start", "bin", *([c.split()[0] for c in FIT.split(", ")[2:] if not c.startswith("scale")] if final else [])]
        fit = binned.groupBy(*by).agg(*(sums[:1] if final else sums)).groupBy("level", "start").applyInArrow(_refit(support, final), FIT)
    return cut(fit, "fits")


def judge(docs: DataFrame, rows_per_dimension: int = ROWS_PER_DIMENSION, cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: doc_id, COUNTS, base_failed, distance (squared, scaled) and kept."""
    rows = cut(measure(docs).withColumn("group", F.concat(F.lit("source:"), F.to_json(F.struct("lang", "source")))), "vectors")
    known = cut(levels(rows, rows_per_dimension * len(VECTOR)), "levels")
    fed = rows.filter(~F.col("base_failed")).join(known, "group").select(F.explode("feeds").alias("level"), *VECTOR)
    fit = fits(fed)
    judged = rows.join(known.select("group", "judge"), "group").join(fit, F.col("judge") == F.col("level"), "left")
    judged = judged.withColumn("distance", _distance() * F.col("scale"))
    return judged.select("doc_id", *COUNTS, "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"))
