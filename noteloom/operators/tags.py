"""Tag index: tags of frontmatter and body, lower-cased, valid and not excluded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions import text as T


def note_tags(notes: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """Distinct (tag, fname)."""
    found = F.array_union(T.index_tags(T.frontmatter(F.col("content"))), T.hashtags(T.body(F.col("content"))))
    rows = notes.select("fname", F.explode(F.filter(found, T.is_valid_tag)).alias("tag")).select(F.lower("tag").alias("tag"), "fname")
    return rows.filter(~F.col("tag").isin(*excluded)).distinct() if excluded else rows.distinct()


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n_files"))


def tag_index(tags: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(tag, description, files): files sorted; descriptions are carried over from prior(tag, description)."""
    rows = tags.groupBy("tag").agg(F.sort_array(F.collect_set("fname")).alias("files"))
    if prior is None:
        return rows.select("tag", F.lit(None).cast("string").alias("description"), "files")
    return rows.join(prior.select("tag", blank_is_null(F.col("description")).alias("description")), "tag", "left").select("tag", "description", "files")


def blank_is_null(x: Column) -> Column:
    return F.nullif(T.strip(x), F.lit(""))


def consolidated(index: DataFrame) -> DataFrame:
    """(tag, description) of the tags that have one, by file name, so that ``a-b`` comes before ``a``."""
    return index.filter(F.col("description").isNotNull()).select("tag", "description").orderBy(F.concat("tag", F.lit(".md")))


def stale(existing: DataFrame, current: DataFrame, *key: str) -> DataFrame:
    """Rows of existing whose key current no longer has."""
    return existing.join(current.select(*key).distinct(), list(key), "left_anti")


def search(tags: DataFrame, tag: str) -> DataFrame:
    return tags.filter(F.col("tag") == tag.lower()).select("fname")
