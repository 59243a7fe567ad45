"""Calendar index (D1): notes by the year and month in their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.functions import text as T


def dated(names: DataFrame) -> DataFrame:
    """(year, month, fname) of names(fname, source_dir) whose name starts with its folder's kind of date; months are not checked."""
    rows = names.select(T.date_part(F.col("source_dir"), F.col("fname"), 1).alias("year"), T.date_part(F.col("source_dir"), F.col("fname"), 2).alias("month"), "fname")
    return rows.filter(F.col("year") != "")


def months(found: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(year, month, description, files): files sorted; descriptions from prior(year, month, description)."""
    rows = found.groupBy("year", "month").agg(F.sort_array(F.collect_list("fname")).alias("files"))
    if prior is None:
        return rows.select("year", "month", F.lit(None).cast("string").alias("description"), "files")
    return rows.join(prior, ["year", "month"], "left").select("year", "month", F.nullif(T.strip(F.col("description")), F.lit("")).alias("description"), "files")
