"""Incremental tag index (an extension): new and changed notes are read as a stream of files.

Each micro-batch parses its notes and appends their tags with the batch's number; ``current`` keeps of each
note the tags of its last batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from noteloom.functions import text as T
from noteloom.operators import tags
from noteloom.sources.vault import file_name

FILES = "path string, modificationTime timestamp, length long, content binary"


def start(spark: SparkSession, root: str, source_dir: str, out: str, checkpoint: str, excluded: tuple[str, ...] = ()) -> StreamingQuery:
    """Reads root/source_dir once and stops when all that is there has been taken in; a later start takes in what came since."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.md").load(f"{root}/{source_dir}")
    notes = files.select(file_name(F.col("path")).alias("fname"), T.normal_newlines(F.col("content").cast("string")).alias("content"))

    def take_in(batch: DataFrame, number: int) -> None:
        found = tags.note_tags(batch, excluded)
        # A note without tags leaves a row too, so that tags it had before end.
        rows = batch.select("fname").distinct().join(found, "fname", "left").withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("append").parquet(out)

    return notes.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """Distinct (tag, fname) by each note's last batch."""
    rows = spark.read.schema("fname string, tag string, batch long").parquet(out)
    last = rows.groupBy("fname").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["fname", "batch"]).filter("tag is not null").select("tag", "fname").distinct()
