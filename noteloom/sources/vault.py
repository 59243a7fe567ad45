"""Notes from folders of Markdown files (S1, S2, S6, S8) and their parsed form.

Files are read by the ``vault`` format (``markdown``), or by Spark's binary reader where only Spark reaches the path; neither
percent-encodes names. Notes that are no valid UTF-8 are kept apart by ``broken``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.sources import markdown

NOTES = "fname string, path string, source_dir string, content string"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _files(spark: SparkSession, root: str, dirs: tuple[str, ...], content: bool = True, recursive: bool = True) -> DataFrame:
    """fname, path, source_dir, and with content the text (null where it is no UTF-8) of the .md files of the folders that exist."""
    root = root.rstrip("/")
    if markdown.known(root):
        return markdown.read(spark, root, dirs, content, recursive)
    jvm, found = spark.sparkContext._jvm, None
    for name in dirs:  # a scheme that only Spark reaches
        place = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            continue
        reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", str(recursive).lower())
        files = reader.load(f"{root}/{name}").withColumn("source_dir", F.lit(name))
        found = files if found is None else found.unionByName(files)
    if found is None:
        return spark.createDataFrame([], markdown.ROWS if content else markdown.NAMES)
    rows = found.withColumn("fname", file_name(F.col("path")))
    if not content:
        return rows.select("fname", "path", "source_dir")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return rows.select("fname", "path", "source_dir", text.alias("content"), text.isNull().alias("broken"))


def read_notes(spark: SparkSession, root: str, dirs: tuple[str, ...]) -> DataFrame:
    """NOTES of all .md files below the folders that exist."""
    rows = _files(spark, root, dirs).filter("not broken")
    return rows.select("fname", "path", "source_dir", T.normal_newlines(F.col("content")).alias("content"))


def broken(spark: SparkSession, root: str, dirs: tuple[str, ...]) -> DataFrame:
    """(fname, path) of notes that are no valid UTF-8."""
    return _files(spark, root, dirs).filter("broken").select("fname", "path")


def list_names(spark: SparkSession, root: str, dirs: tuple[str, ...]) -> DataFrame:
    """(fname, source_dir) of .md files directly in the folders (S2); no file is opened."""
    return _files(spark, root, dirs, content=False, recursive=False).select("fname", "source_dir")


def parse(notes: DataFrame) -> DataFrame:
    """notes with fm_text, body, fields, tags and the targets of frontmatter and body links."""
    fm, rows = T.frontmatter(F.col("content")), notes
    rows = rows.withColumn("fm_text", fm).withColumn("body", T.body(F.col("content"))).withColumn("fields", T.fields("fm_text"))
    none = F.expr("cast(array() as array<string>)")
    listed = lambda key: F.coalesce(F.try_element_at(F.col("fields"), F.lit(key)), none)
    return (
        rows.withColumn("tags", F.filter(F.transform(listed("tags"), T.strip), lambda t: t != ""))
        .withColumn("links_fm", F.array_distinct(F.flatten(F.transform(listed("links"), lambda x: F.transform(T.link_targets(x), T.note_name)))))
        .withColumn("links_body", F.array_distinct(F.transform(T.link_targets(F.col("body")), T.note_name)))
    )
