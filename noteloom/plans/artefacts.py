"""Artefacts that grow with the vault, as lines (path, place, key, line), and their publication.

A file's lines are in order of ``place``, then ``key``. Lists are never gathered: a tag of ten million notes is as many rows, sorted and written by a task that
holds one batch of them. Publication writes only the files whose lines differ from what is there, and deletes those that are there but not wanted,
both found by joins over digests of lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.sources import markdown
from noteloom.storage import cut

#: Fixed texts of the files: the index of tags, and the lines of a cluster in the report on the graph.
INDEX_HEAD = "# Tags index"
CLUSTER, SIZE, TOP_TAGS, MEMBERS, MORE = "### Кластер ", " (размер: ", "- Топ-теги: ", "- Заметки: ", "  ... и ещё "

LINES = "path string, place int, key string, line string"
#: The place of a file's list, after its head.
LIST = 1000


def _file(folder: str, name: Column, ending: str = ".md") -> Column:
    return F.concat(F.lit(f"{folder.rstrip('/')}/"), name, F.lit(ending))


def _head(rows: DataFrame, path: Column, lines: Column) -> DataFrame:
    return rows.select(path.alias("path"), F.posexplode(lines).alias("place", "line")).select("path", "place", F.lit("").alias("key"), "line")


def _listed(rows: DataFrame, path: Column, key: Column, line: Column) -> DataFrame:
    return rows.select(path.alias("path"), F.lit(LIST).alias("place"), key.alias("key"), line.alias("line"))


def _bullet(name: Column) -> Column:
    return F.concat(F.lit("- [["), name, F.lit("]]"))


def _frontmatter(description: Column, always: bool) -> Column:
    marked = lambda x: F.array(F.lit("---"), x, F.lit("---"), F.lit(""))
    none = marked(F.lit("description:")) if always else F.expr("cast(array() as array<string>)")
    return F.when(description.isNotNull(), marked(F.concat(F.lit("description: "), description))).otherwise(none)


def tag_lines(tags: DataFrame, described: DataFrame, folder: str) -> DataFrame:
    """LINES of one file for each tag of tags(tag, fname) (K1); described(tag, description) has every tag once. ``/`` in a tag is written as ``%2F``."""
    path = _file(folder, F.replace(F.col("tag"), F.lit("/"), F.lit("%2F")))
    head = F.concat(_frontmatter(F.col("description"), False), F.array(F.concat(F.lit("# #"), "tag"), F.lit("")))
    return _head(described, path, head).union(_listed(tags.select("tag", "fname"), path, F.col("fname"), _bullet(F.col("fname"))))


def index_lines(described: DataFrame, path: str) -> DataFrame:
    """LINES of the index of tags that have a description, by file name (K2)."""
    head = _head(described.sparkSession.range(1), F.lit(path), F.array(F.lit(INDEX_HEAD), F.lit("")))
    rows = described.filter("description is not null")
    return head.union(_listed(rows, F.lit(path), F.concat("tag", F.lit(".md")), F.concat(F.lit("- #"), "tag", F.lit(" — "), "description")))


def month_lines(dated: DataFrame, described: DataFrame, folder: str) -> DataFrame:
    """LINES of YYYY/YYYY-MM.md for each month of dated(year, month, fname) (K9); described(year, month, description) has every month once."""
    name = F.concat_ws("-", "year", "month")
    path = _file(folder, F.concat_ws("/", F.col("year"), name))
    head = F.concat(_frontmatter(F.col("description"), True), F.array(F.concat(F.lit("# "), name), F.lit("")))
    return _head(described, path, head).union(_listed(dated.select("year", "month", "fname"), path, F.col("fname"), _bullet(F.col("fname"))))


def stats_lines(head: list[str], report: DataFrame, path: str) -> DataFrame:
    """LINES of the report on the graph (K5): its bounded head, and the clusters of report(cluster, size, top_tags, members), largest first."""
    spark = report.sparkSession
    first = spark.createDataFrame([(k, line) for k, line in enumerate(head)], "place int, line string").select(F.lit(path).alias("path"), "place", F.lit("").alias("key"), "line")
    link = lambda x: F.concat(F.lit("[["), x, F.lit("]]"))
    tags = F.array_join(F.transform("top_tags", lambda t: F.concat(F.lit("`"), t["tag"], F.lit("` ("), t["count"].cast("string"), F.lit(")"))), ", ")
    more = F.col("size") - F.size("members")
    lines = F.array_compact(F.array(
        F.concat(F.lit(CLUSTER), F.col("cluster").cast("string"), F.lit(SIZE), F.col("size").cast("string"), F.lit(")")),
        F.concat(F.lit(TOP_TAGS), F.when(tags == "", F.lit("—")).otherwise(tags)),
        F.concat(F.lit(MEMBERS), F.array_join(F.transform("members", link), ", ")),
        F.when(more > 0, F.concat(F.lit(MORE), more.cast("string"))),
        F.lit(""),
    ))
    order = F.concat(F.lpad((F.lit(10**15) - F.col("size")).cast("string"), 16, "0"), F.lpad(F.col("cluster").cast("string"), 20, "0"))
    rows = report.select(order.alias("order"), F.posexplode(lines).alias("k", "line"))
    return first.union(rows.select(F.lit(path).alias("path"), F.lit(LIST).alias("place"), F.concat("order", F.col("k").cast("string")).alias("key"), "line"))


def graph_lines(nodes: DataFrame, edges: DataFrame, totals: DataFrame, path: str) -> DataFrame:
    """LINES of one JSON object of totals, nodes by name, edges and, once nodes have one, clusters (K3)."""
    one = lambda place, line: _head(nodes.sparkSession.range(1), F.lit(path), F.array(F.lit(line))).withColumn("place", F.lit(place))
    text = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)

    def rows(place: int, held: DataFrame, key: list[str], line: Column) -> DataFrame:
        """Lines of a list; all but the first begin with a comma."""
        first = held.agg(F.min(F.struct(*key)).alias("first"))
        held = held.join(F.broadcast(first))
        comma = F.when(F.struct(*key) == F.col("first"), F.lit("")).otherwise(F.lit(","))
        return held.select(F.lit(path).alias("path"), F.lit(place).alias("place"), F.concat_ws("\x00", *key).alias("key"), F.concat(comma, line).alias("line"))

    keys = ("tags", "links_out", "links_in", "degree_out", "degree_in", "cluster", "path", "source_dir")
    node = F.concat(text(F.col("fname")), F.lit(": "), F.to_json(F.struct(*keys)))
    clustered = nodes.filter("cluster <> -1").select("cluster", "fname")
    # A cluster's members are lines of their own: the first opens the list, the last closes it.
    edge = clustered.groupBy("cluster").agg(F.min("fname").alias("low"), F.max("fname").alias("high"))
    least = edge.agg(F.min("cluster").alias("least"))
    members = clustered.join(edge, "cluster").join(F.broadcast(least))
    opening = F.when(F.col("fname") == F.col("low"), F.concat(F.when(F.col("cluster") == F.col("least"), F.lit("")).otherwise(F.lit(",")), text(F.col("cluster").cast("string")), F.lit(": ["))).otherwise(F.lit(","))
    line = F.concat(opening, text(F.col("fname")), F.when(F.col("fname") == F.col("high"), F.lit("]")).otherwise(F.lit("")))
    listed = members.select(F.lit(path).alias("path"), F.lit(60).alias("place"), F.concat(F.lpad(F.col("cluster").cast("string"), 20, "0"), F.lit("\x00"), "fname").alias("key"), line.alias("line"))
    parts = [
        totals.select(F.lit(path).alias("path"), F.lit(0).alias("place"), F.lit("").alias("key"), F.concat(F.lit('{"stats": '), F.to_json(F.struct(*totals.columns)), F.lit(',')).alias("line")),
        one(10, '"nodes": {'), rows(20, nodes, ["fname"], node), one(30, '},\n"edges": ['),
        rows(40, edges, ["src", "dst", "path"], F.to_json(F.array("src", "dst"))), one(50, '],\n"clusters": {'), listed, one(70, "}}"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _digests(lines: DataFrame) -> DataFrame:
    """(path, n, one, two): the number of a file's lines and two sums of their hashes; the same lines in another order count as the same file."""
    each = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), F.col("line")), F.lit(1 << 31)))
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"), each(1).alias("one"), each(2).alias("two"))


@dataclass(frozen=True)
class Published:
    files: int
    written: int
    deleted: int


def publish(lines: DataFrame, existing: DataFrame) -> Published:
    """Makes the files of existing(path, content) those of LINES: writes what differs, deletes what is left over."""
    lines = cut(lines, "artefact-lines")
    # A file's last line ends with a newline, so what comes after it is no line.
    held = existing.select("path", F.explode(F.split("content", "\n", -1)).alias("line"), F.endswith("content", F.lit("\n")).alias("_whole"))
    there = _digests(held).join(existing.select("path", F.endswith("content", F.lit("\n")).alias("whole")), "path")
    blank = F.pmod(F.xxhash64(F.lit(1), F.lit("")), F.lit(1 << 31)), F.pmod(F.xxhash64(F.lit(2), F.lit("")), F.lit(1 << 31))
    there = cut(there.filter("whole").select("path", (F.col("n") - 1).alias("n"), (F.col("one") - blank[0]).alias("one"), (F.col("two") - blank[1]).alias("two")).union(there.filter("not whole").select("path", F.lit(-1).cast("long"), "one", "two")), "artefacts-there")
    wanted = cut(_digests(lines), "artefacts-wanted")
    differ = cut(wanted.join(there, ["path", "n", "one", "two"], "left_anti").select("path"), "artefacts-differ")
    stale = cut(there.join(wanted, "path", "left_anti").select("path"), "artefacts-stale")
    counts = [x.count() for x in (wanted, differ, stale)]
    if counts[1]:
        markdown.write(lines.join(differ, "path", "left_semi"))
    if counts[2]:
        markdown.delete(stale)
    return Published(*counts)
