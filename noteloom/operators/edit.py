"""Edits of note metadata (U1-U4, K14): planned as rows, applied only when confirmed.

Rewriting reads every field of the frontmatter and writes all of them: wikilinks in double quotes, lists as
block lists, single values on their line. Each planned row says in ``change`` what it adds; it is null where nothing is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.sources import markdown

NONE = "cast(array() as array<string>)"


def _get(fields: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(fields, F.lit(key)), F.expr(NONE))


def _with(fields: Column, key: str, values: Column) -> Column:
    """fields with key set; a new key comes last."""
    entries = F.map_entries(fields)
    changed = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == key, values).otherwise(e["value"]).alias("value")))
    added = F.concat(entries, F.array(F.struct(F.lit(key).alias("key"), values.alias("value"))))
    return F.map_from_entries(F.when(F.map_contains_key(fields, F.lit(key)), changed).otherwise(added))


def serialize(fields: Column, body: Column, lists: tuple[str, ...] = ("tags", "links")) -> Column:
    """A note's content from its fields and body."""

    def lines(e: Column) -> Column:
        quoted = lambda x: F.when((e["key"] == "links") | x.rlike(r"^\[\[[^\]]+\]\]$"), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x)
        block = F.concat(F.array(F.concat(e["key"], F.lit(":"))), F.transform(e["value"], lambda x: F.concat(F.lit("  - "), quoted(x))))
        single = F.array(F.concat(e["key"], F.lit(": "), quoted(F.get(e["value"], F.lit(0)))))
        return F.when(e["key"].isin(*lists) | (F.size(e["value"]) != 1), block).otherwise(single)

    held = F.array_join(F.concat(F.array(F.lit("---")), F.flatten(F.transform(F.map_entries(fields), lines)), F.array(F.lit("---"), F.lit(""))), "\n")
    return F.concat(held, F.lit("\n"), F.regexp_replace(body, r"^\n+", ""))


def _added(what: str, new: Column) -> Column:
    return F.when(F.size(new) > 0, F.concat(F.lit(f"added {what}: "), F.array_join(new, ", ")))


def _wikilink(name: Column) -> Column:
    return F.concat(F.lit("[["), name, F.lit("]]"))


def ingest(parsed: DataFrame, suggested: DataFrame) -> DataFrame:
    """(fname, path, content, change) of the notes of suggested(fname, new_tags, new_links, project): all that is suggested and new, added at once.

    Tags and links are joined with those there are; a project is set where there is none, as ``"[[project.md]]"``. Nothing is taken away.
    """
    rows = parsed.join(suggested.select("fname", F.coalesce("new_tags", F.expr(NONE)).alias("_tags"), F.coalesce("new_links", F.expr(NONE)).alias("_links"), F.col("project").alias("_project")), "fname")
    rows = rows.withColumn("fields", F.coalesce("fields", F.expr("map_from_entries(cast(array() as array<struct<k:string,v:array<string>>>))")))
    rows = rows.withColumn("_tags", F.array_except("_tags", _get(F.col("fields"), "tags"))).withColumn("_links", F.array_except(F.transform("_links", _wikilink), _get(F.col("fields"), "links")))
    rows = rows.withColumn("_project", F.when(F.size(_get(F.col("fields"), "project")) == 0, _wikilink(F.col("_project"))))

    def joined(held: Column, key: str, new: str) -> Column:
        return F.when(F.size(new) > 0, _with(held, key, F.array_distinct(F.concat(_get(held, key), F.col(new))))).otherwise(held)

    rows = rows.withColumn("_tagged", joined(F.col("fields"), "tags", "_tags")).withColumn("_linked", joined(F.col("_tagged"), "links", "_links"))
    done = F.when(F.col("_project").isNotNull(), _with(F.col("_linked"), "project", F.array("_project"))).otherwise(F.col("_linked"))
    change = F.nullif(F.concat_ws("; ", _added("tags", F.col("_tags")), _added("links", F.col("_links")), F.concat(F.lit("set project: "), F.col("_project"))), F.lit(""))
    return rows.withColumn("_done", done).select("fname", "path", serialize(F.col("_done"), F.col("body")).alias("content"), change.alias("change"))


def _suggested(rows: DataFrame, tags: Column | None = None, links: Column | None = None) -> DataFrame:
    none = F.expr(NONE)
    held = rows.groupBy("fname").agg((none if tags is None else F.sort_array(F.collect_set(tags))).alias("new_tags"), (none if links is None else F.sort_array(F.collect_set(links))).alias("new_links"))
    return held.withColumn("project", F.lit(None).cast("string"))


def add_links(parsed: DataFrame, targets: DataFrame) -> DataFrame:
    """(fname, path, content, change) of the notes to which targets(fname, target) adds a link."""
    return ingest(parsed, _suggested(targets, links=F.col("target")))


def merge_tags(parsed: DataFrame, added: DataFrame) -> DataFrame:
    """(fname, path, content, change) of the notes that added(fname, tag) names; tags are joined, none is removed."""
    return ingest(parsed, _suggested(added, tags=F.col("tag")))


def set_project(parsed: DataFrame, projects: DataFrame) -> DataFrame:
    """(fname, path, content, change) of the notes of projects(fname, project) that have no project yet (U3); project is a note's name."""
    none = F.expr(NONE)
    return ingest(parsed, projects.select("fname", none.alias("new_tags"), none.alias("new_links"), "project")).filter("change is not null")


#: Folders that no edit may touch.
PROTECTED = ("templates", ".obsidian", ".trash")


def plan(changed: DataFrame, most: int) -> DataFrame:
    """The first ``most`` changes by name that add something, without protected folders."""
    parts = F.split("path", "/")
    held = changed.filter(F.col("change").isNotNull() & ~F.exists(parts, lambda p: p.isin(*PROTECTED)))
    return held.orderBy("fname", "path").limit(most)


def apply(planned: DataFrame, confirmed: bool = False) -> DataFrame:
    """Writes the planned contents to their paths, by tasks (U4), and returns (path, change) of what was written.

    The plan has to be a table that does not change, as what is returned is read from it.
    """
    if not confirmed:
        raise PermissionError("edits are applied only when confirmed")
    markdown.write(planned.select("path", "content"))
    return planned.select("path", "change")
