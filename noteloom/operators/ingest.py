"""Queue of unprocessed notes and suggestions for them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.config import Config
from noteloom.functions import text as T
from noteloom.operators import phrases
from noteloom.operators.suggest import only_tags

TAG, PROJECT, DAILY = "need-processing", "project", ("daily-note",)


def _tagged(notes: DataFrame, config: Config, tag: str) -> tuple[DataFrame, list[str]]:
    """The notes of the queue's folders whose frontmatter has the tag in any case, and the columns that order them."""
    has = F.exists(T.ingest_tags(T.frontmatter(F.col("content"))), lambda t: F.lower(t) == tag.lower())
    place = F.array_position(F.array(*[F.lit(d) for d in config.ingest_dirs]), F.col("source_dir"))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    rows = notes.filter(F.col("source_dir").isin(*config.ingest_dirs) & F.coalesce(has, F.lit(False))).select(place.alias("_place"), folder.alias("_folder"), "fname", "path")
    return rows, ["_place", "_folder", "fname", "path"]


def unprocessed(notes: DataFrame, config: Config, tag: str = TAG) -> DataFrame:
    """(fname, path) of all notes whose frontmatter has the tag; no limit and no order."""
    return _tagged(notes, config, tag)[0].select("fname", "path")


def needs_processing(notes: DataFrame, config: Config, tag: str = TAG, n: int | None = None) -> DataFrame:
    """(rank, fname, path): notes whose frontmatter has the tag in any case, folder by folder, then by name.

    The limit is never below one.
    """
    rows, order = _tagged(notes, config, tag)
    limit = config.max_ingest if n is None else n
    return rows.orderBy(*order).limit(max(1, limit)).select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "fname", "path")


def keywords(queue: DataFrame) -> DataFrame:
    """(fname, keyword) of the titles of queue(fname)."""
    title = F.regexp_replace("fname", r"(?i)\.md$", "")
    return queue.select("fname", F.explode(T.title_keywords(title)).alias("keyword"))


def tag_suggestions(words: DataFrame, index: DataFrame, assigned: DataFrame, n: int = 5) -> DataFrame:
    """(fname, rank, tag, score): tags by how many of a note's keywords their name or description contains, without those assigned(fname, tag).

    index(tag, description) holds no excluded tags.
    """
    texts = index.select(F.col("tag").alias("key"), F.concat_ws(" ", "tag", "description").alias("text"))
    found = phrases.containing(words, texts)
    scored = words.join(found, "keyword").groupBy("fname", F.col("key").alias("tag")).agg(F.count_distinct("keyword").alias("score"))
    return phrases.best(scored.join(assigned, ["fname", "tag"], "left_anti"), "fname", n, "tag")


def only_daily(notes: DataFrame) -> DataFrame:
    """(fname) of the notes that have tags, and none but those of daily notes; a name of several notes is one if all are.

    Tags are looked for only in notes in which such a tag stands somewhere.
    """
    found = F.transform(F.array_union(T.index_tags(T.frontmatter(F.col("content"))), T.hashtags(T.body(F.col("content")))), lambda t: F.lower(t))
    some = reduce(or_, [F.contains(F.lower("content"), F.lit(t)) for t in DAILY])
    return notes.select("fname", F.when(some, only_tags(found, DAILY)).when(~some, F.lit(False)).alias("daily")).groupBy("fname").agg(F.bool_and("daily").alias("daily")).filter("daily").select("fname")


def link_suggestions(queue: DataFrame, notes: DataFrame, tags: DataFrame, links: DataFrame, suggested: DataFrame, n: int = 5) -> DataFrame:
    """(fname, rank, candidate, score) of the notes of queue(fname): candidates by common tags and key phrases of the title.

    A tag counts if the candidate has it and the note has it or is to get it by suggested(fname, tag); a phrase counts if the
    candidate's title or body holds it. Left out are the note itself, what links(src, dst) says it links to, and notes with
    only the tag of daily notes. tags(fname, tag) and notes(fname, path, content) are those of all notes.
    """
    asked = queue.select("fname").distinct()
    mine = asked.join(tags, "fname").select("fname", "tag").union(suggested.select("fname", "tag")).distinct()
    common = mine.join(tags.select(F.col("fname").alias("candidate"), "tag"), "tag").groupBy("fname", "candidate").agg(F.count_distinct("tag").alias("points"))
    wanted = phrases.key_phrases(asked)
    held = phrases.holders(notes, wanted).withColumnRenamed("fname", "candidate")
    hits = wanted.join(held, "phrase").groupBy("fname", "candidate").agg(F.count(F.lit(1)).alias("points"))
    scored = common.unionByName(hits).filter("fname != candidate").groupBy("fname", "candidate").agg(F.sum("points").alias("score"))
    scored = scored.join(links.select(F.col("src").alias("fname"), F.col("dst").alias("candidate")), ["fname", "candidate"], "left_anti")
    scored = scored.join(only_daily(notes).withColumnRenamed("fname", "candidate"), "candidate", "left_anti")
    return phrases.best(scored, "fname", n, "candidate")


def projects(tags: DataFrame) -> DataFrame:
    """(fname) of the notes that have the tag of projects."""
    return tags.filter(F.col("tag") == PROJECT).select("fname").distinct()


def project_suggestions(words: DataFrame, projects: DataFrame) -> DataFrame:
    """(fname, rank, project, score): for each note the project whose title shares most keywords with its own."""
    titles = keywords(projects.select("fname")).withColumnRenamed("fname", "project")
    scored = words.join(titles, "keyword").filter("fname != project").groupBy("fname", "project").agg(F.count_distinct("keyword").alias("score"))
    return phrases.best(scored, "fname", 1, "project")


def suggestions(queue: DataFrame, notes: DataFrame, parsed: DataFrame, index: DataFrame, tags: DataFrame) -> DataFrame:
    """(rank, fname, path, tags, new_tags, new_links, project) for each note of the queue: the whole of D5.

    notes(fname, path, content) and tags(fname, tag) of all notes; parsed(fname, fields, ...) of the queue's; index(tag, description). Notes
    that have a project get no other, and what they have is never taken away.
    """
    words = keywords(queue)
    links = parsed.select(F.col("fname").alias("src"), F.explode(F.array_union("links_fm", "links_body")).alias("dst")).distinct()
    with_project = parsed.filter(F.size(F.coalesce(F.try_element_at("fields", F.lit("project")), _none())) > 0).select("fname")
    best = lambda rows, name, out: rows.groupBy("fname").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", name))), lambda x: x[name]).alias(out))
    own = tags.select("fname", "tag").union(parsed.select("fname", F.explode("tags").alias("tag"))).distinct()
    new_tags = tag_suggestions(words, index, own)
    linked = link_suggestions(queue, notes, tags, links, new_tags)
    project = project_suggestions(words.join(with_project, "fname", "left_anti"), projects(tags)).select("fname", "project")
    current = parsed.groupBy("path").agg(F.first("tags").alias("tags"))
    rows = queue.join(best(new_tags, "tag", "new_tags"), "fname", "left").join(best(linked, "candidate", "new_links"), "fname", "left").join(project, "fname", "left").join(current, "path", "left")
    return rows.select("rank", "fname", "path", F.coalesce("tags", _none()).alias("tags"), F.coalesce("new_tags", _none()).alias("new_tags"), F.coalesce("new_links", _none()).alias("new_links"), "project").orderBy("rank")


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")
