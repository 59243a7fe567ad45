"""A vault and its pipelines: full re-index, link analysis, queue, research and lint over one parsed scan."""

from __future__ import annotations

import re
from datetime import datetime
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom import config as settings
from noteloom.functions import text as T
from noteloom.operators import analyze, clusters, components, dates, edit, graph, ingest, lint, moc, research, suggest, tags, tfidf
from noteloom.plans import artefacts, render, snapshots
from noteloom.plans.oplog import OpLog
from noteloom.sources import markdown, vault
from noteloom.storage import cut


class Vault:
    """Notes below ``root``; artefacts go to ``root``/wiki. Frames that several results need are written once."""

    def __init__(self, spark: SparkSession, root: str, config: settings.Config | None = None, wiki: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.wiki = Path(wiki or f"{self.root}/wiki")
        self.config = config or settings.load(self.wiki / "config.json")

    @cached_property
    def notes(self) -> DataFrame:
        every = tuple(dict.fromkeys([*self.config.tag_dirs, *self.config.graph_dirs, *self.config.ingest_dirs]))
        return cut(vault.read_notes(self.spark, self.root, every), "notes")

    def of(self, dirs: tuple[str, ...]) -> DataFrame:
        return self.notes.filter(F.col("source_dir").isin(*dirs))

    @cached_property
    def note_tags(self) -> DataFrame:
        return cut(tags.note_tags(self.of(self.config.tag_dirs), self.config.excluded_index_tags), "note-tags")

    @cached_property
    def all_tags(self) -> DataFrame:
        """(tag, fname) with the excluded tags too."""
        return tags.note_tags(self.of(self.config.tag_dirs), ())

    @cached_property
    def log(self) -> OpLog:
        return OpLog(self.spark, self.wiki)

    def _written(self, folder: str) -> DataFrame:
        """(fname, path, content) of the artefacts of an earlier run below wiki/folder."""
        return vault.read_notes(self.spark, str(self.wiki), (folder,)).select("fname", "path", "content")

    def _whole(self, path: str) -> DataFrame:
        """(path, content) of a file, if it is there."""
        held = self.spark.read.text(path, wholetext=True) if Path(path).exists() else self.spark.createDataFrame([], "value string")
        return held.select(F.lit(path).alias("path"), F.col("value").alias("content"))

    def prior_descriptions(self, folder: str) -> DataFrame:
        """(name, description) of the artefacts of an earlier run below wiki/folder."""
        return self._written(folder).select(F.regexp_replace("fname", r"\.md$", "").alias("name"), T.description(T.frontmatter(F.col("content"))).alias("description"))

    def existing_tags(self) -> DataFrame:
        """(tag, description) of the tag files that are there."""
        return self.prior_descriptions("tags").select(F.regexp_replace("name", "%2F", "/").alias("tag"), "description")

    def described_tags(self) -> DataFrame:
        """(tag, description) of every tag of the notes, descriptions carried over from earlier files."""
        prior = self.existing_tags().select("tag", tags.blank_is_null(F.col("description")).alias("description"))
        return self.note_tags.select("tag").distinct().join(prior, "tag", "left").select("tag", "description")

    @cached_property
    def parsed(self) -> DataFrame:
        return cut(vault.parse(self.of(self.config.graph_dirs)).select("fname", "path", "source_dir", "tags", "links_fm", "links_body"), "parsed")

    @cached_property
    def nodes(self) -> DataFrame:
        return cut(graph.nodes(self.parsed), "nodes")

    @cached_property
    def between(self) -> DataFrame:
        return cut(graph.links_between(self.nodes), "between")

    @cached_property
    def components(self) -> DataFrame:
        return cut(components.components(self.nodes, self.between), "components")

    @cached_property
    def clusters(self) -> DataFrame:
        return cut(clusters.clusters(self.nodes, self.between, self.components, self.config.max_sweeps), "clusters")

    @cached_property
    def clustered(self) -> DataFrame:
        """nodes with their cluster."""
        return cut(self.nodes.drop("cluster").join(self.clusters, "fname", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long"))), "clustered")

    def months(self) -> artefacts.Published:
        """Writes the files of months that differ and deletes those of months that are gone."""
        prior = self.prior_descriptions("dates").filter(F.col("name").rlike(r"^\d{4}-\d{2}$")).select(F.substring("name", 1, 4).alias("year"), F.substring("name", 6, 2).alias("month"), tags.blank_is_null(F.col("description")).alias("description"))
        found = cut(dates.dated(vault.list_names(self.spark, self.root, self.config.date_dirs)), "dated")
        described = found.select("year", "month").distinct().join(prior, ["year", "month"], "left")
        there = self._written("dates").filter(F.col("path").rlike(r"/dates/[^/]+/[^/]+\.md$")).select("path", "content")
        return artefacts.publish(artefacts.month_lines(found, described, f"{self.wiki}/dates"), there)

    def tags(self) -> artefacts.Published:
        """Writes the tag files and their index where they differ and deletes the files of tags that are gone."""
        described = cut(self.described_tags(), "described-tags")
        index = f"{self.wiki}/tags-index.md"
        there = self._written("tags").filter(F.col("path").rlike(r"/tags/[^/]+\.md$")).select("path", "content").union(self._whole(index))
        return artefacts.publish(artefacts.tag_lines(self.note_tags, described, f"{self.wiki}/tags").union(artefacts.index_lines(described, index)), there)

    def publish_graph(self, totals: DataFrame) -> str:
        """A new version of the graph and its export as JSON, unless nothing changed; returns the version's name."""
        version, new = snapshots.publish(self.wiki, self.clustered, graph.edges(self.parsed), totals)
        export = self.wiki / "data" / "links-graph.json"
        if new or not export.exists():
            nodes, edges, totals = snapshots.read(self.spark, self.wiki, version)
            markdown.write(artefacts.graph_lines(nodes, edges, totals, str(export)))
        return version

    def reindex(self, at: datetime | None = None) -> dict[str, int]:
        """Brings all artefacts up to date, deletes those of tags and months that are gone, logs it, and returns counts."""
        tagged = self.tags()
        held = cut(graph.stats(self.parsed, self.nodes), "totals")
        self.publish_graph(held)
        totals = held.first()
        report = cut(clusters.report(self.clusters, self.nodes.select("fname", F.explode("tags").alias("tag"))), "report")
        orphans = analyze.orphans(self.nodes)
        head = render.graph_stats(
            components.size_classes(self.components).first(), analyze.hubs(self.nodes, self.config.top_n).collect(), [r["fname"] for r in orphans.limit(self.config.top_n).collect()], orphans.count(),
            analyze.bridges(self.nodes, self.config.top_n).collect(), report.count(),
        )
        path = f"{self.wiki}/data/graph-stats.md"
        artefacts.publish(artefacts.stats_lines(head, report, path), self._whole(path))
        render.moc_index(moc.moc_index(self.clustered, self.config).orderBy("rank").collect(), self.wiki / "moc-index.md")
        dated = self.months()
        # Of the files of tags one is their index.
        done = {"tags": tagged.files - 1, "months": dated.files, "written": tagged.written + dated.written, "deleted": tagged.deleted + dated.deleted, "nodes": totals["total_nodes"], "edges": totals["total_edges"]}
        self.log.append("wiki-reindex", f"{done['tags']} tags, {done['months']} months, {done['nodes']} nodes, {done['edges']} edges; {done['written']} files written, {done['deleted']} deleted", at=at)
        return done

    def link_suggestions(self) -> DataFrame:
        return suggest.link_suggestions(self.nodes, self.config)

    def semantic_suggestions(self) -> DataFrame:
        return tfidf.semantic_suggestions(self.nodes, self.of(self.config.graph_dirs), self.config)

    def analyze(self, at: datetime | None = None) -> DataFrame:
        """Writes both suggestion reports and returns the merged plan; nothing in the notes is changed."""
        links, semantic = cut(self.link_suggestions(), "links"), cut(self.semantic_suggestions(), "semantic")
        render.link_suggestions(links.orderBy("rank").collect(), graph.stats(self.parsed, self.nodes).first(), self.wiki / "data" / "link-suggestions.md")
        render.semantic_suggestions(semantic.orderBy("rank").collect(), self.config.min_similarity, self.wiki / "data" / "semantic-suggestions.md")
        plan = cut(suggest.analyze_plan(links, semantic, self.nodes, self.config), "plan")
        self.log.append("wiki-analyze", f"{links.count()} link suggestions, {semantic.count()} semantic suggestions, {plan.count()} to validate", at=at)
        return plan

    def queue(self) -> DataFrame:
        return ingest.needs_processing(self.of(self.config.ingest_dirs), self.config)

    def ingest(self) -> DataFrame:
        """What to add to the notes of the queue; ``render.ingest_preview`` shows it and ``apply_ingest`` writes it."""
        queue = cut(self.queue(), "queue")
        parsed = vault.parse(self.of(self.config.ingest_dirs).join(queue.select("path"), "path", "left_semi"))
        return ingest.suggestions(queue, self.notes, parsed, self.described_tags(), self.note_tags)

    def apply_ingest(self, suggested: DataFrame, confirmed: bool = False, at: datetime | None = None) -> list[str]:
        return self.apply(edit.ingest(vault.parse(self.of(self.config.ingest_dirs)), suggested), "wiki-ingest", confirmed, at)

    def apply_links(self, plan: DataFrame, confirmed: bool = False, at: datetime | None = None) -> list[str]:
        """Adds a link from a to b for each row of plan(a, b)."""
        return self.apply(edit.add_links(vault.parse(self.of(self.config.graph_dirs)), plan.select(F.col("a").alias("fname"), F.col("b").alias("target"))), "wiki-analyze", confirmed, at)

    def apply(self, changed: DataFrame, command: str, confirmed: bool = False, at: datetime | None = None) -> list[str]:
        """Writes the changes of changed(fname, path, content, change), at most ``max_to_validate``, the log and the tag files; refuses unless confirmed.

        Returns the paths below the vault of what was written.
        """
        planned = cut(edit.plan(changed, self.config.max_to_validate), "edits")
        done = edit.apply(planned, confirmed)
        below = done.select(F.regexp_replace("path", f"^(file:/*(?=/))?{re.escape(self.root)}/", "").alias("path"), "change").orderBy("path")
        written = [r["path"] for r in below.collect()]  # at most the plan's limit
        self.log.append(command, f"{len(written)} notes changed", below, at=at)
        for name in ("notes", "note_tags", "all_tags", "parsed", "nodes", "between", "components", "clusters", "clustered"):
            self.__dict__.pop(name, None)  # what was read before the edits
        self.tags()
        return written

    def research(self, topic: str) -> tuple[DataFrame, DataFrame]:
        """(tags, notes) of a topic."""
        found = cut(research.matching_tags(self.described_tags(), topic), "topic-tags")
        return found, research.notes_for(found, self.note_tags)

    def research_document(self, topic: str, findings: dict[str, list[str]] | None = None, at: datetime | None = None) -> Path:
        """Writes the topic's document to wiki/research and returns its path; findings are the caller's, by section."""
        at = at or datetime.now()
        found, notes = self.research(topic)
        names, used = [r["fname"] for r in notes.orderBy("rank").collect()], [r["tag"] for r in found.collect()]  # at most the report's limits
        path = render.research(topic, used, names, findings or {}, self.wiki / "research", at)
        self.log.append("wiki-research", f"{topic}: {len(used)} tags, {len(names)} notes; saved as research/{path.name}", at=at)
        return path

    def lint(self, at: datetime | None = None) -> dict[str, DataFrame]:
        existing = cut(self.existing_tags(), "existing-tags")
        described = existing.select("tag", tags.blank_is_null(F.col("description")).alias("description"))
        found = {
            "stale_tags": lint.stale_tags(existing.select("tag"), self.note_tags, "tag"),
            "missing_descriptions": lint.missing_descriptions(existing),
            "broken_links": lint.broken_links(graph.edges(self.parsed), self.notes),
            "orphans": lint.orphan_count(analyze.orphans(self.nodes), self.nodes),
            "index_drift": lint.index_drift(existing, tags.consolidated(described)),
            "broken_moc": lint.broken_moc(moc.moc_index(self.clustered, self.config), self.nodes),
            "malformed_links": lint.malformed_links(self.of(self.config.graph_dirs)),
        }
        found = {name: cut(rows, f"lint-{name}") for name, rows in found.items()}
        self.log.append("wiki-lint", "; ".join(f"{name}: {found[name].count()}" for name in ("stale_tags", "broken_links", "broken_moc", "malformed_links")), at=at)
        return found
