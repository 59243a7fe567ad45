"""The log of operations (K12): an append-only table, from which ``wiki/LOG.md`` is rendered with the newest entry first."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import datetime
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An entry: its id, when and by which command, what was done, and a line for each file that was changed. ``raw`` is the text of an
#: older log that was there before the table.
ENTRY = "id string, ts timestamp, command string, summary string, changes array<string>, raw string"
#: Fixed texts of an entry, and the commands that are logged.
COMMAND, CHANGES = "**Command:**", "### Changes"
COMMANDS = ("wiki-reindex", "wiki-research", "wiki-analyze", "wiki-lint", "wiki-ingest")


class OpLog:
    """The table below ``wiki``/data/oplog and the file ``wiki``/LOG.md."""

    def __init__(self, spark: SparkSession, wiki: Path):
        self.spark, self.table, self.file = spark, str(wiki / "data" / "oplog"), wiki / "LOG.md"

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(ENTRY).parquet(self.table)
        except AnalysisException:  # nothing was logged yet
            return self.spark.createDataFrame([], ENTRY)

    def append(self, command: str, summary: str, changes: Iterable[str] | DataFrame = (), at: datetime | None = None) -> str:
        """Adds an entry and renders the file anew; returns the entry's id. Changes are lines, or rows(path, change)."""
        if command not in COMMANDS:
            raise ValueError(f"no such command: {command}")
        at = at or datetime.now()
        entry = f"{at:%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        rows = [] if self.entries().limit(1).count() or not self.file.exists() else [("", datetime(1970, 1, 1), None, None, None, self.file.read_text(encoding="utf-8"))]
        lines = [f"{r['path']}: {r['change']}" for r in changes.toLocalIterator()] if isinstance(changes, DataFrame) else list(changes)
        rows.append((entry, at, command, summary, lines, None))
        self.spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(self.table)
        self.render()
        return entry

    def render(self) -> None:
        """Writes the file aside and then in its place, entry by entry."""
        self.file.parent.mkdir(parents=True, exist_ok=True)
        aside = self.file.with_name(f".{uuid.uuid4().hex}.part")
        with aside.open("w", encoding="utf-8") as out:
            for k, row in enumerate(self.entries().orderBy(F.desc("ts"), F.desc("id")).toLocalIterator()):
                out.write("\n" if k else "")
                out.write(row["raw"] if row["raw"] is not None else text(row["command"], row["summary"], row["changes"], row["ts"]))
        aside.replace(self.file)


def text(command: str, summary: str, changes: list[str], at: datetime) -> str:
    lines = [f"## {at:%Y-%m-%d %H:%M}", "", f"{COMMAND} {command}", "", summary]
    if changes:
        lines += ["", CHANGES, *[f"- {c}" for c in changes]]
    return "\n".join(lines) + "\n"
