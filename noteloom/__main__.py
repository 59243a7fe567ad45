"""Commands over a vault: ``python -m noteloom COMMAND VAULT [TOPIC]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from noteloom.plans import render
from noteloom.plans.reindex import Vault


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="noteloom")
    parser.add_argument("command", choices=("reindex", "queue", "ingest", "analyze", "research", "lint"))
    parser.add_argument("vault", help="folder of the vault")
    parser.add_argument("topic", nargs="?", help="topic of research")
    parser.add_argument("--yes", action="store_true", help="confirm the edits that ingest and analyze plan")
    given = parser.parse_args(arguments)
    if given.command == "research" and not given.topic:
        parser.error("research needs a topic")
    vault = Vault(spark or SparkSession.builder.appName("noteloom").getOrCreate(), given.vault)
    if given.command == "reindex":
        print(vault.reindex())
    elif given.command == "queue":
        names, summary = render.queue_listing(vault.queue(), vault.config.max_ingest)
        print(names, end="")
        print(summary, file=sys.stderr)
    elif given.command == "ingest":
        suggested = vault.ingest()
        print(render.ingest_preview(suggested.collect()))  # at most the queue's limit
        if given.yes:
            print("\n".join(vault.apply_ingest(suggested, confirmed=True)))
    elif given.command == "analyze":
        plan = vault.analyze()
        for row in plan.orderBy("rank").collect():  # at most the plan's limit
            print(f"{row['rank']}. {row['type']}: [[{row['a']}]] - [[{row['b']}]] ({row['score']})")
        if given.yes:
            print("\n".join(vault.apply_links(plan, confirmed=True)))
    elif given.command == "research":
        print(vault.research_document(given.topic))
    else:
        for name, rows in vault.lint().items():
            print(f"{name}: {rows.count()}")
            rows.show(20, truncate=False)


if __name__ == "__main__":
    main()
