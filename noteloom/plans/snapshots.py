"""Graph snapshots (K4): nodes, edges and totals as tables of a version, and a pointer to the version that counts.

A version is written whole before the pointer is moved to it, and tables are never written over, so a reader sees the old
graph or the new one. Versions before the last ``keep`` are deleted when a new one is published.
"""

from __future__ import annotations

import json
import shutil
import uuid
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("nodes", "edges", "totals")


def _folder(wiki: Path | str) -> Path:
    return Path(wiki) / "data" / "graph"


def digest(*tables: DataFrame) -> str:
    """What the rows of the tables sum to, in any order: counts, and two sums of hashes of whole rows."""
    out = []
    for table in tables:
        sums = [F.coalesce(F.sum(F.pmod(F.xxhash64(F.lit(seed), *table.columns), F.lit(1 << 31))), F.lit(0)) for seed in (1, 2)]
        out += table.agg(F.count(F.lit(1)), *sums).first()
    return "-".join(map(str, out))


def publish(wiki: Path | str, nodes: DataFrame, edges: DataFrame, totals: DataFrame, keep: int = 3) -> tuple[str, bool]:
    """Writes a version and moves the pointer to it; returns its name, and whether it is new: what equals the current version is not written again."""
    folder, sums = _folder(wiki), digest(nodes, edges, totals)
    held = _pointer(wiki)
    if held is not None and held.get("digest") == sums:
        return held["version"], False
    version = f"v{datetime.now():%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:6]}"
    for name, table in zip(TABLES, (nodes, edges, totals), strict=True):
        table.write.parquet(str(folder / version / name))
    aside = folder / f".{version}.part"
    aside.write_text(json.dumps({"version": version, "digest": sums}), encoding="utf-8")
    aside.replace(folder / "current.json")
    for old in versions(wiki)[:-keep]:
        shutil.rmtree(folder / old, ignore_errors=True)
    return version, True


def versions(wiki: Path | str) -> list[str]:
    return sorted(p.name for p in _folder(wiki).glob("v*") if p.is_dir())


def _pointer(wiki: Path | str) -> dict | None:
    path = _folder(wiki) / "current.json"
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else None


def current(wiki: Path | str) -> str | None:
    held = _pointer(wiki)
    return held and held["version"]


def read(spark: SparkSession, wiki: Path | str, version: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, totals) of a version, or of the one that counts now; later publications do not change what was read."""
    version = version or current(wiki)
    if version is None:
        raise FileNotFoundError(f"no graph was published below {wiki}")
    return tuple(spark.read.parquet(str(_folder(wiki) / version / name)) for name in TABLES)
