"""Settings of a vault (S4): thresholds, exclusions and source folders, read from JSON with defaults.

A missing file, malformed JSON, or JSON that is no object gives the defaults.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    min_degree_for_moc: int = 5
    max_link_suggestions: int = 50
    min_similarity: float = 0.20
    min_tokens: int = 50
    max_ingest: int = 10
    max_to_validate: int = 20
    excluded_index_tags: tuple[str, ...] = ("need-processing", "daily-note")
    excluded_suggestion_tags: tuple[str, ...] = ("daily-note",)
    excluded_analyze_tags: tuple[str, ...] = ("daily-note",)
    excluded_suggestion_dirs: tuple[str, ...] = ("daily notes",)
    tag_dirs: tuple[str, ...] = ("atoms", "daily notes")
    graph_dirs: tuple[str, ...] = ("atoms",)
    ingest_dirs: tuple[str, ...] = ("atoms",)
    date_dirs: tuple[str, ...] = ("atoms", "daily notes")
    top_n: int = 20
    max_moc_entries: int = 50
    max_semantic_notes: int | None = 1500
    max_sweeps: int = 20
    exclude_mode: str = field(default="either")  # "both": drop a pair only if both notes are excluded


def _list(section: dict, key: str) -> tuple[str, ...] | None:
    found = section.get(key)
    return tuple(found) if isinstance(found, list) and all(isinstance(x, str) for x in found) else None


def from_dict(data: object) -> Config:
    if not isinstance(data, dict):
        return Config()
    part = lambda name: data.get(name) if isinstance(data.get(name), dict) else {}
    limits, exclude, dirs = part("thresholds"), part("exclude"), part("source_dirs")
    tags = _list(exclude, "tags")
    found = {
        "min_degree_for_moc": limits.get("min_cluster_size_for_moc"),
        "max_link_suggestions": limits.get("max_link_suggestions"),
        "min_similarity": limits.get("min_tfidf_similarity"),
        "min_tokens": limits.get("min_content_tokens"),
        "max_ingest": limits.get("max_ingest_per_run") if type(limits.get("max_ingest_per_run")) is int else None,
        "max_to_validate": limits.get("max_suggestions_to_validate"),
        "excluded_index_tags": tags,
        "excluded_suggestion_tags": tags,
        "excluded_analyze_tags": _list(exclude, "tags_from_analyze"),
        "excluded_suggestion_dirs": _list(exclude, "dirs_from_suggestions"),
        "tag_dirs": _list(dirs, "tags"),
        "graph_dirs": _list(dirs, "graph"),
        "ingest_dirs": _list(dirs, "ingest") or None,
        "date_dirs": _list(dirs, "dates"),
    }
    names = {f.name for f in fields(Config)}
    return Config(**{k: v for k, v in found.items() if v is not None and k in names})


def load(path: str | Path) -> Config:
    try:
        return from_dict(json.loads(Path(path).read_text(encoding="utf-8")))
    except (OSError, ValueError):
        return Config()


def merge(old: dict, new: dict) -> dict:
    """An upgrade of settings (M1): thresholds and source folders of the new win, exclusions are joined, old ones first."""
    out = {**old, **{k: v for k, v in new.items() if k not in ("thresholds", "exclude", "source_dirs")}}
    for name in ("thresholds", "source_dirs"):
        if name in old or name in new:
            out[name] = {**old.get(name, {}), **new.get(name, {})}
    if "exclude" in old or "exclude" in new:
        before, after = old.get("exclude", {}), new.get("exclude", {})
        out["exclude"] = {k: list(dict.fromkeys([*before.get(k, []), *after.get(k, [])])) for k in [*before, *(k for k in after if k not in before)]}
    return out
