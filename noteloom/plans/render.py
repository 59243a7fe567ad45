"""Markdown reports of bounded size (K5-K8, K10, K13). Results are DataFrames first; these writers only lay out their rows.

Artefacts that grow with the vault are written by tasks (``artefacts``). Reports go to folders that the driver can open.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, Row

#: Fixed texts of the reports: descriptions, headings and heads of tables, in the order of the files.
TEXTS = {
    "stats": "Статистика графа связей: хабы, сироты, мосты, кластеры, компоненты связности.",
    "links": "Топ предложений по связям на основе графового анализа (Common Neighbours + Jaccard).",
    "semantic": "Топ семантических предложений по связям на основе TF-IDF косинусного сходства.",
    "moc": "Индекс MOC-хабов (Maps of Content) — заметки-оглавления с высоким количеством связей.",
}
STATS, COMPONENTS, ORPHANS, BRIDGES, CLUSTERS = "# Graph Statistics", "## Компоненты связности", "## Сироты (без связей)", "## Мосты (межкластерные заметки)", "## Кластеры (label propagation)"
HUB_TABLE = ("| # | Заметка | Degree | Out | In | Теги |", "|---|---------|--------|-----|----|------|")
LINKS, SEMANTIC, MOC, DETAILS = "# Link Suggestions (Graph)", "# Semantic Link Suggestions (TF-IDF)", "# MOC index", "## Детали"
LINK_TABLE = ("| # | Заметка A | Заметка B | Common | Jaccard | Общие теги |", "|---|-----------|-----------|--------|---------|------------|")
SEMANTIC_TABLE = ("| # | Заметка A | Заметка B | Similarity | Общие теги |", "|---|-----------|-----------|------------|------------|")
#: Fixed texts: the sections of a research document, and the columns of the preview of suggestions for the queue.
SECTIONS = ("Краткий снимок", "Ключевые находки", "Выводы", "Источники")
PREVIEW = ("#", "Заметка", "Текущие теги", "Предлагаемые теги", "Предлагаемые связи", "Проект")


def _write(path: Path, lines: Iterable[str]) -> None:
    """Writes the file, unless it has these lines already."""
    text = "\n".join(lines) + "\n"
    if path.exists() and path.read_text(encoding="utf-8") == text:
        return
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def _head(description: str) -> list[str]:
    return ["---", f"description: {description}", "---", ""]


def _code(names: Iterable[str], empty: str = "—") -> str:
    return ", ".join(f"`{n}`" for n in names) or empty


def _links(names: Iterable[str]) -> str:
    return ", ".join(f"[[{n}]]" for n in names)


def graph_stats(sizes: Row, hubs: list[Row], orphans: list[str], n_orphans: int, bridges: list[Row], n_clusters: int) -> list[str]:
    """The report's lines up to its clusters, which ``artefacts.stats_lines`` adds; orphans: the first ones of n_orphans."""
    lines = [*_head(TEXTS["stats"]), STATS, "", COMPONENTS]
    lines += [f"- Всего компонент: {sizes['components']}", f"- Гигантская компонента: {sizes['giant']} заметок", f"- Мелких компонент (2–5 заметок): {sizes['small']}", f"- Изолированных (размер 1): {sizes['isolated']}", ""]
    lines += [f"## Хабы (top-{len(hubs)})", "", *HUB_TABLE]
    lines += [f"| {k} | [[{h['fname']}]] | {h['degree']} | {h['degree_out']} | {h['degree_in']} | {_code(h['tags'][:3])} |" for k, h in enumerate(hubs, 1)]
    lines += ["", ORPHANS, f"Всего: {n_orphans} заметок", "", *[f"- [[{o}]]" for o in orphans]]
    lines += [f"- ... и ещё {n_orphans - len(orphans)}"] if n_orphans > len(orphans) else []
    lines += ["", BRIDGES, ""]
    for k, b in enumerate(bridges, 1):
        lines += [f"### {k}. [[{b['name']}]] (degree {b['degree']})", f"- Теги: {_code(b['tags'])}", f"- Теги соседей: {_code(b['neighbor_tags'][:5], '')}", f"- Пересечение: {_code(b['overlap'])}", ""]
    return [*lines, CLUSTERS, f"Всего кластеров: {n_clusters}", ""]


def link_suggestions(rows: list[Row], stats: Row, path: str | Path) -> None:
    lines = [*_head(TEXTS["links"]), LINKS, "", f"Всего заметок: {stats['total_nodes']}, рёбер: {stats['total_edges']}", f"Найдено предложений: {len(rows)}", ""]
    lines += LINK_TABLE
    lines += [f"| {r['rank']} | [[{r['a']}]] | [[{r['b']}]] | {r['common']} | {r['jaccard']} | {_code(r['shared_tags'])} |" for r in rows]
    lines += ["", DETAILS, ""]
    for r in rows:
        lines += [f"### {r['rank']}. [[{r['a']}]] ↔ [[{r['b']}]]", f"- Common neighbours ({r['common']}): {_links(r['shared_neighbors'])}", f"- Jaccard: {r['jaccard']}", f"- Tags A: {_code(r['tags_a'])}", f"- Tags B: {_code(r['tags_b'])}", ""]
    _write(Path(path), lines)


def semantic_suggestions(rows: list[Row], least: float, path: str | Path) -> None:
    lines = [*_head(TEXTS["semantic"]), SEMANTIC, "", f"Найдено предложений: {len(rows)} (min similarity: {least})", ""]
    lines += SEMANTIC_TABLE
    lines += [f"| {r['rank']} | [[{r['a']}]] | [[{r['b']}]] | {r['similarity']} | {_code(r['shared_tags'])} |" for r in rows]
    lines += ["", DETAILS, ""]
    for r in rows:
        lines += [f"### {r['rank']}. [[{r['a']}]] ↔ [[{r['b']}]]", f"- Similarity: {r['similarity']}", f"- Tags A: {_code(r['tags_a'])}", f"- Tags B: {_code(r['tags_b'])}", ""]
    _write(Path(path), lines)


def moc_index(rows: list[Row], path: str | Path) -> None:
    lines = [*_head(TEXTS["moc"]), MOC, ""]
    for r in rows:
        lines += [f"## {r['rank']}. [[{r['fname']}]]", f"- Degree: {r['degree']} (out: {r['degree_out']}, in: {r['degree_in']})", f"- Tags: {_code(r['tags'])}", f"- Cluster: {r['cluster']} (size: {r['cluster_size']})", f"- Linked: {_links(r['linked'])}"]
        lines += [f"  ... и ещё {r['more']}"] if r["more"] else []
        lines.append("")
    _write(Path(path), lines)


def research(topic: str, tags: list[str], notes: list[str], findings: dict[str, list[str]], folder: str | Path, at: datetime) -> Path:
    """The research document (K13); its prose is the caller's: findings by section title."""
    path = Path(folder) / f"{at:%Y%m%d%H%M} {re.sub(r'[/\\]', '-', topic)}.md"
    lines = ["---", f'topic: "{topic}"', f'date: "{at:%Y-%m-%d}"', "tags:", *[f"  - {t}" for t in tags], "---", "", f"# {topic}", ""]
    for title in SECTIONS[:-1]:
        lines += [f"## {title}", *findings.get(title, []), ""]
    _write(path, [*lines, f"## {SECTIONS[-1]}", *[f"- [[{n}]]" for n in notes]])
    return path


def ingest_preview(rows: Iterable[Row]) -> str:
    """What the notes of the queue have and what would be added to them, a table row for each."""
    plain = lambda names: ", ".join(names) or "—"
    lines = [f"| {' | '.join(PREVIEW)} |", f"|{'|'.join('---' for _ in PREVIEW)}|"]
    lines += [f"| {r['rank']} | [[{r['fname']}]] | {plain(r['tags'])} | {plain(r['new_tags'])} | {_links(r['new_links']) or '—'} | {'[[' + r['project'] + ']]' if r['project'] else '—'} |" for r in rows]
    return "\n".join(lines) + "\n"


def queue_listing(queue: DataFrame, limit: int, tag: str = "need-processing") -> tuple[str, str]:
    """The names, a line each, and the summary line."""
    names = [r["fname"] for r in queue.orderBy("rank").collect()]  # at most the queue's limit
    return "".join(f"{n}\n" for n in names), f"Found {len(names)} note(s) with #{tag} in frontmatter (limit {limit})."
