"""The layout of the reports, row by row."""

from noteloom.plans import render


def text(path):
    return path.read_text(encoding="utf-8").split("\n")


def test_link_suggestions(tmp_path):
    rows = [{"rank": 1, "a": "a.md", "b": "b.md", "common": 2, "jaccard": 0.25, "shared_neighbors": ["x.md", "y.md"], "shared_tags": ["t"], "tags_a": ["t", "u"], "tags_b": ["t"]}, {"rank": 2, "a": "c.md", "b": "d.md", "common": 1, "jaccard": 0.5, "shared_neighbors": ["x.md"], "shared_tags": [], "tags_a": [], "tags_b": []}]
    render.link_suggestions(rows, {"total_nodes": 7, "total_edges": 9}, tmp_path / "l.md")
    assert text(tmp_path / "l.md") == [
        "---", "description: Топ предложений по связям на основе графового анализа (Common Neighbours + Jaccard).", "---", "", "# Link Suggestions (Graph)", "", "Всего заметок: 7, рёбер: 9", "Найдено предложений: 2", "",
        "| # | Заметка A | Заметка B | Common | Jaccard | Общие теги |", "|---|-----------|-----------|--------|---------|------------|", "| 1 | [[a.md]] | [[b.md]] | 2 | 0.25 | `t` |", "| 2 | [[c.md]] | [[d.md]] | 1 | 0.5 | — |",
        "", "## Детали", "", "### 1. [[a.md]] ↔ [[b.md]]", "- Common neighbours (2): [[x.md]], [[y.md]]", "- Jaccard: 0.25", "- Tags A: `t`, `u`", "- Tags B: `t`", "",
        "### 2. [[c.md]] ↔ [[d.md]]", "- Common neighbours (1): [[x.md]]", "- Jaccard: 0.5", "- Tags A: —", "- Tags B: —", "", "",
    ]


def test_semantic_suggestions(tmp_path):
    rows = [{"rank": 1, "a": "a.md", "b": "b.md", "similarity": 0.4321, "shared_tags": ["t"], "tags_a": ["t"], "tags_b": ["t", "v"]}]
    render.semantic_suggestions(rows, 0.2, tmp_path / "s.md")
    assert text(tmp_path / "s.md")[4:] == [
        "# Semantic Link Suggestions (TF-IDF)", "", "Найдено предложений: 1 (min similarity: 0.2)", "", "| # | Заметка A | Заметка B | Similarity | Общие теги |", "|---|-----------|-----------|------------|------------|",
        "| 1 | [[a.md]] | [[b.md]] | 0.4321 | `t` |", "", "## Детали", "", "### 1. [[a.md]] ↔ [[b.md]]", "- Similarity: 0.4321", "- Tags A: `t`", "- Tags B: `t`, `v`", "", "",
    ]


def test_moc_index(tmp_path):
    rows = [{"rank": 1, "fname": "h.md", "degree": 9, "degree_out": 7, "degree_in": 2, "tags": ["t"], "cluster": 4, "cluster_size": 12, "linked": ["a.md", "b.md"], "more": 2}, {"rank": 2, "fname": "i.md", "degree": 5, "degree_out": 0, "degree_in": 5, "tags": [], "cluster": -1, "cluster_size": 1, "linked": [], "more": 0}]
    render.moc_index(rows, tmp_path / "m.md")
    assert text(tmp_path / "m.md")[4:] == [
        "# MOC index", "", "## 1. [[h.md]]", "- Degree: 9 (out: 7, in: 2)", "- Tags: `t`", "- Cluster: 4 (size: 12)", "- Linked: [[a.md]], [[b.md]]", "  ... и ещё 2", "",
        "## 2. [[i.md]]", "- Degree: 5 (out: 0, in: 5)", "- Tags: —", "- Cluster: -1 (size: 1)", "- Linked: ", "", "",
    ]


def test_graph_stats():
    hubs = [{"fname": "h.md", "degree": 3, "degree_out": 1, "degree_in": 2, "tags": ["a", "b", "c", "d"]}]
    bridges = [{"name": "b.md", "degree": 4, "tags": ["a"], "neighbor_tags": [], "overlap": []}]
    assert render.graph_stats({"components": 5, "giant": 3, "small": 1, "isolated": 2}, hubs, ["o.md"], 1, bridges, 1)[4:] == [
        "# Graph Statistics", "", "## Компоненты связности", "- Всего компонент: 5", "- Гигантская компонента: 3 заметок", "- Мелких компонент (2–5 заметок): 1", "- Изолированных (размер 1): 2", "",
        "## Хабы (top-1)", "", "| # | Заметка | Degree | Out | In | Теги |", "|---|---------|--------|-----|----|------|", "| 1 | [[h.md]] | 3 | 1 | 2 | `a`, `b`, `c` |", "",
        "## Сироты (без связей)", "Всего: 1 заметок", "", "- [[o.md]]", "", "## Мосты (межкластерные заметки)", "", "### 1. [[b.md]] (degree 4)", "- Теги: `a`", "- Теги соседей: ", "- Пересечение: —", "",
        "## Кластеры (label propagation)", "Всего кластеров: 1", "",
    ]


def test_a_report_that_did_not_change_is_left_alone(tmp_path):
    path = tmp_path / "s.md"
    render.semantic_suggestions([], 0.2, path)
    before = path.stat().st_mtime_ns
    render.semantic_suggestions([], 0.2, path)
    assert path.stat().st_mtime_ns == before
    render.semantic_suggestions([], 0.3, path)
    assert "0.3" in path.read_text(encoding="utf-8")
