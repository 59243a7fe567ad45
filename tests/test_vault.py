"""A hand-written vault through the whole re-index, and graph cases worked out by hand."""

import json
import os
import random
import time
from collections import Counter
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from noteloom import config as settings
from noteloom.operators import analyze, clusters, components, edit, graph, ingest, lint, suggest, tags, tfidf
from noteloom.plans import artefacts, render
from noteloom.plans.reindex import Vault
from noteloom.sources import graph_json, vault
from noteloom.streaming import incremental

NOTES = {
    "atoms/202501010001 Здоровое питание.md": "---\ntags:\n  - health\n---\nТекст про еду #food",
    "atoms/202501010002 Спорт.md": '---\ntags:\n  - health\n  - sport\nlinks:\n  - "[[202501010001 Здоровое питание]]"\n---\nСм. [[нет такой]]',
    "atoms/202501010003 Бег.md": '---\ntags: [sport, Health]\nlinks: "[[202501010001 Здоровое питание.md]]"\n---\n[[202501010002 Спорт|спорт]]',
    "atoms/202501010015 Разобрать.md": "---\ntags:\n  - Need-Processing\n---\nтекст",
    "atoms/202501010016 Обманка.md": "---\ntags: [python]\n---\n#need-processing в тексте",
    "atoms/202501010030 Один.md": "ничего",
    "atoms/sub/202502010001 Глубоко.md": "---\r\ntags:\r\n  - deep\r\nlinks:\r\n  - [[202501010030 Один]]\r\n---\r\ntext",
    "daily notes/2025-01-01.md": "---\ntags:\n  - daily-note\n---\nдень",
    "templates/t.md": "---\ntags: [tpl]\n---\n",
}


@pytest.fixture
def root(tmp_path):
    for name, content in NOTES.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode())
    (tmp_path / "atoms/bad.md").write_bytes(b"\xff\xfe\xfa")
    return str(tmp_path)


def test_reindex(spark, root):
    wiki = Path(root) / "wiki"
    (wiki / "tags").mkdir(parents=True)
    (wiki / "tags/health.md").write_text("---\ndescription: про здоровье\n---\n\n# #health\n", encoding="utf-8")
    (wiki / "tags/gone.md").write_text("# #gone\n", encoding="utf-8")
    held = Vault(spark, root)
    done = held.reindex()
    assert not (wiki / "tags/gone.md").exists() and not (wiki / "tags/tpl.md").exists() and not (wiki / "tags/daily-note.md").exists()
    health = (wiki / "tags/health.md").read_text(encoding="utf-8")
    assert health.startswith("---\ndescription: про здоровье\n---\n\n# #health\n") and health.count("- [[") == 3
    assert (wiki / "tags-index.md").read_text(encoding="utf-8") == "# Tags index\n\n- #health — про здоровье\n"
    data = json.loads((wiki / "data/links-graph.json").read_text(encoding="utf-8"))
    assert done["nodes"] == 7 == len(data["nodes"]) and done["edges"] == 5 == len(data["edges"])
    assert data["nodes"]["202501010001 Здоровое питание.md"]["degree_in"] == 2
    assert ["202501010002 Спорт.md", "нет такой.md"] in data["edges"]
    assert data["nodes"]["202501010003 Бег.md"]["tags"] == ["[sport, Health]"]
    assert "[[202501010016 Обманка.md]]" in (wiki / "data/graph-stats.md").read_text(encoding="utf-8")
    assert (wiki / "dates/2025/2025-01.md").read_text(encoding="utf-8").startswith("---\ndescription:\n---\n\n# 2025-01\n\n- [[2025-01-01.md]]")
    assert not (wiki / "dates/2025/2025-02.md").exists()  # folders below are not searched for dates
    again = Vault(spark, root).reindex()
    assert again == {**done, "written": 0, "deleted": 0} and done["written"] == done["tags"] + 1 + done["months"]


def test_analyze_queue_research_lint(spark, root):
    held = Vault(spark, root)
    assert [r["fname"] for r in held.queue().collect()] == ["202501010015 Разобрать.md"]
    assert render.queue_listing(held.queue(), 10) == ("202501010015 Разобрать.md\n", "Found 1 note(s) with #need-processing in frontmatter (limit 10).")
    plan = held.analyze().collect()
    assert all(r["rank"] <= 20 for r in plan)
    assert "# Link Suggestions (Graph)" in (Path(root) / "wiki/data/link-suggestions.md").read_text(encoding="utf-8")
    found, notes = held.research("sport и health")
    assert [r["tag"] for r in found.collect()] == ["health", "sport"] and notes.first()["fname"] == "202501010002 Спорт.md"
    checks = {k: v.collect() for k, v in held.lint().items()}
    assert [tuple(r) for r in checks["broken_links"]] == [("202501010002 Спорт.md", "нет такой.md")]
    assert [tuple(r) for r in checks["malformed_links"]] == [("202502010001 Глубоко.md", "[[202501010030 Один]]")]
    assert [r["fname"] for r in vault.broken(spark, root, ("atoms", "none")).collect()] == ["bad.md"]


def test_empty_vault(spark, tmp_path):
    held = Vault(spark, str(tmp_path))
    assert held.reindex() == {"tags": 0, "months": 0, "written": 1, "deleted": 0, "nodes": 0, "edges": 0}
    assert json.loads((tmp_path / "wiki/data/links-graph.json").read_text(encoding="utf-8"))["nodes"] == {}
    assert held.analyze().count() == 0 and held.queue().count() == 0


def test_config(tmp_path):
    assert settings.load(tmp_path / "none.json") == settings.Config()
    for text in ("{", "[1]", "3"):
        (tmp_path / "c.json").write_text(text)
        assert settings.load(tmp_path / "c.json") == settings.Config()
    (tmp_path / "c.json").write_text(json.dumps({"thresholds": {"max_ingest_per_run": "7", "min_content_tokens": 3}, "exclude": {"tags": ["x"]}, "source_dirs": {"ingest": []}}))
    found = settings.load(tmp_path / "c.json")
    assert (found.max_ingest, found.min_tokens, found.excluded_index_tags, found.ingest_dirs) == (10, 3, ("x",), ("atoms",))
    merged = settings.merge({"thresholds": {"a": 1}, "exclude": {"tags": ["x", "y"]}}, {"thresholds": {"a": 2}, "exclude": {"tags": ["y", "z"]}})
    assert merged == {"thresholds": {"a": 2}, "exclude": {"tags": ["x", "y", "z"]}}


def nodes_of(spark, links, note_tags=None):
    names = sorted(set(links) | set(note_tags or {}))
    rows = [(n, f"atoms/{n}", "atoms", (note_tags or {}).get(n, []), sorted(links.get(n, [])), []) for n in names]
    parsed = spark.createDataFrame(rows, "fname string, path string, source_dir string, tags array<string>, links_fm array<string>, links_body array<string>")
    return parsed, graph.nodes(parsed)


def test_duplicate_names(spark):
    rows = [("n.md", "a/n.md", "atoms", ["x"], ["p.md"], []), ("n.md", "b/n.md", "atoms", ["y"], ["q.md", "n.md"], [])]
    parsed = spark.createDataFrame(rows, "fname string, path string, source_dir string, tags array<string>, links_fm array<string>, links_body array<string>")
    assert graph.nodes(parsed).select("path", "tags", "links_out").first()[:] == ("b/n.md", ["y"], ["q.md"])
    assert {r["dst"] for r in graph.edges(parsed).collect()} == {"p.md", "q.md"}


def test_clusters_differ_from_components(spark):
    links = {}
    for k in "ab":
        five = [f"{k}{i}" for i in range(5)]
        for n in five:
            links[n] = [m for m in five if m != n]
    links["a4"].append("b4")
    ring = [f"r{i}" for i in range(6)]
    for i, n in enumerate(ring):
        links[n] = [ring[(i + 1) % 6]]
    links["alone"] = ["missing"]
    _, nodes = nodes_of(spark, links)
    between = graph.links_between(nodes)
    found = components.components(nodes, between)
    by_component = Counter(r["component"] for r in found.collect())
    assert by_component == {"a0": 10, "r0": 6, "alone": 1}
    labels = {r["fname"]: r["cluster"] for r in clusters.clusters(nodes, between, found).collect()}
    order = sorted(links)
    near = {n: {m for m in links[n] if m in links} | {m for m in links if n in links[m]} for n in links}
    assert labels == swept(order, near, 20)
    assert len({labels[f"a{i}"] for i in range(5)}) == 1 and labels["a0"] != labels["b0"]


def test_components_on_random_graphs(spark):
    rng = random.Random(5)
    names = [f"n{i:03}" for i in range(150)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(110)] + [(names[i], names[i + 1]) for i in range(0, 60)]
    above = {n: n for n in names}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        above[max(x, y)] = min(x, y)
    found = components.components(spark.createDataFrame([(n,) for n in names], "fname string"), spark.createDataFrame(pairs, "a string, b string"))
    assert {r["fname"]: r["component"] for r in found.collect()} == {n: top(n) for n in names}


def test_bridges(spark):
    links = {"hub": ["p", "q", "gone"], "p": ["hub"], "q": [], "untagged": ["p", "q", "gone"], "s": ["untagged"]}
    note_tags = {"hub": ["x", "y"], "p": ["z"], "q": ["w"], "untagged": [], "s": []}
    _, nodes = nodes_of(spark, links, note_tags)
    found = analyze.bridges(nodes).collect()
    assert [(r["name"], r["degree"], r["neighbor_tags"], r["overlap"]) for r in found] == [("hub", 4, ["w", "z"], [])]


def test_link_suggestions(spark):
    links = {"a": ["t", "u", "b"], "b": ["t"], "c": ["t", "a"], "d": ["t", "u"]}
    _, nodes = nodes_of(spark, links, {"a": ["k"], "d": ["k"], "b": ["daily-note"]})
    found = {(r["a"], r["b"]): (r["common"], r["jaccard"]) for r in suggest.link_suggestions(nodes, settings.Config()).collect()}
    # b has only an excluded tag; a to c has a link the other way only, which does not matter.
    assert found == {("a", "c"): (1, 0.25), ("a", "d"): (2, 0.6667), ("c", "d"): (1, 0.3333)}
    both = suggest.link_suggestions(nodes, settings.Config(exclude_mode="both"))
    assert ("b", "d") in {(r["a"], r["b"]) for r in both.collect()}


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([("a", ["x", "y", "all"]), ("b", ["x", "z", "all"]), ("c", ["q", "all"])], "fname string, tokens array<string>")
    w = {(r["fname"], r["term"]): r["w"] for r in tfidf.weights(docs).collect()}
    assert w["a", "x"] == 0 and w["a", "all"] < 0 < w["a", "y"]
    assert abs(sum(v * v for (d, _), v in w.items() if d == "c") - 1) < 1e-12
    every = tfidf.similar(tfidf.weights(docs), -1.0).collect()
    assert len(every) == 3


def test_malformed_and_edits(spark):
    rows = [("n.md", "atoms/n.md", "atoms", "---\ntags: [a]\nlinks:\n  - [[x]]\n  - \"[[y]]\"\n  - [[\"z\"]]\n---\n\nbody"), ("m.md", "templates/m.md", "atoms", "no front")]
    notes = spark.createDataFrame(rows, vault.NOTES)
    assert [r["item"] for r in lint.malformed_links(notes).collect()] == ["[[x]]", '[["z"]]']
    parsed = vault.parse(notes)
    added = edit.add_links(parsed, spark.createDataFrame([("n.md", "x"), ("n.md", "new"), ("m.md", "new")], "fname string, target string"))
    assert {r["fname"]: r["change"] for r in added.collect()} == {"n.md": "added links: [[new]]", "m.md": "added links: [[new]]"}
    by_name = {r["fname"]: r["content"] for r in added.collect()}
    assert by_name["n.md"].count('  - "[[x]]"') == 1 and '  - "[[new]]"' in by_name["n.md"] and by_name["n.md"].endswith("---\n\nbody")
    assert by_name["m.md"] == '---\nlinks:\n  - "[[new]]"\n---\n\nno front'
    assert [r["fname"] for r in edit.plan(added, 10).collect()] == ["n.md"]
    with pytest.raises(PermissionError):
        edit.apply(edit.plan(added, 10))
    assert edit.set_project(parsed, spark.createDataFrame([("n.md", "P")], "fname string, project string")).first()["content"].count('project: "[[P]]"') == 1


def test_tag_rules_and_search(spark):
    notes = spark.createDataFrame([("n.md", "atoms/n.md", "atoms", "---\ntags: [Health, daily-note, 2x, face]\n---\n#Спорт ##h")], vault.NOTES)
    found = tags.note_tags(notes, ("daily-note",))
    assert {r["tag"] for r in found.collect()} == {"health", "спорт", "h"}
    assert tags.search(found, "HEALTH").count() == 1
    index = spark.createDataFrame([("a", "x", ["f"]), ("a-b", "y", ["f"]), ("c", None, ["f"])], "tag string, description string, files array<string>")
    assert [r["tag"] for r in tags.consolidated(index).collect()] == ["a-b", "a"]


def test_ingest_limit_is_at_least_one(spark):
    notes = spark.createDataFrame([(f"{k}.md", f"atoms/{k}.md", "atoms", "---\ntags: [NEED-processing]\n---\n") for k in "ba"], vault.NOTES)
    assert [r["fname"] for r in ingest.needs_processing(notes, settings.Config(), n=0).collect()] == ["a.md"]


def test_incremental_index(spark, root, tmp_path):
    out, check = str(tmp_path / "inc"), str(tmp_path / "inc-check")
    incremental.start(spark, root, "atoms", out, check).awaitTermination()
    assert incremental.current(spark, out).filter("tag = 'food'").count() == 1
    time.sleep(1.1)
    path = Path(root) / "atoms/202501010099 Новая.md"
    path.write_text("#fresh", encoding="utf-8")
    os.utime(path)
    incremental.start(spark, root, "atoms", out, check).awaitTermination()
    assert {r["tag"] for r in incremental.current(spark, out).filter(F.col("tag").isin("fresh", "food")).collect()} == {"fresh", "food"}


def swept(names, near, sweeps):
    """Asynchronous label propagation by its definition: a dict of labels, a full count for every node."""
    label = {n: k for k, n in enumerate(sorted(names))}
    for _ in range(sweeps):
        before = dict(label)
        for n in sorted(names):
            votes = {}
            for x in near[n]:
                votes[label[x]] = votes.get(label[x], 0) + 1
            if votes:
                most = max(votes.values())
                label[n] = min(k for k, v in votes.items() if v == most)
        if label == before:
            break
    return label


@pytest.mark.parametrize("seed", range(4))
def test_clusters_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k:03d}.md" for k in range(90)]
    links = {n: set() for n in names}
    for _ in range(60 + 40 * seed):
        a, b = rng.sample(names, 2)
        links[a].add(b)
    links["n000.md"].add("missing.md")
    near = {n: {b for b in links[n] if b in links} | {a for a in names if n in links[a]} for n in names}
    _, held = nodes_of(spark, links)
    between = graph.links_between(held)
    for sweeps in (1, 2, 20):
        found = dict(clusters.clusters(held, between, components.components(held, between), sweeps).select("fname", "cluster").collect())
        assert found == swept(names, near, sweeps)


def test_large_components_are_swept_in_waves(spark, sweeps=3):
    """With a bound that the larger components pass, waves over all tasks give the labels of one chain of decisions."""
    rng = random.Random(11)
    names = [f"n{k:02d}.md" for k in range(30)]
    links = {n: set() for n in names}
    for _ in range(32):
        a, b = rng.sample(names, 2)
        links[a].add(b)
    near = {n: links[n] | {a for a in names if n in links[a]} for n in names}
    _, held = nodes_of(spark, links)
    between = graph.links_between(held)
    found = clusters.clusters(held, between, components.components(held, between), sweeps, most_links=6)
    assert dict(found.select("fname", "cluster").collect()) == swept(names, near, sweeps)


def test_graph_json_round_trip(spark, root):
    held = Vault(spark, root)
    held.reindex()
    nodes, edges = graph_json.read(spark, f"{root}/wiki/data/links-graph.json")
    columns = ["fname", "tags", "links_out", "links_in", "degree_out", "degree_in", "cluster"]
    key = lambda r: r["fname"]
    assert sorted(nodes.select(columns).collect(), key=key) == sorted(held.clustered.select(columns).collect(), key=key)
    assert set(edges.collect()) == set(graph.edges(held.parsed).select("src", "dst").collect())


INGEST = {
    "atoms/202501010010 Графы и базы данных.md": "---\ntags:\n  - need-processing\n  - own\nlinks:\n  - \"[[202501010013 Связь]]\"\nup: \"[[Вверх]]\"\n---\nтекст",
    "atoms/202501010011 Про обход.md": "---\ntags: [graph]\n---\nобход в ширину",  # only the suggested tag leads to it
    "atoms/202501010012 Заметка.md": "---\ntags: [x]\n---\nГде лежат БАЗЫ ДАННЫХ?",  # holds a phrase of the title
    "atoms/202501010013 Связь.md": "---\ntags: [own, graph]\n---\nграфы",  # linked already
    "atoms/202501010014 Другое.md": "---\ntags: [own]\n---\nбазы, затем данных",  # both words, not the phrase
    "daily notes/2025-01-02 графы.md": "---\ntags: [daily-note]\n---\nграфы и базы данных",
    "atoms/202501010021 Базы для сайта.md": "---\ntags: [project]\n---\nплан",
    "projects/Графы базы данных.md": "---\ntags: [p]\n---\n",
}


@pytest.fixture
def ingest_root(tmp_path):
    for name, content in INGEST.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content, encoding="utf-8")
    tags = tmp_path / "wiki/tags"
    tags.mkdir(parents=True)
    (tags / "graph.md").write_text("---\ndescription: Графы, обходы\n---\n\n# #graph\n", encoding="utf-8")
    (tmp_path / "wiki/LOG.md").write_text("## 2024-01-01 00:00\n\nwritten by hand\n", encoding="utf-8")
    return str(tmp_path)


def test_ingest_by_contract(spark, ingest_root):
    """Tags by name and description, candidates by suggested and own tags and by phrases in bodies, no daily notes, projects by their tag."""
    root, name = Path(ingest_root), "202501010010 Графы и базы данных.md"
    note = root / "atoms" / name
    held = Vault(spark, ingest_root)
    held.reindex(at=datetime(2025, 1, 1))
    suggested = held.ingest()
    [row] = suggested.collect()
    assert row["new_tags"] == ["graph"] and row["tags"] == ["need-processing", "own"]
    # Заметка holds "базы данных", "базы" and "данных"; Другое the tag own and two words; Про обход the tag graph; Базы для сайта one word in its title.
    assert row["new_links"] == ["202501010012 Заметка.md", "202501010014 Другое.md", "202501010011 Про обход.md", "202501010021 Базы для сайта.md"]
    assert row["project"] == "202501010021 Базы для сайта.md"
    preview = render.ingest_preview([row]).splitlines()
    assert preview[0] == "| # | Заметка | Текущие теги | Предлагаемые теги | Предлагаемые связи | Проект |"
    assert preview[2].startswith(f"| 1 | [[{name}]] | need-processing, own | graph | [[202501010012 Заметка.md]], ") and preview[2].endswith(" | [[202501010021 Базы для сайта.md]] |")
    with pytest.raises(PermissionError):
        held.apply_ingest(suggested)
    assert "project:" not in note.read_text(encoding="utf-8")
    assert held.apply_ingest(suggested, confirmed=True, at=datetime(2025, 1, 2, 3, 4)) == [f"atoms/{name}"]
    text = note.read_text(encoding="utf-8")
    assert '\nproject: "[[202501010021 Базы для сайта.md]]"\n' in text and '\nup: "[[Вверх]]"\n' in text
    assert '  - "[[202501010013 Связь]]"\n  - "[[202501010012 Заметка.md]]"\n' in text and "  - need-processing\n  - own\n  - graph\n" in text
    assert f"- [[{name}]]" in (root / "wiki/tags/graph.md").read_text(encoding="utf-8")
    log = (root / "wiki/LOG.md").read_text(encoding="utf-8")
    assert log.startswith(f"## 2025-01-02 03:04\n\n**Command:** wiki-ingest\n\n1 notes changed\n\n### Changes\n- atoms/{name}: added tags: graph; added links: [[202501010012 Заметка.md]], ")
    assert "; set project: [[202501010021 Базы для сайта.md]]\n" in log and log.index("wiki-ingest") < log.index("wiki-reindex") < log.index("written by hand")
    again = held.ingest().collect()[0]
    assert again["new_tags"] == [] and again["new_links"] == [] and again["project"] is None


def test_every_command_is_logged(spark, ingest_root):
    held, wiki = Vault(spark, ingest_root), Path(ingest_root) / "wiki"
    before = {p: p.read_bytes() for p in Path(ingest_root).rglob("*.md") if wiki not in p.parents}
    path = held.research_document("graph / теория", at=datetime(2025, 1, 5, 10, 30))
    assert path == wiki / "research/202501051030 graph - теория.md" and 'topic: "graph / теория"' in path.read_text(encoding="utf-8")
    held.lint(at=datetime(2025, 1, 6))
    held.analyze(at=datetime(2025, 1, 7))
    assert {p: p.read_bytes() for p in before} == before
    held.apply_links(spark.createDataFrame([("202501010012 Заметка.md", "202501010011 Про обход.md"), ("202501010013 Связь.md", "x.md")], "a string, b string"), confirmed=True, at=datetime(2025, 1, 8))
    held.reindex(at=datetime(2025, 1, 9))
    commands = [line.split()[1] for line in (wiki / "LOG.md").read_text(encoding="utf-8").splitlines() if line.startswith("**Command:**")]
    assert commands == ["wiki-reindex", "wiki-analyze", "wiki-analyze", "wiki-lint", "wiki-research"]
    assert "- atoms/202501010012 Заметка.md: added links: [[202501010011 Про обход.md]]\n- atoms/202501010013 Связь.md: added links: [[x.md]]\n" in (wiki / "LOG.md").read_text(encoding="utf-8")
    assert held.log.entries().filter("command is not null").count() == 5 and held.log.entries().select("id").distinct().count() == 6


def test_commands(spark, root, capsys):
    from noteloom.__main__ import main

    main(["queue", root], spark)
    shown = capsys.readouterr()
    assert shown.out == "202501010015 Разобрать.md\n" and "Found 1 note(s) with #need-processing in frontmatter (limit 10)." in shown.err
    main(["research", root, "sport"], spark)
    path = Path(capsys.readouterr().out.strip())
    assert path.parent == Path(root) / "wiki/research" and path.name.endswith(" sport.md") and "- [[202501010002 Спорт.md]]" in path.read_text(encoding="utf-8")
    main(["lint", root], spark)
    assert "broken_links: 1" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["research", root], spark)


def test_reports_say_how_much_is_left_out(spark):
    rows = [(3, 12, [], [f"m{k}.md" for k in range(10)]), (10, 3, [("a", 2), ("b", 1)], ["x.md", "y.md", "z.md"]), (4, 12, [], ["q.md"] * 10)]
    report = spark.createDataFrame(rows, "cluster long, size long, top_tags array<struct<tag:string,count:long>>, members array<string>")
    head = render.graph_stats({"components": 1, "giant": 12, "small": 0, "isolated": 0}, [], ["o.md"], 5, [], 3)
    lines = [r["line"] for r in artefacts.stats_lines(head, report, "/p").orderBy("place", "key").collect()]
    assert lines[: len(head)] == head and "- ... и ещё 4" in head and head[-2:] == ["Всего кластеров: 3", ""]
    assert lines[len(head) :] == [
        "### Кластер 3 (размер: 12)", "- Топ-теги: —", "- Заметки: " + ", ".join(f"[[m{k}.md]]" for k in range(10)), "  ... и ещё 2", "",
        "### Кластер 4 (размер: 12)", "- Топ-теги: —", "- Заметки: " + ", ".join(["[[q.md]]"] * 10), "  ... и ещё 2", "",
        "### Кластер 10 (размер: 3)", "- Топ-теги: `a` (2), `b` (1)", "- Заметки: [[x.md]], [[y.md]], [[z.md]]", "",
    ]


def test_frontmatter_map_in_sql(spark):
    from noteloom.functions import text as T

    T.register(spark)
    texts = ["tags:\n  - a\n  - '[[b]]'\nlinks: \"[[x]], [[y]]\"\nempty:\nproject: ' P '\nproject: Q", "a: 1\nnot a field\n- lost\nb:\n\n- one\nb:\n- two", "", None, "k:v:w\nlist: [a, b]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", F.expr(T.fields_sql("t")).alias("x"), F.expr("frontmatter_map(t)").alias("y")).withColumn("keys", F.map_keys("x")).orderBy("k").collect()
    wanted = [{"tags": ["a", "[[b]]"], "links": ["[[x]]", "[[y]]"], "project": ["Q"]}, {"a": ["1"], "b": ["two"]}, {}, None, {"k": ["v:w"], "list": ["[a, b]"]}]
    assert [r["x"] for r in rows] == wanted == [r["y"] for r in rows]
    assert [r["keys"] for r in rows[:2]] == [["tags", "links", "project"], ["a", "b"]]
