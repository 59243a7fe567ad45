"""The vault format, publication of artefacts, and graph snapshots."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from noteloom.plans import artefacts, snapshots
from noteloom.plans.reindex import Vault
from noteloom.sources import graph_json, markdown, vault


@pytest.fixture
def folder(tmp_path):
    for name, data in {"a/x y%20#1.md": "один".encode(), "a/sub/z.md": b"two\r\nthree", "a/bad.md": b"\xff\xfe", "a/no.txt": b"-", "b/x.md": b"", "c/q.md": b"q"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path)


def test_one_listing_serves_notes_names_and_broken_ones(spark, folder):
    markdown.register(spark)
    rows = spark.read.format("vault").option("dirs", "a|b|missing").load(folder)
    found = {r["path"]: (r["fname"], r["source_dir"], r["content"], r["broken"]) for r in rows.collect()}
    assert found == {
        f"{folder}/a/x y%20#1.md": ("x y%20#1.md", "a", "один", False), f"{folder}/a/sub/z.md": ("z.md", "a", "two\r\nthree", False),
        f"{folder}/a/bad.md": ("bad.md", "a", None, True), f"{folder}/b/x.md": ("x.md", "b", "", False),
    }
    for root in (folder, "file:" + folder, "file://" + folder):
        assert {r["fname"]: r["content"] for r in vault.read_notes(spark, root, ("a", "b", "missing")).collect()} == {"x y%20#1.md": "один", "z.md": "two\nthree", "x.md": ""}
        assert [r["fname"] for r in vault.broken(spark, root, ("a",)).collect()] == ["bad.md"]
        assert {tuple(r) for r in vault.list_names(spark, root, ("a", "b")).collect()} == {("x y%20#1.md", "a"), ("bad.md", "a"), ("x.md", "b")}
    assert vault.read_notes(spark, folder, ("missing",)).count() == 0


def test_filters_and_names_open_no_file(folder):
    """Files are taken away after planning: what was ruled out, or is asked for its name only, is not missed."""
    options = {"path": folder, "dirs": "a|b|c", "partitionbytes": "1"}
    names = markdown.VaultReader(options, ["fname", "path", "source_dir"])
    some = markdown.VaultReader(options, ["fname", "path", "source_dir", "content", "broken"])
    other = markdown.EqualTo(("content",), "q")
    assert list(some.pushFilters([markdown.In(("source_dir",), ("b", "c")), markdown.StringStartsWith(("fname",), "q"), other])) == [other]
    plans = names.partitions(), some.partitions()
    assert sum(len(p.files) for p in plans[0]) == 5 and len(plans[0]) > 3 and [f for p in plans[1] for f in p.files] == [(f"{folder}/c/q.md", "q.md", "c")]
    for path in Path(folder).rglob("*.md"):
        if path.name != "q.md":
            path.unlink()
    assert sum(batch.num_rows for p in plans[0] for batch in names.read(p)) == 5
    assert [batch.to_pylist() for p in plans[1] for batch in some.read(p)] == [[{"fname": "q.md", "path": f"{folder}/c/q.md", "source_dir": "c", "content": "q", "broken": False}]]


def test_filters_reach_the_listing(spark, folder, capsys):
    rows = markdown.read(spark, folder, ("a", "b", "c")).filter("source_dir = 'c' AND fname LIKE 'q%'")
    assert [r["content"] for r in rows.collect()] == ["q"]
    rows.explain("formatted")
    assert "Pushed" in capsys.readouterr().out


def test_writing_through_tasks(spark, folder):
    rows = spark.createDataFrame([(f"{folder}/new/n {k}.md", f"текст {k}") for k in range(20)] + [(f"{folder}/a/sub/z.md", "again")], "path string, content string")
    markdown.write(rows.repartition(5))
    assert {p.name: p.read_text(encoding="utf-8") for p in Path(folder, "new").iterdir()} == {f"n {k}.md": f"текст {k}" for k in range(20)}
    assert Path(folder, "a/sub/z.md").read_text() == "again"
    lines = spark.range(50_000).select(F.lit(f"file:{folder}/big.md").alias("path"), (F.col("id") % 7).cast("int").alias("place"), F.lpad(F.col("id").cast("string"), 6, "0").alias("key"), F.concat(F.lit("- "), F.col("id").cast("string")).alias("line"))
    markdown.write(lines)
    assert Path(folder, "big.md").read_text() == "".join(f"- {k}\n" for p in range(7) for k in range(p, 50_000, 7))
    markdown.delete(spark.createDataFrame([(f"{folder}/big.md",), (f"{folder}/none.md",)], "path string"))
    assert not Path(folder, "big.md").exists()


def test_a_failed_write_leaves_nothing(spark, folder):
    Path(folder, "file").write_text("in the way")
    rows = spark.createDataFrame([(f"{folder}/new/{k}.md", "x") for k in range(8)] + [(f"{folder}/file/y.md", "no folder")], "path string, content string")
    with pytest.raises(Exception, match="file"):
        markdown.write(rows.repartition(4))
    assert not Path(folder, "new").exists() or [p for p in Path(folder, "new").iterdir() if p.suffix == ".md"] == []


def test_only_what_differs_is_published(spark, tmp_path):
    def lines(texts):
        return spark.createDataFrame([(f"{tmp_path}/t/{name}.md", k, "", line) for name, text in texts.items() for k, line in enumerate(text)], artefacts.LINES)

    there = lambda: vault.read_notes(spark, str(tmp_path), ("t",)).select("path", "content")
    assert artefacts.publish(lines({"a": ["1", ""], "b": ["2"], "c": [""]}), there()) == artefacts.Published(3, 3, 0)
    old = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t").iterdir()}
    assert artefacts.publish(lines({"a": ["1", ""], "b": ["2"], "c": [""]}), there()) == artefacts.Published(3, 0, 0)
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t").iterdir()} == old
    (tmp_path / "t/c.md").write_text("by hand")
    assert artefacts.publish(lines({"a": ["1", "", "x"], "c": [""]}), there()) == artefacts.Published(2, 2, 1)
    assert {p.name: p.read_text() for p in (tmp_path / "t").iterdir()} == {"a.md": "1\n\nx\n", "c.md": "\n"}


def test_long_lists_are_rows(spark, tmp_path):
    """A tag of very many notes is written in the order of names, and no row holds more than one of them."""
    held = spark.range(120_000).select(F.when(F.col("id") % 1000 == 0, "rare/x").otherwise("hot").alias("tag"), F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(".md")).alias("fname"))
    described = spark.createDataFrame([("hot", "d"), ("rare/x", None)], "tag string, description string")
    lines = artefacts.tag_lines(held, described, f"{tmp_path}/tags")
    assert "array" not in lines.schema.simpleString() and "collect" not in lines._jdf.queryExecution().optimizedPlan().toString()
    artefacts.publish(lines, spark.createDataFrame([], "path string, content string"))
    names = sorted(f"n{k}.md" for k in range(120_000) if k % 1000)
    assert (tmp_path / "tags/hot.md").read_text() == "---\ndescription: d\n---\n\n# #hot\n\n" + "".join(f"- [[{n}]]\n" for n in names)
    assert (tmp_path / "tags/rare%2Fx.md").read_text().startswith("# #rare/x\n\n- [[n0.md]]\n- [[n1000.md]]\n")


def test_a_reader_sees_one_version(spark, tmp_path):
    table = lambda k: tuple(spark.createDataFrame([(k,)], "k int") for _ in range(3))
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, tmp_path)
    snapshots.publish(tmp_path, *table(1))
    before = snapshots.read(spark, tmp_path)
    broken = spark.createDataFrame([(1,)], "k int").select(F.raise_error(F.lit("stop")).alias("k"))
    with pytest.raises(Exception, match="stop"):
        snapshots.publish(tmp_path, table(2)[0], broken, table(2)[2])
    assert [t.first()["k"] for t in snapshots.read(spark, tmp_path)] == [1, 1, 1]  # the pointer did not move
    for k in (3, 4):
        snapshots.publish(tmp_path, *table(k), keep=4)
        assert [t.first()["k"] for t in before] == [1, 1, 1] and [t.first()["k"] for t in snapshots.read(spark, tmp_path)] == [k] * 3
    for k in range(5, 9):
        snapshots.publish(tmp_path, *table(k), keep=2)
    assert snapshots.publish(tmp_path, *table(8)) == (snapshots.current(tmp_path), False)  # as it is already
    assert len(snapshots.versions(tmp_path)) == 2 and snapshots.current(tmp_path) == snapshots.versions(tmp_path)[-1]


def test_graph_of_a_vault_as_snapshot_and_json(spark, tmp_path):
    for name, text in {"a": "[[b]] [[c]]", "b": "[[a]]", "c": "", "d \"q\"": "[[none]]"}.items():
        (tmp_path / "atoms").mkdir(exist_ok=True)
        (tmp_path / f"atoms/{name}.md").write_text(text)
    Vault(spark, str(tmp_path)).reindex()
    old = {p: p.stat().st_mtime_ns for p in (tmp_path / "wiki").rglob("*") if p.is_file() and "oplog" not in p.parts and p.name != "LOG.md"}
    Vault(spark, str(tmp_path)).reindex()
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "wiki").rglob("*") if p.is_file() and "oplog" not in p.parts and p.name != "LOG.md"} == old  # only the log grew
    nodes, edges, totals = snapshots.read(spark, tmp_path / "wiki")
    data = json.loads((tmp_path / "wiki/data/links-graph.json").read_text())
    assert data["stats"] == totals.first().asDict() and len(data["edges"]) == edges.count() == 4
    assert list(data["nodes"]) == sorted(r["fname"] for r in nodes.collect()) and data["nodes"]["a.md"]["links_out"] == ["b.md", "c.md"]
    odd = tmp_path / "other.json"
    odd.write_text(json.dumps({"nodes": data["nodes"], "edges": data["edges"]}, indent=1))
    for path in (tmp_path / "wiki/data/links-graph.json", odd):
        read, links = graph_json.read(spark, str(path))
        assert {r["fname"]: (r["links_out"], r["degree_in"], r["cluster"]) for r in read.collect()} == {r["fname"]: (r["links_out"], r["degree_in"], r["cluster"]) for r in nodes.collect()}
        assert sorted(tuple(r) for r in links.collect()) == sorted((r["src"], r["dst"]) for r in edges.collect())
    members = {}
    for r in nodes.orderBy("fname").collect():
        members.setdefault(str(r["cluster"]), []).append(r["fname"])
    assert data["clusters"] == members
