"""Pairs under common keys, the thresholded cosine join, phrases in notes and keywords in tags, against brute force."""

import math
import random
import tracemalloc
from collections import Counter
from itertools import combinations

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noteloom import config as settings
from noteloom.operators import graph, pairs, phrases, postings, research, suggest, tfidf
from noteloom.sources import vault


@pytest.mark.parametrize("block", [1, 3, 50])
def test_every_pair_of_a_key_meets_once(spark, block):
    rows = [("hot", k, k * 10) for k in range(40)] + [("two", 1, 1), ("two", 7, 2), ("one", 3, 3)]
    met = pairs.meeting(spark.createDataFrame(rows, "k string, id long, v long"), "k", "id", ("v",), block)
    found = Counter((r["k"], r["x_id"], r["y_id"], r["x_v"], r["y_v"]) for r in pairs.ordered(met, "id", ("v",)).collect())
    wanted = Counter((k, a, b, u, v) for (k, a, u), (m, b, v) in combinations(sorted(rows), 2) if k == m)
    assert found == wanted


def test_a_hub_of_many_linkers_is_worked_on_by_many_tasks(spark):
    """100,000 linkers of one target are cut into cells of which none holds more than a few thousand rows a side."""
    rows = spark.range(100_000).select(F.lit("hub").alias("dst"), "id")
    counts = rows.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).first()["n"]
    blocks = math.ceil(counts / pairs.BLOCK)
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b")).groupBy("b").count().agg(F.max("count"), F.count("*")).first()
    assert dealt[1] == blocks == 50 and dealt[0] < 1.2 * pairs.BLOCK
    met = pairs.meeting(rows.filter("id < 6000"), "dst", "id")
    assert met.count() == 6000 * 5999 // 2
    sizes = met.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1


def test_link_counts_of_random_graphs(spark):
    rng = random.Random(3)
    names = [f"n{k}.md" for k in range(60)]
    links = {n: sorted({rng.choice(names + ["hub.md", "hub.md"]) for _ in range(rng.randint(0, 6))} - {n}) for n in names}
    parsed = spark.createDataFrame([(n, f"atoms/{n}", "atoms", [], links[n], []) for n in names], "fname string, path string, source_dir string, tags array<string>, links_fm array<string>, links_body array<string>")
    nodes = graph.nodes(parsed)
    found = {(r["a"], r["b"]): (r["common"], r["jaccard"], r["shared_neighbors"]) for r in suggest.link_pairs(nodes, settings.Config()).collect()}
    wanted = {}
    for a, b in combinations(sorted(names), 2):
        both = sorted(set(links[a]) & set(links[b]))
        if both and b not in links[a]:
            wanted[a, b] = (len(both), round(len(both) / len(set(links[a]) | set(links[b])), 4), both[:5])
    assert {k: v[::2] for k, v in found.items()} == {k: v[::2] for k, v in wanted.items()}
    assert all(abs(found[k][1] - wanted[k][1]) <= 1e-4 for k in wanted)


@pytest.mark.parametrize("carried", [0, 2, 4, 64])
def test_link_pairs_are_finished_where_they_meet(spark, monkeypatch, carried):
    """Short and long notes agree with all pairs; pairs of short ones are not dealt again."""
    monkeypatch.setattr(suggest, "CARRIED", carried)
    rng = random.Random(4)
    names = [f"n{k:02}.md" for k in range(40)]
    links = {n: sorted({rng.choice([*names, "hub.md", "hub.md"]) for _ in range(rng.randint(0, 7))} - {n}) for n in names}
    dirs = {n: "daily notes" if k % 7 == 0 else "atoms" for k, n in enumerate(names)}
    parsed = spark.createDataFrame([(n, f"{dirs[n]}/{n}", dirs[n], [], links[n], []) for n in names], "fname string, path string, source_dir string, tags array<string>, links_fm array<string>, links_body array<string>")
    for mode, drop in (("either", lambda a, b: "daily notes" in (dirs[a], dirs[b])), ("both", lambda a, b: dirs[a] == dirs[b] == "daily notes")):
        counts = suggest.link_counts(graph.nodes(parsed), settings.Config(exclude_mode=mode))
        found = sorted((r["a"], r["b"], r["common"], round(r["jaccard"], 3)) for r in counts.collect())
        wanted = []
        for a, b in combinations(names, 2):
            both = set(links[a]) & set(links[b])
            if both and b not in links[a] and not drop(a, b):
                wanted.append((a, b, len(both), len(both) / len(set(links[a]) | set(links[b]))))
        assert [x[:3] for x in found] == [x[:3] for x in wanted] and all(abs(x[3] - y[3]) < 1e-3 for x, y in zip(found, wanted))
    if carried == 64:
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan.split("Join")[0] and plan.count("Join Inner") == 3 and "LeftAnti" not in plan


def made_docs(rng, n):
    """Documents of a few topics with common words everywhere."""
    out = []
    for k in range(n):
        topic = rng.randrange(12)
        words = [f"t{topic}w{int(rng.expovariate(0.08))}" for _ in range(rng.randint(5, 60))] + [f"c{int(rng.expovariate(0.1))}" for _ in range(rng.randint(5, 60))]
        out.append((f"d{k:04}", words))
    return out


@pytest.mark.parametrize("least", [0.1, 0.3, 0.7])
def test_cosine_join_is_exact_and_forms_few_pairs(spark, least):
    docs = made_docs(random.Random(int(least * 10)), 250)
    held = tfidf.weights(spark.createDataFrame(docs, "fname string, tokens array<string>"))
    vectors = {}
    for r in held.collect():
        vectors.setdefault(r["fname"], {})[r["term"]] = r["w"]
    wanted, shared = {}, 0
    for a, b in combinations(sorted(vectors), 2):
        dot = sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items())
        shared += any(t in vectors[b] for t in vectors[a])
        if dot >= least + 1e-9:
            wanted[a, b] = dot
    found = {(r["a"], r["b"]): r["similarity"] for r in tfidf.similar(held, least).collect()}
    assert set(wanted) <= set(found) and all(abs(found[k] - wanted[k]) <= 1e-4 for k in wanted)
    assert all(k in wanted or found[k] <= least + 1e-4 for k in found)
    entries, _ = tfidf._entries(held, tfidf.PREFIX * least)
    tried = tfidf.candidates(entries, least).count()
    assert len(found) <= tried <= max(shared / 4, 2.5 * len(found))


@pytest.mark.parametrize("block, tile, dense, columns, listed", [(64, 16, 0.01, 8, 100), (1000, 1000, 2.0, 8, 1 << 20), (100, 7, 0.0, 3, 10)])
def test_blocks_of_notes_make_the_same_pairs_and_deal_none(spark, monkeypatch, block, tile, dense, columns, listed):
    """Pairs of blocks agree with all pairs, however terms are dealt with, and nothing is dealt after blocks have met."""
    for name, value in (("BLOCK", block), ("TILE", tile), ("DENSE", dense), ("COLUMNS", columns), ("LISTED", listed)):
        monkeypatch.setattr(tfidf, name, value)
    docs = made_docs(random.Random(5), 250)
    docs += [(f"copy{k}", docs[7][1]) for k in range(20)]
    held = tfidf.weights(spark.createDataFrame(docs, "fname string, tokens array<string>"))
    vectors = {}
    for r in held.collect():
        vectors.setdefault(r["fname"], {})[r["term"]] = r["w"]
    links = [("d0007", "copy3"), ("d0001", "copy3"), ("d0001", "gone"), *[(f"d{k:04}", f"d{k + 1:04}") for k in range(0, 200, 3)]]
    every = {(a, b) for a, b in links} | {(b, a) for a, b in links}
    wanted = {(a, b): sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items()) for a, b in combinations(sorted(vectors), 2) if (a, b) not in every}
    met = tfidf.cells(held, 0.3, spark.createDataFrame(sorted(every), "a string, b string"))
    found = [(r["a"], r["b"], r["similarity"]) for r in met.collect()]
    assert sorted((a, b) for a, b, _ in found) == sorted(k for k, s in wanted.items() if s >= 0.3)
    assert all(abs(s - wanted[a, b]) <= 1e-4 for a, b, s in found)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan.split("CartesianProduct")[0]


def as_block(number, notes, linked=()):
    """A block of notes {name: {term: weight}}, as a task gets it."""
    rows = [(number, name, term, w) for name, held in notes.items() for term, w in held.items()]
    made = [pa.table(dict(zip(names, map(list, zip(*rows)) if rows else [[]] * len(names)))) for names, rows in ((("block", "fname", "term", "w"), rows), (("block", "a", "b"), [(number, *x) for x in linked]))]
    made[1] = made[1].cast(pa.schema({"block": pa.int32(), "a": pa.string(), "b": pa.string()}))
    row = tfidf._block((number,), *made)
    return {c: v.values if isinstance(v := row[c][0], pa.ListScalar) else v.as_py() for c in row.column_names}


def test_listed_pairs_of_terms_need_no_more_room_than_a_tile():
    """Two blocks of 1,500 notes list four million products, at most LISTED of them at once."""
    rng = random.Random(8)
    x, y = (as_block(k, {f"n{k}-{i:04}": {f"t{t}": 0.1 for t in rng.sample(range(2000), 60)} for i in range(1500)}) for k in (0, 1))
    tracemalloc.start()
    found = sum(len(s) for _, _, s in tfidf._met(x, y, 0.05))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 10_000 and peak < 30_000_000


def test_a_block_holds_each_weight_once():
    """What blocks take of the disk beside names and words is little more than their weights."""
    rng = random.Random(9)
    x = as_block(0, {f"n{i:04}": {f"t{t}": 0.1 for t in rng.sample(range(500), 60)} for i in range(1000)})
    assert sum(len(v) for v in x.values() if isinstance(v, bytes)) < 1.3 * 8 * 60_000


def test_pairs_leave_the_task_named_in_order_and_rounded_as_in_sql(spark):
    """Nothing is left to do for a pair after its task: names stand in order, whatever their block, and halves are rounded up."""
    x = as_block(0, {"b": {"t": 0.5}, "é": {"t": 1.0}, "d": {"t": 0.30005}, "Z": {"t": 0.7}}, [("b", "c")])
    y = as_block(1, {"a": {"t": 1.0}, "c": {"t": 0.62345}, "😀": {"t": 0.9}})
    found = [tuple(r.values()) for one, other in ((x, y), (x, x), (y, y)) for batch in tfidf._named(one, other, 0.2) for r in batch.to_pylist()]
    w = {"b": 0.5, "é": 1.0, "d": 0.30005, "Z": 0.7, "a": 1.0, "c": 0.62345, "😀": 0.9}
    pairs_ = [(a, b) for a, b in combinations(sorted(w), 2) if (a, b) != ("b", "c") and w[a] * w[b] >= 0.2]
    sql = duckdb.execute("SELECT list(round(s, 4)) FROM (SELECT unnest($1::DOUBLE[]) AS s)", [[w[a] * w[b] for a, b in pairs_]]).fetchone()[0]
    assert sorted(found) == [(a, b, s) for (a, b), s in zip(pairs_, sql)]
    held = spark.createDataFrame([("x", "t", 2, 0.5), ("y", "t", 2, 0.5)], "fname string, term string, df long, w double")
    plan = tfidf.cells(held, 0.2, spark.createDataFrame([], "a string, b string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("MapInArrow")


def test_rare_and_common_terms_weigh_alike(spark, monkeypatch):
    """Weights do not depend on which terms every task gets; terms and notes are not dealt together with all their tokens twice."""
    docs = spark.createDataFrame([*made_docs(random.Random(9), 60), ("none", []), ("null", None)], "fname string, tokens array<string>")
    whole = {(r["fname"], r["term"]): (r["df"], r["w"]) for r in tfidf.weights(docs).collect()}
    lengths = Counter()
    for (fname, _), (_, w) in whole.items():
        lengths[fname] += w * w
    assert len(lengths) == 60 and all(abs(x - 1) < 1e-9 for x in lengths.values())
    plan = tfidf.weights(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    monkeypatch.setattr(tfidf, "MOST_TERMS", 30)
    parts = {(r["fname"], r["term"]): (r["df"], r["w"]) for r in tfidf.weights(docs).collect()}
    assert parts.keys() == whole.keys() and all(parts[k][0] == d and abs(parts[k][1] - w) < 1e-12 for k, (d, w) in whole.items())


def test_the_whole_corpus_is_that_of_the_nodes(spark):
    """Of files with equal names the one with the largest path counts, excluded and short notes have no tokens."""
    long = " ".join(f"word{k}" for k in range(60))
    rows = [("a.md", "atoms/1/a.md", "atoms", long), ("a.md", "atoms/2/a.md", "atoms", long.replace("word", "term")), ("b.md", "atoms/b.md", "atoms", "short"), ("c.md", "daily notes/c.md", "daily notes", long)]
    rows += [("d.md", "atoms/d.md", "atoms", "---\ntags: daily-note\n---\n" + long), ("e.md", "atoms/e.md", "atoms", long), ("f.md", "atoms/f.md", "atoms", None)]
    notes = spark.createDataFrame(rows, vault.NOTES)
    config = settings.Config(max_semantic_notes=None)
    nodes = graph.nodes(vault.parse(notes))
    plain = {r["fname"]: r["tokens"] for r in tfidf.corpus(nodes, notes, config).collect() if r["tokens"]}
    whole = {r["fname"]: r["tokens"] for r in tfidf.whole_corpus(vault.parse(notes), config).collect() if r["tokens"]}
    assert whole == plain and set(whole) == {"a.md", "e.md"} and whole["a.md"][0] == "term0"


def test_all_pairs_are_refused_beyond_a_bound(spark, monkeypatch):
    held = spark.createDataFrame([("a", "t", 2, 1.0), ("b", "t", 2, 1.0), ("c", "u", 1, 1.0)], "fname string, term string, df long, w double")
    assert tfidf.similar(held, 0.0).count() == 3
    monkeypatch.setattr(tfidf, "ALL_PAIRS", 2)
    with pytest.raises(ValueError, match="above 0"):
        tfidf.similar(held, -0.5)


def test_phrases_stand_in_title_or_body_term_by_term(spark):
    notes = [
        ("202501010001 Теория графов.md", "---\ntags: [a]\n---\nо графах"),
        ("b.md", "Большие ДАННЫЕ и теория графов, данные; теория\nграфов"),
        ("c.md", "теория, потом графов"),
        ("d теория.md", "графов"),  # a phrase does not run from the title into the body
        ("e.md", "метатеория графов"),
        ("e.md", None),
    ]
    held = spark.createDataFrame([(n, f"atoms/{k}/{n}", "atoms", c) for k, (n, c) in enumerate(notes)], vault.NOTES)
    titles = spark.createDataFrame([("202501010009 Теория графов и данные.md",), ("202501010010 и в.md",)], "fname string")
    wanted = phrases.key_phrases(titles)
    assert {r["phrase"] for r in wanted.collect()} == {"теория графов", "теория", "графов", "данные"}
    found = {}
    for r in phrases.holders(held, wanted).collect():
        found.setdefault(r["phrase"], set()).add(r["fname"])
    assert found == {"теория графов": {"202501010001 Теория графов.md", "b.md"}, "теория": {"202501010001 Теория графов.md", "b.md", "c.md", "d теория.md"}, "графов": {"202501010001 Теория графов.md", "b.md", "c.md", "d теория.md", "e.md"}, "данные": {"b.md"}}


def test_places_of_few_and_of_many_terms(spark, monkeypatch):
    """Few wanted terms are picked inside a note's row, with the places that the join by term gives."""
    notes = spark.createDataFrame([("a b.md", "x/a b.md", "x", "b c\na"), ("c.md", "x/c.md", "x", "---\nq: a\n---\nA-b a"), ("d.md", "x/d.md", "x", None)], vault.NOTES)
    wanted = spark.createDataFrame([("a",), ("c",), ("md",)], "term string")
    few = phrases.postings(notes, wanted)
    assert "Join" not in few._jdf.queryExecution().optimizedPlan().toString()
    found = sorted(tuple(r[c] for c in ("term", "path", "place")) for r in few.collect())
    assert found == [("a", "x/a b.md", 0), ("a", "x/a b.md", 5), ("a", "x/c.md", 3), ("c", "x/a b.md", 4), ("c", "x/c.md", 0)]
    monkeypatch.setattr(phrases, "FEW_TERMS", 2)
    assert sorted(tuple(r[c] for c in ("term", "path", "place")) for r in phrases.postings(notes, wanted).collect()) == found


def test_posting_lists_in_chunks(spark):
    """Chunks do not depend on how rows are dealt, hold at most their number of names, and pages open only what they need."""
    rng = random.Random(6)
    lists = {"hot": sorted(f"n{k:05}" for k in range(2345)), "mid": sorted({f"m{rng.randrange(500)}" for _ in range(300)}), "one": ["x"]}
    rows = spark.createDataFrame([(k, n) for k, names in lists.items() for n in names] + [("one", "x")], "key string, name string")
    for dealt in (rows.repartition(1), rows.repartition(7)):
        chunks = postings.build(dealt, chunk=100)
        held = {(r["key"], r["chunk"]): (r["n"], r["first"], r["last"], r["names"]) for r in chunks.collect()}
        wanted = {(k, i // 100): (len(p), p[0], p[-1], p) for k, names in lists.items() for i in range(0, len(names), 100) if (p := names[i : i + 100])}
        assert held == wanted
    assert {tuple(r) for r in postings.directory(chunks).collect()} == {(k, -(-len(v) // 100), len(v), v[0], v[-1]) for k, v in lists.items()}
    assert [r["name"] for r in postings.page(chunks, "hot", 195, 120, chunk=100).collect()] == lists["hot"][195:315]
    assert sorted(r["name"] for r in postings.between(chunks, "mid", "m2", "m33").collect()) == [n for n in lists["mid"] if "m2" <= n <= "m33"]
    assert postings.build(rows.limit(0)).count() == 0


def test_keywords_inside_tags(spark):
    rng = random.Random(8)
    texts = [(f"t{k}", "".join(rng.choice("abAB ё") for _ in range(rng.randint(0, 12)))) for k in range(200)]
    keywords = ["a", "ab", "ABA", "babab", "ё", "zz", " a", "aaaaaaa"]
    found = phrases.containing(spark.createDataFrame([(w,) for w in keywords], "keyword string"), spark.createDataFrame(texts, "key string, text string"))
    assert {tuple(r) for r in found.collect()} == {(w.lower(), k) for w in keywords for k, t in texts if w.lower() in t.lower()}


def test_many_topics_agree_with_one_at_a_time(spark):
    index = spark.createDataFrame([("здоровье", "питание и спорт"), ("sport", None), ("graph-theory", "Графы"), ("x", "")], "tag string, description string")
    topics = ["спорт и графы", "graph sport", "ничего", "theo"]
    many = {}
    for r in research.matching_tags_of(index, spark.createDataFrame([(t,) for t in topics], "topic string")).orderBy("topic", "rank").collect():
        many.setdefault(r["topic"], []).append((r["tag"], r["score"]))
    for topic in topics:
        assert many.get(topic, []) == [tuple(r) for r in research.matching_tags(index, topic).collect()]
