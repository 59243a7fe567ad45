"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import os
import random
from collections import Counter

import numpy as np
import pytest

from noteloom.llm import gif, lines, mixing, packing, quality, queries, secrets, simhash, substring, toxicity, warc
from noteloom.llm.common import table
from tests.conftest import SF

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6))) for _ in range(400)]


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def copies(spark):
    """Texts with shared passages, exact and near copies, and runs of one word."""
    passage, base = text(45), text(300)
    rows = [text(RNG.randint(1, 200)) for _ in range(60)]
    rows += [f"{text(20)} {passage} {text(15)}" for _ in range(8)] + [base, base, base.upper()]
    for _ in range(12):
        words = base.split()
        for _ in range(RNG.randint(1, 9)):
            words[RNG.randrange(len(words))] = RNG.choice(WORDS)
        rows.append(" ".join(words))
    rows += ["go " * 70, "go " * 33 + "stop", "a b " * 40, "b a " * 40]
    RNG.shuffle(rows)
    return dict(enumerate(rows))


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)


def covered(rows, width):
    first, out = {}, {}
    for key in sorted(rows):
        words = rows[key].split()
        gone = set()
        for at in range(len(words) - width + 1):
            window = tuple(words[at : at + width])
            if first.setdefault(window, (key, at)) != (key, at):
                gone.update(range(at, at + width))
        out[key] = " ".join(w for k, w in enumerate(words) if k not in gone)
    return out


@pytest.mark.parametrize("width", [8, 20])
def test_substring(spark, copies, width, monkeypatch):
    monkeypatch.setattr(substring, "AT_ONCE", 100)
    found = {r["doc_id"]: r["kept"] for r in substring.strip(frame(spark, copies), width).collect()}
    assert found == covered(copies, width)


def test_names_are_sure():
    """A name that depends on words of a window only arises wherever the window does."""
    words = np.array([RNG.randrange(1, 40) for _ in range(60)], np.uint64)
    around = [np.array([RNG.randrange(1, 40) for _ in range(n)], np.uint64) for n in (0, 7, 13)]
    seen = []
    for before in around:
        whole = np.concatenate([before, words, before])
        name, _, low, high = substring.names(whole, np.zeros(len(whole), np.int64))
        inside = (low >= len(before)) & (high <= len(before) + len(words))
        seen.append(set(zip(name[inside].tolist(), (low[inside] - len(before)).tolist(), strict=True)))
    assert seen[0] == seen[1] == seen[2] and seen[0]


def test_lines(spark):
    base = [RNG.sample(WORDS, RNG.randint(4, 25)) for _ in range(40)]
    rows = {}
    for key in range(80):
        held = []
        for _ in range(RNG.randint(0, 8)):
            words = list(RNG.choice(base))
            for _ in range(RNG.randint(0, 4)):
                words[RNG.randrange(len(words))] = RNG.choice(WORDS)
            RNG.shuffle(words)
            held.append(" ".join(words))
        rows[key] = "\n".join(held)
    earlier, wanted = [], {}
    for key in sorted(rows):
        for k, line in enumerate(rows[key].split("\n")):
            mine = set(line.split())
            if len(mine) >= lines.LEAST and len(line.split()) >= lines.LEAST:
                if any(len(mine & x) >= 0.8 * len(mine | x) - 1e-9 for x in earlier):
                    wanted.setdefault(key, []).append(k)
                earlier.append(mine)
    found = {r["doc_id"]: r["lines"] for r in lines.later_matches(frame(spark, rows)).collect()}
    assert found == wanted and wanted


def test_short_lines_match_too(spark):
    rows = {1: "All rights reserved.\nx\n\na b c d\na a a a a a", 2: "reserved. All rights\nx x\n\na b c d e\na", 3: "All rights\n \ny\nb c d e", 4: "All rights reserved.\n\nx"}
    found = {r["doc_id"]: r["lines"] for r in lines.later_matches(frame(spark, rows)).collect()}
    assert found == {2: [0, 1, 3, 4], 3: [3], 4: [0, 2]}


def test_simhash_index_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    prints = np.unique(np.concatenate([prints, prints[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)), prints[:200] ^ np.uint64(0x8000000000000001)]))
    apart = np.bitwise_count(prints[:, None] ^ prints[None])
    q, p = simhash.GrayIndex(prints).search(prints, 3)
    assert set(zip(q.tolist(), p.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(apart <= 3)), strict=True))
    frame_ = spark.createDataFrame(list(enumerate(prints.view(np.int64).tolist())), "id long, fingerprint long")
    from noteloom.llm.links import components

    found = dict(components(simhash.links(frame_, 2, len(prints), per_block=50)).collect())
    label = simhash.least_labels(len(prints), *np.nonzero(apart <= 2))
    assert [found.get(k, k) for k in range(len(prints))] == label.tolist()


def test_simhash_fingerprint_is_the_rule():
    import xxhash

    for words in ([], ["a"], ["A", "b"], ["A", "b", "c", "d", "b", "c", "d"]):
        line = " ".join(words)
        shingles = [" ".join(words[k : k + 3]).lower() for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(simhash.shingle_hashes(line, 3)) == want


def test_near_groups_find_near_copies(spark, copies):
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(frame(spark, copies)).collect()}
    sets = {k: set(simhash.shingle_hashes(v, 5).tolist()) for k, v in copies.items()}
    pairs = [(a, b, len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))) for a in sets for b in sets if a < b]
    close = [found[a] == found[b] for a, b, j in pairs if j >= 0.9]
    assert close and sum(close) >= 0.95 * len(close)
    assert not any(found[a] == found[b] for a, b, j in pairs if j < 0.3 and len(sets[a]) > 20 and len(sets[b]) > 20)


def test_near_groups_verify_similarity(spark):
    """Pairs just above the limit are linked and pairs just below it are not."""
    rng, rows = random.Random(5), {}
    for k in range(150):
        words = [f"{k}w{i}" for i in range(304)]
        other = list(words)
        # n replaced words far apart spoil 5 shingles each: of 300, a Jaccard similarity of (300 - 5n) / (300 + 5n)
        for at in rng.sample(range(5, 299, 6), 6 if k % 2 else 8):
            other[at] = "new" + other[at]
        rows[2 * k], rows[2 * k + 1] = " ".join(words), " ".join(other)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(frame(spark, rows)).collect()}
    assert not any(found[2 * k] == found[2 * k + 1] for k in range(0, 150, 2))  # 0.76
    assert sum(found[2 * k] == found[2 * k + 1] for k in range(1, 150, 2)) >= 73  # 0.82


def best_fit(counts, size):
    """Sequences that best-fit decreasing needs."""
    gaps, n = Counter(), 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:
                gap, n = size, n + 1
            else:
                gaps[gap] -= 1
                gaps += Counter()
            if gap > length:
                gaps[gap - length] += 1
    return n


def held_by_sequence(slots, counts):
    places, used = {}, Counter()
    for length, rank, n, first, offset in slots:
        assert rank == used[length]
        used[length] += n
        for k in range(n):
            places.setdefault(first + k, []).append((offset, length))
    assert used == Counter(counts)
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    return places


@pytest.mark.parametrize("seed", range(20))
def test_plans_need_no_more_sequences_than_best_fit(seed):
    rng = random.Random(seed)
    if seed % 2:
        counts = Counter(rng.randint(1, 1024) for _ in range(1500))
    else:
        counts = Counter(min(1024, max(1, int(rng.lognormvariate(5 + seed / 20, 1)))) for _ in range(2500))
    assert len(held_by_sequence(packing.plan_slots(dict(counts), 1024), counts)) <= best_fit(counts, 1024)


def test_plans_fill_gaps_exactly():
    for counts, least in (({1024: 5, 1000: 3, 24: 9}, 9), ({600: 10}, 10), ({512: 3}, 2), ({1: 5000}, 5), ({}, 0)):
        assert len(held_by_sequence(packing.plan_slots(dict(counts), 1024), counts)) == least
    # One piece more, two more, and three to a sequence: all are filled to the last token.
    for counts, least in (({1000: 7, 24: 7}, 7), ({900: 4, 100: 4, 24: 4}, 4)):
        places = held_by_sequence(packing.plan_slots(dict(counts), 1024), counts)
        assert len(places) == least and all(sum(n for _, n in held) == 1024 for held in places.values())


def test_sums_look_combinations_up():
    sums = packing.Sums({300: 1, 200: 2, 100: 1, 50: 3}, 1024)
    assert sums.filling(300, 300) == (300,) and sums.filling(300, 400) == (300, 100) and sums.filling(300, 550) == (300, 200, 50)
    assert sums.filling(200, 400) == (200, 200) and sums.filling(300, 401) is None
    sums.use(200, 1)
    assert sums.filling(200, 400) is None and sums.filling(300, 550) == (300, 200, 50)
    sums.use(200, 1)
    assert sums.filling(300, 550) is None and sums.pair(100) == (50, 50) and sums.filling(300, 400) == (300, 100)
    sums.use(100, 1)
    assert sums.filling(300, 400) == (300, 50, 50)


def test_packed_pieces_lie_gapless(spark):
    rng = random.Random(2)
    rows = [(k, j, rng.choice([1024, 1000, 24, 3, 700, rng.randint(1, 1024)])) for k in range(700) for j in range(rng.randint(1, 2))]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long").withColumn("start", packing.F.lit(0))
    found = packing.pack(pieces, 1024).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in found) == Counter(rows)
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 1024
    assert len(places) <= best_fit(Counter(n for *_, n in rows), 1024)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    files = queries.tokenizer_files()
    docs = table(spark, SF, "documents")
    tokenizer = Tokenizer.from_file(files["vocabulary"])
    rows = packing.pack_documents(docs, **files).collect()
    import zlib

    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    odd = {r["doc_id"]: r["text"] for r in docs.collect()}
    for key, value in odd.items():
        ids = np.array([*tokenizer.encode(value or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[key], key=lambda r: r["piece"])
        assert sum(p["length"] for p in pieces) == len(ids) and all(p["length"] == 1024 for p in pieces[1:])
        assert [p["ids_crc32"] for p in pieces] == [zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in pieces]
    encoder = packing.ChunkEncoder(**files)
    for value in ("a  b", " x", "x ", "<|endoftext|> y", "é\n z\t q", "it's  we'll", "a\0b c", "日本 語"):
        assert next(encoder.ids([value])) == np.array(tokenizer.encode(value, add_special_tokens=False).ids, "<u4").tobytes()


def test_mixture_meets_targets(spark):
    rows = [(k, " ".join(["w"] * RNG.randint(1, 40)), f"s{k % 5}" if k % 7 else None) for k in range(2000)]
    found = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), **queries.MIX).toPandas()
    again = mixing.mixture(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string"), **queries.MIX).toPandas()
    assert dict(zip(found.doc_id, found.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))
    per = found.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    left, open_, share = 1.5 * per["size"].sum(), list(per.sort_index(na_position="last").index), {}
    weights = dict(zip(open_, (5, 2, 1) * 2, strict=False))
    while open_:
        level = left / sum(weights[s] for s in open_)
        capped = [s for s in open_ if level * weights[s] > 2 * per.loc[s, "size"]]
        if not capped:
            share |= {s: level * weights[s] for s in open_}
            break
        for s in capped:
            share[s] = 2.0 * per.loc[s, "size"]
            left -= share[s]
            open_.remove(s)
    for s, target in share.items():
        assert abs(per.loc[s, "target"] - target) < 1e-6 and abs(per.loc[s, "taken"] - target) <= 0.02 * target + 40
    assert (found.taken <= 2 * found["size"]).all()


def test_secrets_against_a_scan(spark):
    rows = {
        1: 'API_KEY = "abcdefghijkl" token: short secret=token:abcdefghijklm x',
        2: "é😀 AKIA" + "A" * 14 + " AKIAshort " + "0a" * 8 + " " + "f" * 15,
        3: "passwd='abc+/_.=-defgh' Password:   ABCDEFGHIJKL",
        4: "Zx9Zx9Zx9Zx9Zx9Zx9Zx9a only here",
        5: None,
        6: "marks  stay token=aaaaaaaaaaaa",
    }
    docs = spark.createDataFrame([(k, v, f"s{k}") for k, v in rows.items()], "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in secrets.scan(docs).select("*", secrets.listed(secrets.F.col("spans")).alias("list")).collect()}
    import re

    for key, value in rows.items():
        value = value or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(secrets.BASE["assign"][0], value) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", value) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", value) if len(m[0]) >= 16]
        assert [(s["start"], s["rank"], s["end"]) for s in found[key]["spans"] if s["rank"] < 3] == sorted(spans)
    assert found[4]["list"] == "owned:0:22" and found[4]["n_live"] == 1


def test_ownership_separates_copies_from_live_values(spark):
    """Both frequencies and only distinct ones decide: several owners, or very many repositories of one, make a copy."""
    token = "Zx9Zx9Zx9Zx9Zx9Zx9Zx9%s"
    rows = [(k, f"see {token % 'a'} password=examplevalue1", f"s{k}") for k in range(4)]  # four owners
    rows += [(10 + k, f"see {token % 'b'} and postgres://me:s3cretpw@host", "s0") for k in range(2)]  # one owner, two repositories
    rows += [(20 + k, f"see {token % 'c'}", "s0") for k in range(secrets.COPIED_REPOSITORIES)]  # one owner, very many
    rows += [(60, f"see {token % 'd'} auth: AbC123456789xyz", "s1")] * 40  # one repository, repeated
    rows += [(70 + k, f"see {token % 'e'} 0123456789ABCDEF0", f"s{k}") for k in range(2)]  # two owners
    found = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    kinds = lambda k: [(s["rank"], s["verdict"]) for s in found[k]["spans"]]
    assert kinds(0) == [(0, "copied")] and found[0]["n_copied"] == 1 and found[0]["n_live"] == 0
    assert kinds(10) == [(3, "live"), (3, "live")] and found[10]["n_owned"] == 2
    assert kinds(20) == [] and kinds(60) == [(3, "live"), (3, "live")] and kinds(70) == []


def test_many_matches_of_one_text(spark):
    text_ = " ".join(f"é token={k:012d}x" for k in range(1000))
    found = secrets.scan(spark.createDataFrame([(1, text_, "s")], "doc_id long, text string, source string")).collect()[0]
    import re

    spans = [(m.start(), m.end()) for m in re.finditer(secrets.BASE["assign"][0], text_)]
    assert [(s["start"], s["end"]) for s in found["spans"] if s["rank"] == 0] == spans and len(spans) == 1000


def test_matches_are_marked_once_and_only_where_they_may_be(spark):
    """A pattern is looked for only in texts that hold what it needs, and what it marks is not made again for each block of matches."""
    import re

    texts = ["PaSsWoRd: abcdefghijkl0", "ToKeN=abcdefghijkl1", "aPi_KeY = abcdefghijkl2", "x AKIA" + "B1" * 8, "+" * 7 + "0123456789abcdef", "é0123456789ABCDEF.", "PWD=abcdefghijkl3", "Private_Key abcdefghijkl4", "ftp://me:s3cretpw@host", "Zx9" * 7, "акia"]
    rows = spark.createDataFrame([(k, t, f"s{k}") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    found = {r["doc_id"]: [(s["start"], s["rank"], s["end"]) for s in r["spans"]] for r in secrets.candidates(rows).collect()}
    for k, text_ in enumerate(texts):
        wanted = set()
        for rank, (pattern, group, least) in enumerate(secrets.BASE.values()):
            wanted |= {(m.start(), rank, m.end()) for m in re.finditer(pattern, text_) if len(m[group]) >= least}
        for pattern, group, least, held_by in secrets.MORE:
            wanted |= {(m.start(), 3, m.end()) for m in re.finditer(pattern, text_) if len(m[group]) >= least and all(re.search(x, m[group]) for x in held_by)}
        assert set(found[k]) == wanted and bool(wanted) == (k < len(texts) - 1)
    plans = secrets.candidates(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plans.count("regexp_replace(text") == len(secrets.BASE) + len(secrets.MORE)


def test_quality_separates_junk(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = [r for r in quality.judge(docs).collect() if r["doc_id"] in labels and not r["base_failed"]]
    assert all(r["kept"] == bool(labels[r["doc_id"]]) for r in rows) and len(rows) > 300


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    from pyspark.sql import functions as F

    scored = toxicity.score(docs.join(labels.filter(queries.held_out()), "doc_id").select("doc_id", "text"), toxicity.train(docs, labels, ~queries.held_out()))
    rows = scored.join(labels, "doc_id").select("toxic", (F.col("score") >= queries.TOXIC).alias("said")).collect()
    hit = sum(r["said"] and r["toxic"] == 1 for r in rows)
    assert hit >= 0.8 * sum(r["toxic"] == 1 for r in rows) and hit >= 0.9 * sum(r["said"] for r in rows)


def test_toxicity_scores_with_every_fitted_weight():
    rng = random.Random(11)
    bags = [set(rng.sample(WORDS, 60)) for _ in range(300)]
    target = np.array([rng.random() for _ in bags])
    rows = toxicity.Rows([toxicity.distinct_features(b) for b in bags])
    voters = toxicity.VOTERS - 1
    cast = np.zeros((len(bags), voters), int)
    linear = toxicity.Linear().fit(rows, cast, target, np.ones(len(bags)))
    assert sorted(linear.words) == rows.feature.tolist() and any(0 < abs(w) <= 0.06 for w in linear.words.values())
    model = toxicity.Model({toxicity.feature_ids(w)[0] for w in WORDS[:9]}, linear)
    score = model.scorer()
    for words in [*bags[:40], set(), {"unseen"}]:
        z = linear.bias + sum(linear.words.get(f, 0.0) for f in {f for w in words for f in toxicity.feature_ids(w)})
        said = toxicity.votes(words, "", toxicity.Masks(model.mined))
        z += sum(linear.votes[k if v == 1 else voters + k] for k, v in enumerate(said) if v)
        assert abs(score(" ".join(words)) - 1 / (1 + math.exp(-z))) < 1e-9


def test_label_model_learns_rates_and_correlation():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.2
    cast = lambda right: np.where(rng.random(len(y)) < right, 2 * y - 1, 1 - 2 * y)
    a = cast(0.9)
    votes = np.column_stack([a, np.where(rng.random(len(y)) < 0.97, a, -a), cast(0.8), cast(0.85), np.where(rng.random(len(y)) < 0.3, 2 * y - 1, 0)])
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel().fit(patterns, n.astype(float), 0.3)
    assert abs(model.prior - 0.2) < 0.06 and model.rates[1, 3, 2] > 0.75
    assert model.weight[0] < 0.8 > model.weight[1] and model.weight[2] > 0.9 and model.weight[4] == 1


def test_gif_round_trips():
    rng = random.Random(4)
    for payload in (bytes(64), bytes(rng.randrange(256) for _ in range(64 * 1500)), b"abcd" * 16 * 900, bytes(range(256)) * 4):
        size, frames, error = gif.read(gif.write(payload))
        assert error is None and b"".join(f.index.tobytes() for f in frames) == payload
        assert all(f.delay == gif.DELAY for f in frames) and sum(gif.histogram(f).sum() for f in frames) == len(payload) - payload.count(0)
    assert gif.read(gif.write(payload)[:-40])[2] is not None and gif.read(b"no gif")[2] == "no GIF header"


def test_gif_disposal_transparency_and_interlace():
    import struct

    def image(left, top, w, h, samples, disposal, clear=None, interlaced=False):
        control = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 5, clear or 0) + b"\0"
        return control + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 if interlaced else 0) + b"\x02" + gif._blocks(gif.lzw_encode(bytes(samples), 2))

    colours = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + colours
    data = head + image(0, 0, 2, 2, [1, 1, 1, 1], 1) + image(0, 0, 2, 1, [2, 0], 3, clear=0) + image(1, 1, 1, 1, [3], 2) + image(0, 0, 1, 1, [2], 0) + b"\x3b"
    _, frames, error = gif.read(data)
    red, green, blue, empty = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert error is None and [f.canvas.reshape(4, 4).tolist() for f in frames] == [[red] * 4, [green, red, red, red], [red, red, red, blue], [green, red, red, empty]]
    tall = b"GIF89a" + struct.pack("<HHBBB", 1, 8, 0x81, 0, 0) + colours + image(0, 0, 1, 8, [0, 1, 2, 2, 3, 3, 3, 3], 0, interlaced=True) + b"\x3b"
    assert gif.read(tall)[1][0].index.ravel().tolist() == [0, 3, 2, 3, 1, 3, 2, 3]


def test_frame_columns(spark):
    media = spark.createDataFrame([(1, gif.write(bytes(64 * 600))), (2, b"junk"), (3, None)], "k long, data binary")
    rows = gif.frame_columns(media, "k", "data").orderBy("k", "frame").collect()
    assert [(r["k"], r["frame"], r["starts"], r["error"]) for r in rows] == [(1, 0, 0, None), (1, 1, gif.DELAY, None), (2, 0, 0, "no GIF header"), (3, 0, 0, None)]
    assert sum(rows[0]["histogram"]) == 0 and len(rows[0]["samples"]) == 64 * gif.FRAME_ROWS


def test_large_headers_and_samples_beyond_the_palette():
    import struct

    bomb = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x2c" + bytes(20)
    assert gif.read(bomb)[2] == "the canvas is too large"
    colours = bytes([0, 0, 0, 255, 255, 255])
    data = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + colours + b"\x2c" + struct.pack("<HHHHB", 0, 0, 2, 2, 0) + b"\x02" + gif._blocks(gif.lzw_encode(bytes([0, 1, 2, 3]), 2)) + b"\x3b"
    _, [frame], error = gif.read(data)
    assert error is None and gif.histogram(frame).sum() == 4 and gif.histogram(frame)[63] == 3 and (frame.canvas[..., 0] == [[0, 255], [255, 255]]).all()


def test_media_features(spark):
    import zlib

    texts = {1: "plain words " * 3000, 2: "", 3: None, 4: "\0 zeros \0", 5: "plain words " * 3000, 6: "x" * 64, 7: "é日" * 100}
    rows = {r["doc_id"]: r for r in gif.media_features(gif.store_texts(frame(spark, texts))).collect()}
    for key, value in texts.items():
        data = (value or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = rows[key]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        made = gif.write(payload)
        assert r["media_sha256"] == hashlib.sha256(made).hexdigest() and r["media_bytes"] == len(made)
        frames, lasts, counts = r["feature"].split(":")
        assert int(frames) == -(-len(payload) // (64 * gif.FRAME_ROWS)) and int(lasts) == gif.DELAY * int(frames)
        assert sum(int(x.split("=")[1]) for x in counts.split(",") if x) == len(payload) - payload.count(0)
    assert rows[1]["feature"] == rows[5]["feature"]


def test_frame_columns_hold_what_is_shown(spark):
    import struct

    def image(left, top, w, h, samples, disposal, clear=None):
        control = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 5, clear or 0) + b"\0"
        return control + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0) + b"\x02" + gif._blocks(gif.lzw_encode(bytes(samples), 2))

    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    data = head + image(0, 0, 2, 2, [1, 1, 1, 1], 1) + image(0, 0, 2, 1, [2, 0], 3, clear=0) + image(1, 1, 1, 1, [3], 2) + image(0, 0, 1, 1, [2], 0) + b"\x3b"
    rows = gif.frame_columns(spark.createDataFrame([(1, data)], "k long, data binary"), "k", "data").orderBy("frame").collect()
    red, green, blue, empty = bytes([255, 0, 0, 255]), bytes([0, 255, 0, 255]), bytes([0, 0, 255, 255]), bytes(4)
    assert [bytes(r["picture"]) for r in rows] == [red * 4, green + red * 3, red * 3 + blue, green + red * 2 + empty]
    off = gif.frame_columns(spark.createDataFrame([(1, head + image(0, 0, 2, 2, [1] * 4, 1) + image(5, 7, 3, 3, [2] * 9, 0) + b"\x3b")], "k long, data binary"), "k", "data")
    assert [bytes(r["picture"]) for r in off.collect()] == [red * 4] * 2
    assert all(r["canvas"] == [2, 2] and r["error"] is None for r in rows)
    assert [sum(r["shown"]) for r in rows] == [4, 4, 4, 3] and [sorted(n for n in r["shown"] if n) for r in rows] == [[4], [1, 3], [1, 3], [1, 2]]


def test_index_finds_every_capture(spark):
    pages = spark.createDataFrame([(k, f"http://{'www.' if k % 3 else ''}host{k % 11}.example/{k % 50}", f"page {k % 40} " * 200) for k in range(500)], "page_id long, url string, html string")
    folder, captures = warc.write(pages)
    blocks, directory = warc.build_index(captures, lines=16)
    asked = spark.createDataFrame([(1, "example,host3)", "example,host3)~"), (2, "a", "b"), (3, "", "~")], "query long, low string, high string")
    found = warc.lookup(blocks, directory, asked).collect()
    keys = [r["key"] for r in captures.collect()]
    assert Counter(r["query"] for r in found) == Counter({1: sum("example,host3)" <= k <= "example,host3)~" for k in keys), 3: 500})
    read = warc.read_ranges(folder, spark.createDataFrame([r for r in found if r["query"] == 1])).collect()
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in read if r["payload"] is not None)
    assert len(read) == sum(r["query"] == 1 for r in found)
    assert warc.url_key("HTTP://WWW.Example.com:80/a?b#c") == "com,example,www)/a?b"


def test_only_the_wanted_ranges_are_read(spark, monkeypatch):
    """Places of one host in archives of 500 pages: what is read of the files is little more than the records themselves."""
    rng = random.Random(9)
    pages = spark.createDataFrame([(k, f"http://host{k % 50}.example/{k}", "".join(rng.choices("abcdefgh ", k=20_000))) for k in range(500)], "page_id long, url string, html string").coalesce(2)
    folder, captures = warc.write(pages)
    held = captures.collect()
    assert {r["archive"] for r in held} == set(os.listdir(folder))
    sizes = {name: os.path.getsize(f"{folder}/{name}") for name in os.listdir(folder)}
    assert all(sum(r["length"] for r in held if r["archive"] == name) == size for name, size in sizes.items())
    wanted = sorted((r["archive"], r["offset"], r["length"]) for r in held if r["key"].startswith("example,host7)"))
    found = warc.read_ranges(folder, spark.createDataFrame(wanted, "archive string, offset long, length long")).collect()
    assert sorted(r["page_id"] for r in found) == list(range(7, 500, 50))
    read = 0
    for name in sizes:
        mine = [(o, n) for a, o, n in wanted if a == name]
        read += sum(end - mine[first][0] for first, _, end in warc.spans([o for o, _ in mine], [n for _, n in mine])) if mine else 0
    assert sum(n for *_, n in wanted) <= read < 0.1 * sum(sizes.values())
    assert warc.spans([0, 10, 30, 10**9], [10, 5, 5, 7]) == [(0, 3, 35), (3, 4, 10**9 + 7)]
