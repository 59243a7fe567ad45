"""Line dedup, near-duplicates and bulk words against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from noteloom.llm import lines, quality, queries, simhash, words
from noteloom.llm.common import in_filter, key_filter, table


def test_words_are_those_of_split(monkeypatch):
    monkeypatch.setattr(words, "STRETCH", 7)
    rng = random.Random(1)
    texts = ["".join(rng.choice("aA é\n\t \x0bxyz日") for _ in range(rng.randint(0, 60))) for _ in range(500)] + [None, "", "x" * 100]
    found = words.words(pa.array(texts, pa.string()).slice(3))
    held = [x for t in texts[3:] for x in (t or "").encode().split()]
    by_word = {}
    for word, number in zip(held, found.hash.tolist(), strict=True):
        assert by_word.setdefault(word, number) == number
    assert len(set(by_word.values())) == len(by_word)
    assert found.per_text().tolist() == [len((t or "").encode().split()) for t in texts[3:]]
    assert words.words(pa.array(["Ab É"]), lower=True).hash.tolist() == words.words(pa.array(["ab É"])).hash.tolist()


def test_filter_holds_every_key(spark):
    held = key_filter(spark.createDataFrame([(k * 7, k) for k in range(1000)], "a long, b int"))
    keys = np.arange(1000)
    assert in_filter(held, keys * 7, keys).all() and in_filter(held, keys * 7 + 1, keys).mean() < 0.01


def _sets(rng, n):
    base = [rng.sample(range(400), rng.randint(5, 30)) for _ in range(12)]
    out = []
    for _ in range(n):
        held = set(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            held ^= {rng.randrange(400)}
        out.append(sorted(held) or [1])
    return out


def _rows(sets, t):
    token, size, position, bits, owner = [], [], [], [], []
    for k, held in enumerate(sets):
        hashes = words.mix(np.array(held, np.uint64))
        sketch = np.bitwise_xor.reduce(np.uint64(1) << (hashes >> np.uint64(58)))
        for i in range(int(lines._prefix(np.array([len(held)]), t)[0])):
            token.append(held[i])
            size.append(len(held))
            position.append(i)
            bits.append(sketch)
            owner.append(k)
    columns = [np.array(token, np.uint64), np.array(size), np.array(position), np.array(bits, np.uint64), np.array(owner)]
    order = np.lexsort((columns[1], columns[0]))
    return [c[order] for c in columns]


@pytest.mark.parametrize("neighbours, block", [(8192, 1024), (2, 3), (8192, 1)])
def test_every_similar_pair_shares_a_group(monkeypatch, neighbours, block):
    monkeypatch.setattr(lines, "NEIGHBOURS", neighbours)
    monkeypatch.setattr(lines, "BLOCK", block)
    sets = [list(s) for s in dict.fromkeys(map(tuple, _sets(random.Random(3), 250)))]
    token, size, position, bits, owner = _rows(sets, 0.8)
    row, root = lines._asks(lines._groups(token, size, position, bits, 0.8), owner, np.zeros_like(owner), size, 0.8)
    groups = {}
    for k, name in zip(owner[row].tolist(), root.tolist(), strict=True):
        groups.setdefault(name, set()).add(k)
    pairs = 0
    for a in range(len(sets)):
        for b in range(a):
            x, y = set(sets[a]), set(sets[b])
            if len(x & y) >= 0.8 * len(x | y) - 1e-9:
                pairs += 1
                assert any({a, b} <= g for g in groups.values())
    assert pairs > 50


def test_lines_whose_hashes_share_32_bits_stay(spark):
    """Equal sets are settled by 128 bits: two lines with equal low halves of one hash are no match."""
    seen, pair = {}, None
    tokens = words.words(pa.array([" ".join(f"a{k} b{k}" for k in range(200_000))])).hash
    sums = words.mix(tokens).reshape(-1, 2).sum(axis=1, dtype=np.uint64) & np.uint64(0xFFFFFFFF)
    for k, low in enumerate(sums.tolist()):
        if low in seen:
            pair = (seen[low], k)
            break
        seen[low] = k
    assert pair
    rows = spark.createDataFrame([(n, f"a{k} b{k}") for n, k in enumerate(pair)], "doc_id long, text string")
    assert lines.later_matches(rows).count() == 0


def test_lines_whose_words_share_40_bits_stay(spark):
    """Lines meet by 40 bits of a word's hash and are compared by all 64: two words of equal low bits are no match, alone or in a longer line."""
    one, two = "w4638035", "w5472269"
    hashes = words.words(pa.array([f"{one} {two}"])).hash
    assert hashes[0] != hashes[1] and hashes[0] & lines.MEET == hashes[1] & lines.MEET
    texts = [one, two, f"{one} a b c", f"{two} a b c", f"a b {one}\n{two} b a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert lines.later_matches(rows).count() == 0
    staged = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, rows, "").collect()}
    assert staged == dict(enumerate(texts))
    again = spark.createDataFrame([*enumerate(texts), (9, f"c b a {two}")], "doc_id long, text string")
    assert [(r["doc_id"], r["lines"]) for r in lines.later_matches(again).collect()] == [(9, [0])]


def test_tokens_are_in_one_order_for_all_lines():
    rng = np.random.default_rng(4)
    token = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    token[1000:2000] = token[:1000] & np.uint64(0xFFFF000000000000) | rng.integers(0, 1 << 20, 1000).astype(np.uint64)  # equal tops
    token = rng.choice(token, 60_000)
    line = np.sort(rng.integers(0, 500, len(token)))
    counts = rng.integers(0, 3, lines.CELLS).astype(np.uint8)
    order = np.lexsort((token, counts[(token & np.uint64(lines.CELLS - 1)).astype(np.int64)], line))
    found = lines._rarest_first(token, line, counts)
    assert np.array_equal(found[0], token[order]) and np.array_equal(found[1], line[order])


def test_whole_line_query_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    earlier, kept = [], {}
    for key in sorted(texts):
        out = []
        for line in texts[key].split("\n"):
            mine = frozenset(line.encode().split())
            if mine and any(len(mine & x) >= 0.8 * len(mine | x) - 1e-9 for x in earlier if 0.8 * len(x) <= len(mine) + 1e-9 and 0.8 * len(mine) <= len(x) + 1e-9):
                earlier.append(mine)
                continue
            earlier.append(mine) if mine else None
            out.append(line)
        kept[key] = "\n".join(out)
    rows, _, _ = lines.strip(docs)
    assert {r["doc_id"]: r["text"] or "" for r in rows.collect()} == kept


def test_whole_simhash_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    prints = {}
    for key, text in texts.items():
        found = text.translate({k: k + 32 for k in range(65, 91)}).encode().split()
        shingles = [b" ".join(found[k : k + 3]) for k in range(max(1, len(found) - 2))] if found else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[key] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(texts)
    for a in keys:
        for b in keys:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    rows = queries.op5_simhash(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {k: (f"{prints[k]:016x}", find(k)) for k in keys}


def test_near_groups_on_the_tables(spark):
    """Recall of at least 0.9 at similarity 0.8, and no link below it but by chains, against all pairs."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.collect()
    held, many = simhash.shingle_sets(pa.array([r["text"] or "" for r in rows]), 5)
    end = np.cumsum(many)
    sets = {r["doc_id"]: frozenset(held[b - n : b].tolist()) for r, b, n in zip(rows, end, many, strict=True)}
    holders = {}
    for key, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(key)
    both = {}
    for keys in holders.values():
        for i, a in enumerate(keys):
            for b in keys[:i]:
                both[b, a] = both.get((b, a), 0) + 1
    near = {(a, b) for (a, b), n in both.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9}
    group = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    assert len(near) > 20 and sum(group[a] == group[b] for a, b in near) >= 0.9 * len(near)
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    empty = [k for k in sorted(sets) if not sets[k]]
    for a, b in [*near, *zip(empty, empty[1:], strict=False)]:
        root[find(b)] = find(a)
    members = {}
    for k, g in group.items():
        members.setdefault(g, []).append(k)
    assert all(len({find(k) for k in held}) == 1 for held in members.values())


def test_quality_fits_the_half_with_the_smallest_determinant(spark):
    """Forty per cent of far-off rows in a tight cluster neither move the fit nor are kept."""
    rng = np.random.default_rng(4)
    good = rng.normal(0.5, 0.05, (300, 5))
    bad = rng.normal(1.4, 0.01, (200, 5))
    rows = [("g", *map(float, x)) for x in np.concatenate([good, bad])]
    fit = quality.fits(spark.createDataFrame(rows, "level string, " + ", ".join(f"{v} double" for v in quality.VECTOR))).collect()[0]
    assert all(abs(fit[f"x{k}"] - 0.5) < 0.05 for k in range(5)) and fit["determinant"] > 0


def test_toxicity_query_columns(spark):
    rows = queries.op2_toxicity(spark, "/root/testdata/sf0.01").collect()
    import zlib

    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
