"""Periodic runs against a brute-force search, and cases with known answers."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest

from noteloom.llm import queries, runs
from tests.conftest import SF


def every_run(words, least=runs.LEAST):
    """All runs by holding each word against the one q places on, for every q; a period is smallest if no smaller one spans the same words."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k > i and k - i + q >= max(least, 2 * q):
                found.setdefault((i, k + q), q)
            i = max(k, i) + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def kept(words, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def texts(made):
    """Symbols with much repetition: of few letters, built from squares, Fibonacci words, cut and joined."""
    fib = [0], [0, 1]
    for _ in range(6):
        fib = fib[1], fib[1] + fib[0]
    yield from ([], [0], [0] * 40, [0, 1] * 20, fib[1], fib[1] + [2] + fib[0])
    for _ in range(1500):
        letters, out = made.choice((2, 2, 3, 5)), []
        while len(out) < made.randrange(5, 90):
            piece = [made.randrange(letters) for _ in range(made.randrange(1, 12))]
            out += piece * made.choice((1, 1, 2, 3)) + piece[: made.randrange(len(piece) + 1)]
        yield out


@pytest.mark.parametrize("least", [2, 5, 12])
def test_all_runs_of_dense_texts(least):
    for text in texts(random.Random(least)):
        assert runs.maximal(text, least) == every_run(text, least), text


def test_factors_rebuild_their_text():
    for text in texts(random.Random(1)):
        out = []
        for start, length, earlier in runs.factors(text):
            assert start == len(out) and (earlier < 0) == (text[start] not in text[:start])
            for k in range(length):
                out.append(text[start] if earlier < 0 else out[earlier + k])
        assert out == text


def test_words_between_runs_are_left_out():
    made = random.Random(5)
    for _ in range(150):
        words = []
        while len(words) < made.randrange(20, 600):
            piece = [f"w{made.randrange(40 if made.random() < 0.5 else 100_000)}".encode() for _ in range(made.randrange(1, 30))]
            words += piece * made.choice((1, 1, 1, 2, 3))
        found = runs.word_runs(words)
        assert found == every_run(words)
        assert [w for w, g in zip(words, runs.covered(len(words), found), strict=True) if not g] == kept(words, found)
    assert runs.stretches(np.arange(1, 5000, dtype=np.uint64)) == []


def wanted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = every_run(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256("".join(f"{a},{b},{q}\n" for a, b, q in found).encode()).hexdigest(), hashlib.sha256(" ".join(kept(words, found)).encode()).hexdigest())


def test_query_against_brute_force(spark):
    """All documents of at most 3,000 words; the longer ones by the algorithm that the tests above hold against brute force."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in queries.op13_runs(spark, SF).collect()}
    assert set(found) == set(texts)
    short = {i: t for i, t in texts.items() if len((t or "").split()) <= 3000}
    assert len(short) > 0.9 * len(texts) and any(found[i]["n_runs"] for i in short)
    for i, text in short.items():
        assert tuple(found[i])[1:] == wanted(i, text), i


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (None, "a b " * 10), (4, " ".join(f"w{i}" for i in range(60_000)) + " x y z" * 5), (5, "a b c  " * 6), (5, "é " * 12), (6, "a " * 11)]
    held = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS n_words", "3 AS collapsed")
    found = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find(held).collect()), key=str)
    assert (0, 20, [(0, 20, 2)], "a b") in found
    assert (1, 0, [], "") in found and (2, 0, [], "") in found
    assert any(n == 60_015 and r == [(60_000, 15, 3)] for _, n, r, _ in found)
    assert (5, 12, [(0, 12, 1)], "é") in found and (5, 18, [(0, 18, 3)], "a b c ") in found
    assert (6, 11, [], "a a a a a a a a a a a") in found
    assert runs.find(held.limit(0)).count() == 0
