"""Periodic runs of words: Kolpakov and Kucherov's algorithm for all maximal repetitions.

A run is a stretch of words with a smallest period q, at least ``least`` words and two periods long, that no
neighbouring word extends. In each stretch of a text:

1. a suffix automaton gives the LZ factorisation: each factor is a word not seen before, or the longest prefix of the rest that
   starts earlier too;
2. Main's algorithm finds the runs that touch a factor's left edge. With extension functions (the Z algorithm, over at most
   twice the factor before and once this one) it tells for every period how far it goes on to both sides;
3. every other run lies inside a factor, and is copied from the factor's earlier occurrence, from left to right.

All runs of length ``least`` or more repeat some sequence of least / 2 words one period on, so stretches of a text in which no such
sequence occurs twice hold no run: they are found by hashes of all such sequences at once, and left out. What is left is cut
at places that no run can cross, and words are compared themselves, not by hash.

Documents are independent of each other, so nothing is shuffled; a text is worked on in time and memory linear in its words (some
500 bytes for each word of a stretch that may hold runs).

Defined results: a null or empty text has no words and no runs; a very long text is judged whole; rows that repeat a doc_id are
judged each by itself; of longest runs the first by start, then period, is named; other columns, whatever their names, are not
looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import ship
from noteloom.llm.words import mix

#: Words of a run at least, and rounds of cutting texts to the stretches that may hold one.
LEAST, ROUNDS = 12, 5
U = np.uint64
Run = tuple[int, int, int]


def factors(text: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier) of each factor; the earlier start is -1 for a symbol that is new."""
    follow, link, longest, ends = [{}], [-1], [0], [-1]
    last = 0
    for i, symbol in enumerate(text):
        new = len(follow)
        follow.append({})
        longest.append(longest[last] + 1)
        ends.append(i)
        link.append(0)
        p = last
        while p >= 0 and symbol not in follow[p]:
            follow[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = follow[p][symbol]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(follow[q].copy())
                longest.append(longest[p] + 1)
                ends.append(ends[q])
                link.append(link[q])
                while p >= 0 and follow[p].get(symbol) == q:
                    follow[p][symbol] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out, at, n = [], 0, len(text)
    while at < n:
        state, length = 0, 0
        while at + length < n and ends[to := follow[state][text[at + length]]] < at + length:
            state, length = to, length + 1
        out.append((at, length, ends[state] - length + 1) if length else (at, 1, -1))
        at += max(length, 1)
    return out


def extensions(text: list[int]) -> list[int]:
    """For each place how much of the text's beginning stands there (the Z algorithm)."""
    n = len(text)
    out = [n] + [0] * (n - 1) if n else []
    left = right = 0
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and text[k] == text[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def crossing(text: list[int], low: int, edge: int, high: int, least: int) -> Iterator[Run]:
    """(start, end, period) of the runs that touch ``edge`` within text[low:high] and that no word outside extends; by period."""
    left, right, n = text[low:edge], text[edge:high], len(text)
    back = left[::-1]
    none = [-1]
    to_right = extensions(right + none + left + right)  # of ``right`` at each place of left + right
    to_left = extensions(back + none + right[::-1] + back)  # of ``left``, backward, likewise
    x, y = len(left), len(right)
    for q in range(1, max(x, y) + 1):
        found = []
        if q <= x:  # a period to the left of the edge
            found.append((edge - q - min(to_left[x + 1 + y + q] if q < x else 0, x - q), edge + min(to_right[y + 1 + x - q], y)))
        if q <= y:  # a period to the right
            found.append((edge - min(to_left[x + 1 + y - q], x), edge + q + (min(to_right[y + 1 + x + q], y - q) if q < y else 0)))
        for start, end in found:
            if end - start < max(least, 2 * q) or (start > 0 and text[start - 1] == text[start - 1 + q]) or (end < n and text[end] == text[end - q]):
                continue
            yield start, end, q


def maximal(text: list[int], least: int = LEAST) -> list[Run]:
    """All runs of a text of symbols as (start, length, period), by start, then period; symbols are not negative."""
    n = len(text)
    ended = [*text, max(text, default=0) + 1]  # a last factor of its own, so that a run at the end touches an edge
    begun: list[dict[int, int]] = [{} for _ in range(n + 1)]  # by start: end and smallest period
    before = 0
    for start, length, earlier in factors(ended):
        high = start + length
        low = max(0, start - 2 * before - length)
        if start and high - low >= least:
            for a, b, q in crossing(ended, low, start, min(high, n), least):
                begun[a].setdefault(b, q)
        if length >= least:
            shift = start - earlier
            for a in range(start + 1, high - least):
                inside = [(b, q) for b, q in begun[a - shift].items() if b + shift < high]
                for b, q in inside:
                    begun[a].setdefault(b + shift, q)
        before = length
    return sorted((a, b - a, q) for a in range(n + 1) for b, q in begun[a].items())


def stretches(hashes: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of disjoint stretches of words outside of which there is no run.

    In a run some ``half`` = least / 2 words stand again one period on, and no more than half - 1 places follow each other in it at
    which no repeated sequence begins. Stretches are cut at longer gaps, and looked at again by themselves until nothing changes,
    ROUNDS times at most; this only spares work.
    """
    half = least // 2
    todo, out = [(0, len(hashes), ROUNDS)], []
    while todo:
        low, high, rounds = todo.pop()
        n = high - low - half + 1
        if high - low < least:
            continue
        key = hashes[low : low + n].copy()
        for k in range(1, half):
            key = mix(key) + hashes[low + k : low + k + n]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(n, bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        places = np.flatnonzero(again)
        if not len(places):
            continue
        cuts = np.flatnonzero(np.diff(places) > half)
        parts = [(low + int(a), low + int(b) + half) for a, b in zip(places[np.append(0, cuts + 1)], places[np.append(cuts, len(places) - 1)], strict=True)]
        if rounds == 0 or parts == [(low, high)]:
            out += parts
        else:
            todo += [(*part, rounds - 1) for part in parts]
    return sorted(out)


def word_runs(words: list[bytes], least: int = LEAST) -> list[Run]:
    """All runs of a text's words."""
    if len(words) < least:
        return []
    hashes = np.fromiter((hash(w) for w in words), np.int64, len(words)).view(np.uint64)
    out = []
    for low, high in stretches(mix(hashes), least):
        number: dict[bytes, int] = {}
        out += [(low + a, length, q) for a, length, q in maximal([number.setdefault(w, len(number)) for w in words[low:high]], least)]
    return out


def covered(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find(docs: DataFrame, least: int = LEAST, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """RUNS of docs(doc_id, text): all runs by start, then period, and the words that no run repeats, joined by a space.

    ``prepare(doc_id, words)`` may change a document's words first.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            out, size = [], 0
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                key, text = key.as_py(), text.as_buffer() if text.is_valid else b""
                words = bytes(text).split()  # at the six ASCII white-space characters
                if prepare is not None:
                    words = prepare(key, words)
                runs = word_runs(words, least)
                kept = words
                if runs:
                    gone = covered(len(words), runs)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((key, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(kept)))
                size += len(out[-1][3])
                if size > 4_000_000:
                    yield made(out, run)
                    out, size = [], 0
            if out:
                yield made(out, run)

    def made(rows: list, run: pa.DataType) -> pa.RecordBatch:
        key, n, runs, kept = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, RUNS)
