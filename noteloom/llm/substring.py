"""Substring dedup by recompression.

Each text is a string of words. Rounds of recompression rename it: first runs of one word, then, round
after round, neighbouring pairs whose names fall into the left and the right class of that round. A
name is a hash of what it stands for, so every executor gives equal substrings equal names, all
over the corpus, without a dictionary to exchange. Whether a name arises depends on a few words
around it only; those words are tracked, so that a name inside a window is sure to arise in
every other window of the same words.

Each window of ``width`` words is filed under its longest sure name. Windows that follow each other
under one name travel as one entry: the name, the place, and a short hash of each window. Entries
of one name meet in one task, where equal windows are found and all but the first are marked. Before
they travel, equal windows of one slice of documents are settled, so a passage that very many
documents share sends one entry for each slice, not one for each document.

Windows are equal if name and hash (80 bits) are; positions are ordered by doc_id, then start.

Defined results: words are runs of characters other than the six ASCII white-space characters; texts
with fewer words than a window, empty and null texts keep all they have; rows with a null doc_id are
kept whole and remove nothing; rows that repeat a doc_id do not remove each other's equal places; very long texts
are taken whole; other columns, whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import parts, ship
from noteloom.llm.words import BASE as STEP
from noteloom.llm.words import mix, slices
from noteloom.llm.words import words as words_of

ROUNDS = 6
#: Bytes of text worked on at once; a longer text is worked on alone.
SLICE_BYTES = 3_000_000
#: Windows that a task compares at once.
AT_ONCE = 400_000
SEND = "bucket int, doc_id long, start int, stop int, entries binary"
BASE, INVERSE = np.uint64(STEP), np.uint64(pow(STEP, -1, 1 << 64))
U = np.uint64


def names(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What recompression names in words (hashes; doc: ascending number of each word's document).

    Returns for each name that arose: itself, its length in words, and the stretch [low, high) of words on which it depends.
    """
    n = len(words)
    out = []
    # Runs of one word. A word that is no run depends on both neighbours; beyond a text's edge counts as a neighbour.
    same = np.zeros(n + 1, bool)
    same[1:n] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    first = np.flatnonzero(~same[:n])
    end = np.append(first[1:], n)
    size = end - first
    sym = np.where(size > 1, mix(words[first] + U(0xA5A5) * size.astype(np.uint64)), words[first])
    low, high, home = first - 1, end + 1, doc[first]
    run = size > 1
    out.append((sym[run], size[run], low[run], high[run]))
    for turn in range(rounds):
        k = len(sym)
        if k < 2:
            break
        right = (mix(sym + U(turn + 1) * BASE) >> U(63)).astype(bool)
        inner = home[1:] == home[:-1]
        pair = inner & ~right[:-1] & right[1:]
        a = np.flatnonzero(pair)
        made = mix(sym[a] * U(0xD6E8FEB86659FD93) + mix(sym[a + 1] + U(7)))
        made_low, made_high, made_size = np.minimum(low[a], low[a + 1]), np.maximum(high[a], high[a + 1]), size[a] + size[a + 1]
        out.append((made, made_size, made_low, made_high))
        # What stays depends on the neighbour it could have joined.
        after_high = np.append(np.where(inner, high[1:], high[:-1] + 1), high[-1] + 1)
        before_low = np.insert(np.where(inner, low[:-1], low[1:] - 1), 0, low[0] - 1)
        after_low = np.append(np.where(inner, low[1:], low[:-1]), low[-1])
        before_high = np.insert(np.where(inner, high[:-1], high[1:]), 0, high[0])
        low = np.where(right, np.minimum(low, before_low), np.minimum(low, after_low))
        high = np.where(right, np.maximum(high, before_high), np.maximum(high, after_high))
        sym, size = sym.copy(), size.copy()
        sym[a], size[a], low[a], high[a] = made, made_size, made_low, made_high
        keep = np.ones(k, bool)
        keep[a + 1] = False
        sym, size, low, high, home = sym[keep], size[keep], low[keep], high[keep], home[keep]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def windows(words: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first word, name, hash) of each window; name and hash have 40 bits each."""
    n = len(words)
    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    whole = doc[: n - width + 1] == doc[width - 1 :]
    power = np.full(n, BASE)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    back = np.full(n - width + 1, INVERSE)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    total = np.zeros(n + 1, np.uint64)
    np.add.accumulate(words * power, out=total[1:])
    hashed = mix((total[width:] - total[:-width]) * back)
    name, size, low, high = names(words, doc)
    good = high - low <= width
    name, size, low, high = name[good], size[good], low[good], high[good]
    # A name serves the windows that start in [high - width, low]; the best name of each by doubling.
    score = (np.minimum(size, 31).astype(np.uint64) << U(59)) | (name >> U(5))
    m = n - width + 1
    a, b = np.maximum(high - width, 0), np.minimum(low, m - 1)
    fits = a <= b
    a, b, score = a[fits], b[fits], score[fits]
    step = np.floor(np.log2(b - a + 1)).astype(np.int64)
    top = int(step.max()) if len(step) else 0
    best = np.zeros(m, np.uint64)
    carried = np.zeros(m, np.uint64)
    for k in range(top, -1, -1):
        at = step == k
        np.maximum.at(carried, a[at], score[at])
        np.maximum.at(carried, b[at] - (1 << k) + 1, score[at])
        if k:
            half = 1 << (k - 1)
            moved = carried.copy()
            np.maximum(moved[half:], carried[:-half], out=moved[half:]) if half < m else None
            carried = moved
        else:
            best = carried
    best = np.where(best == 0, hashed, mix(best))  # a window without a name goes by its own hash
    place = np.flatnonzero(whole)
    return place, best[place] >> U(24), hashed[place] >> U(24)


def repeated(name: np.ndarray, hashed: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows start earlier elsewhere, and which are the first of their kind."""
    key = mix((name << U(24)) ^ mix(hashed))
    order = np.lexsort((start, doc, key))
    key, doc, start = key[order], doc[order], start[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(key) else np.empty(0, np.int64)
    later = (doc != doc[head]) | (start != start[head])
    out, lead = np.zeros(len(key), bool), np.zeros(len(key), bool)
    out[order], lead[order] = later, first
    return out, lead


def stretches(doc: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, stop) of the words that windows at these places cover, joined where they touch."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + width)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(doc)) - 1 if len(doc) else head
    return doc[head], start[head], start[last] + width


def _pack(name: np.ndarray, hashed: np.ndarray, doc: np.ndarray, start: np.ndarray) -> bytes:
    """Windows in order of place as entries: those that follow each other under one name are one."""
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    many = np.diff(np.append(head, len(name)))
    docs, which = np.unique(doc[head], return_inverse=True)
    low = U(0xFFFFFFFF)
    columns = [docs.astype("<i8"), (name[head] & low).astype("<u4"), which.astype("<u4"), start[head].astype("<u4"), many.astype("<u4"), (hashed & low).astype("<u4"), (name[head] >> U(32)).astype("u1"), (hashed >> U(32)).astype("u1")]
    return np.array([len(docs), len(head), len(name)], "<u4").tobytes() + b"".join(c.tobytes() for c in columns)


def _count(data: bytes) -> int:
    """Windows in a packed entry list."""
    return int(np.frombuffer(data, "<u4", 3)[2])


def _unpack(data: bytes, share: int = 0, shares: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows whose name falls into one of ``shares`` shares."""
    n_docs, heads, n = np.frombuffer(data, "<u4", 3).tolist()
    at, out = 12, []
    for kind, count in (("<i8", n_docs), ("<u4", heads), ("<u4", heads), ("<u4", heads), ("<u4", heads), ("<u4", n), ("u1", heads), ("u1", n)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    docs, name_low, which, start, many, hash_low, name_high, hash_high = out
    name = name_low.astype(np.uint64) | (name_high.astype(np.uint64) << U(32))
    hashed = hash_low.astype(np.uint64) | (hash_high.astype(np.uint64) << U(32))
    many = many.astype(np.int64)
    if shares > 1:
        mine = (mix(name + U(3)) % U(shares)) == U(share)
        hashed = hashed[np.repeat(mine, many)]
        name, which, start, many = name[mine], which[mine], start[mine], many[mine]
    n = len(hashed)
    step = np.arange(n) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(name, many), hashed, np.repeat(docs[which], many), np.repeat(start.astype(np.int64), many) + step


def _rows(bucket=(), doc=(), start=(), stop=(), entries=None) -> pa.RecordBatch:
    n = len(bucket)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(doc, pa.int64()) if len(doc) else pa.nulls(n, pa.int64()), pa.array(start, pa.int32()) if len(start) else pa.nulls(n, pa.int32()), pa.array(stop, pa.int32()) if len(stop) else pa.nulls(n, pa.int32()), pa.array(entries, pa.binary()) if entries else pa.nulls(n, pa.binary())], ["bucket", "doc_id", "start", "stop", "entries"])


def covered(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, start, stop): stretches of words [start, stop) that a window which also starts earlier covers."""
    spark = docs.sparkSession
    buckets = parts(spark)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size=SLICE_BYTES):
            found, keys = words_of(part.column(1)), part.column(0).to_numpy()
            count = found.per_text()
            doc = np.repeat(np.arange(len(keys)), count)
            place, name, hashed = windows(found.hash, doc, width)
            del found
            if not len(place):
                continue
            start = place - (np.cumsum(count) - count)[doc[place]]
            owner = keys[doc[place]]
            later, first = repeated(name, hashed, owner, start)
            if later.any():
                d, a, b = stretches(owner[later], start[later], width)
                yield _rows(d % buckets, d, a, b)
            name, hashed, owner, start = name[first], hashed[first], owner[first], start[first]
            bucket = (mix(name) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = [k for k in range(buckets) if edges[k] < edges[k + 1]]
            for at in range(0, len(used), 256):
                some = used[at : at + 256]
                yield _rows(some, entries=[_pack(*(x[order[edges[k] : edges[k + 1]]] for x in (name, hashed, owner, start))) for k in some])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            settled = batch.filter(batch.column("doc_id").is_valid())
            if settled.num_rows:
                yield settled.select(["doc_id", "start", "stop"])
            held += [x.as_py() for x in batch.column("entries") if x.is_valid]
        # Equal windows have equal names, so the names are taken in shares of a size that memory holds.
        shares = -(-sum(map(_count, held)) // AT_ONCE)
        for share in range(shares):
            columns = [np.concatenate(c) for c in zip(*(_unpack(x, share, shares) for x in held), strict=True)]
            later, _ = repeated(*columns)
            d, a, b = stretches(columns[2][later], columns[3][later], width)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["doc_id", "start", "stop"])

    ship(spark)
    sent = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(send, SEND)
    return sent.repartition(buckets, "bucket").mapInArrow(meet, "doc_id long, start int, stop int")


def strip(docs: DataFrame, width: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept, its kept words joined by single spaces."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for text, starts, stops in zip(*(part.column(k) for k in (1, 2, 3)), strict=True):
                    words = (text.as_py() or "").encode().split()
                    kept, edge = [], 0
                    for a, b in sorted(zip(starts.as_py() or (), stops.as_py() or (), strict=True)):
                        if a > edge:
                            kept += words[edge:a]
                        edge = max(edge, b)
                    kept += words[edge:]
                    out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    marks = covered(docs, width).groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")).withColumnRenamed("doc_id", "_doc_id")
    held = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    joined = held.join(marks, F.col("doc_id") == F.col("_doc_id"), "left").select("doc_id", "text", "starts", "stops")
    return joined.mapInArrow(work, "doc_id long, n_words long, n_removed long, kept string")
