"""Line dedup: an exact set-similarity join of lines with prefix, positional and length filters.

A line is the set of its words, each a hash of 64 bits. Its tokens are put in one order for the whole corpus, rarest first: by
a sketch of how often each word occurs (CELLS bytes, whatever the corpus), then by hash; the order is
the same for all lines, which is all that exactness needs. Two sets with a Jaccard similarity of at
least t share a token among the first |x| - ceil(t|x|) + 1 of each.

1. Every line's prefix tokens meet by token, as packed entries. Lines with equal sets (128 bits) are settled
   under their first token. Of the others each is held against those of fitting length and position under the
   token; 64-bit sketches of the sets rule out most pairs that share a token by chance. What passes is
   joined to groups, and a group is named by its first line, so that lines which meet under several tokens
   ask for one group, not for each token.
2. The sets of lines with a group are written once by a second scan, with wide sketches. In each group the sketches
   pick for each line the likeliest of the earlier lines that it may match, and those two sets are verified. Only for
   lines that this does not settle, though another earlier line may match, whole groups meet and are verified.
3. A line that an earlier line (by doc_id, then place in the text) matches is removed. Matches are
   judged on the input, not on what is left, so the result depends on no order of work.

Lines that very many documents hold send one entry for each slice of documents; equal sets under one
token are reduced to their first before any pair is looked at. What a token joins to a group of more than BLOCK sets is
cut into blocks by size, and every two blocks whose sizes fit meet by themselves. Texts move once, and only those
that may lose a line, by a filter of fixed size over the ids: beyond some ten million such documents
the filter fills and all texts move, which changes no result.

Defined results: lines without words are kept and match nothing, as are lines with fewer than ``least``
distinct words where a caller asks for more than 1; null and empty texts stay as they are; case and punctuation count;
very long texts are judged line by line like any other; documents with a null doc_id are left as
they are; rows that repeat a doc_id do not remove each other's lines of one place; other columns, whatever their
names, are carried along; of equal lines the first by doc_id, then place, stays; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import cut, fixed_table, free, from_planes, in_filter, key_filter, key_number, least_labels, parts, planes, ship
from noteloom.llm.words import mix, slices, words

#: Cells of the sketch of word frequencies (one byte each) and bits of the filter over documents that lose a line, whatever the corpus.
CELLS, DOC_BITS = 1 << 22, 1 << 24
#: A token is a word's hash of 64 bits. Lines meet by MEET of its bits, which only adds candidates; sets are compared by all.
U = np.uint64
MEET = U((1 << 40) - 1)
WIDTH = 8
#: Bits of a sorting key: line, rarity, the top of the token, and its place in the slice.
LINE_BITS, RARITY_BITS, TOP_BITS, PLACE_BITS = 21, 5, 16, 22
LEAST, SIMILARITY = 1, 0.8
#: Entries that a task compares at once, and sets of a group that meet in one task.
AT_ONCE, BLOCK = 300_000, 1024
#: Fitting neighbours that an entry is held against one by one; a token's group in which one has more is verified whole.
NEIGHBOURS = 8192
#: Words of 64 bits in a wide sketch, and rows whose sketches are compared at once.
WIDE, SKETCHES = 4, 1 << 16


def _rarest_first(token: np.ndarray, line: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and their lines by line, then rarity, then token."""
    rarity = counts[(token & U(CELLS - 1)).astype(np.int64)]
    n = len(token)
    if n >= 1 << PLACE_BITS or (n and line[-1] >= 1 << LINE_BITS):
        order = np.lexsort((token, rarity, line))
        return token[order], line[order]
    key = (line.astype(np.uint64) << U(RARITY_BITS + TOP_BITS + PLACE_BITS)) | (rarity.astype(np.uint64) << U(TOP_BITS + PLACE_BITS))
    key |= (token >> U(64 - TOP_BITS) << U(PLACE_BITS)) | np.arange(n, dtype=np.uint64)
    key.sort()
    token = token[(key & U((1 << PLACE_BITS) - 1)).astype(np.int64)]
    key >>= U(PLACE_BITS)
    line = (key >> U(RARITY_BITS + TOP_BITS)).astype(np.int64)
    # Different tokens whose line, rarity and top are equal are few; they are put in order by themselves.
    same = np.flatnonzero((key[1:] == key[:-1]) & (token[1:] != token[:-1]))
    if len(same):
        at = np.flatnonzero(np.isin(key, key[same]))
        token[at] = token[at[np.lexsort((token[at], key[at]))]]
    return token, line


class Lines:
    """The judged lines of a slice: owner, place and size, and their tokens, rarest first.

    ``set`` and ``other`` are two independent hashes of the set, ``bits`` its sketch.
    """

    def __init__(self, part: pa.RecordBatch, counts: np.ndarray, least: int, asked: Callable | None = None):
        found, key = words(part.column(1)), part.column(0).to_numpy()
        breaks = np.flatnonzero(found.data == 10)
        edge = np.unique(np.concatenate([found.edges[:-1], breaks + 1]))
        edge = edge[edge < len(found.data)]
        row = np.searchsorted(found.edges, edge, side="right") - 1
        place = np.searchsorted(breaks, edge) - np.searchsorted(breaks, found.edges[row])
        many = np.diff(np.searchsorted(found.start, np.append(edge, len(found.data))))
        good = many >= max(least, 1)
        owner = key[row]
        if asked is not None:
            good &= asked(owner, place)
        token = found.hash[np.repeat(good, many)]
        owner, place, many = owner[good], place[good], many[good]
        del found
        line = np.repeat(np.arange(len(many)), many)
        token, line = _rarest_first(token, line, counts)
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
        token, line = token[new], line[new]
        size = np.bincount(line, minlength=len(many))
        if least > 1:
            good = size >= least
            keep = good[line]
            token, line, owner, place, size = token[keep], (np.cumsum(good) - 1)[line[keep]], owner[good], place[good], size[good]
        self.owner, self.place, self.size, self.token, self.line = owner, place, size, token, line
        self.at = np.cumsum(size) - size
        none = np.empty(0, np.uint64)
        once = mix(token)
        self.set, self.other, self.bits = (
            (np.add.reduceat(once, self.at), np.add.reduceat(mix(once ^ MEET), self.at), np.bitwise_xor.reduceat(U(1) << (once >> U(58)), self.at)) if len(size) else (none, none, none)
        )
        self.position = np.arange(len(token)) - np.repeat(self.at, size)

    def wide(self) -> np.ndarray:
        """Sketches of WIDE words: each token turns one bit, so two sets differ in as many tokens as their sketches in bits, at least."""
        spread = mix(self.token ^ U(0xA5A5))
        bit, word = U(1) << (spread & U(63)), (spread >> U(6)) % U(WIDE)
        return np.stack([np.bitwise_xor.reduceat(np.where(word == U(k), bit, U(0)), self.at) for k in range(WIDE)], axis=1)


def _prefix(size: np.ndarray, t: float) -> np.ndarray:
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def word_counts(docs: DataFrame) -> np.ndarray:
    """For each of CELLS hash cells the binary logarithm of how often its words occur in all texts, in a byte."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(CELLS, np.uint32)
        for part in slices(batches):
            cell = np.sort((words(part.column(1)).hash & U(CELLS - 1)).astype(np.uint32))
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, np.int64)
            total[cell[first]] += np.diff(np.append(first, len(cell))).astype(np.uint32)
        return total

    return fixed_table(docs, count, np.uint32, CELLS, lambda sums: np.minimum(np.ceil(np.log2(sums.astype(float) + 1)), 31).astype(np.uint8))


#: What entries of lines under tokens hold: the token's MEET bits, the sketch, 32 bits of the set's hash, the line, its size and the token's
#: position in it. Entries under a line's first token, by which equal sets are settled, also hold both hashes whole.
ENTRY = (("token", np.uint64), ("bits", np.uint64), ("same", np.uint32), ("owner", np.uint32), ("place", np.uint32), ("size", np.uint32), ("position", np.uint32))


def _pack(lines: Lines, at: np.ndarray) -> bytes:
    """The entries of the tokens at these places, compressed; owners are places in a list of documents."""
    line = lines.line[at]
    docs, owner = np.unique(lines.owner[line], return_inverse=True)
    first = line[lines.position[at] == 0]
    columns = (lines.token[at] & MEET, lines.bits[line], lines.set[line], owner, lines.place[line], lines.size[line], lines.position[at])
    data = [docs.astype(np.int64), lines.set[first], lines.other[first], *(c.astype(kind) for c, (_, kind) in zip(columns, ENTRY, strict=True))]
    raw = b"".join(map(planes, data))
    return np.array([len(docs), len(first), len(at), len(raw)], np.uint32).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _count(data: bytes) -> int:
    return int(np.frombuffer(data, np.uint32, 4)[2])


def _unpack(data: bytes, share: int, shares: int) -> dict[str, np.ndarray]:
    """The entries whose token falls into one of ``shares`` shares."""
    n_docs, n_first, n, size = np.frombuffer(data, np.uint32, 4).tolist()
    raw = pa.decompress(data[16:], size, "zstd", asbytes=True)
    at, out = 0, []
    for kind, count in ((np.int64, n_docs), (np.uint64, n_first), (np.uint64, n_first), *((kind, n) for _, kind in ENTRY)):
        out.append(from_planes(raw, kind, count, at))
        at += out[-1].nbytes
    docs, whole, other = out[:3]
    held = dict(zip((name for name, _ in ENTRY), out[3:], strict=True))
    held["owner"] = docs[held["owner"]]
    for name in ("place", "size", "position"):
        held[name] = held[name].astype(np.int64)
    first = np.flatnonzero(held["position"] == 0)
    held["set"], held["other"] = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    held["set"][first], held["other"][first] = whole, other
    if shares > 1:
        mine = mix(held["token"] + U(3)) % U(shares) == U(share)
        held = {k: v[mine] for k, v in held.items()}
    return held


#: What is said of a line: a group in which it is to be verified, or (null) that it goes.
SAID = "doc_id long, line int, root long"


def _said(owner: np.ndarray, place: np.ndarray, root: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(place, pa.int32()), pa.nulls(len(owner), pa.int64()) if root is None else pa.array(root.view(np.int64))], ["doc_id", "line", "root"])


def _firsts(keys: tuple, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows grouped by equal keys: the row that comes first of each row's group, and which rows are first."""
    head = np.arange(len(owner))
    order = np.lexsort(keys)
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    order = order[~(new[:-1] & new[1:])]  # rows that are alone are first
    if len(order):
        order = order[np.lexsort((place[order], owner[order], *(k[order] for k in keys)))]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        head[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return head, head == np.arange(len(head))


def _groups(token, size, position, bits, t: float) -> np.ndarray:
    """A label for each row, sorted by token and size: rows joined by pairs that may match under their token share one.

    A pair passes if its lengths fit, if enough tokens are left from the shared one on in both, and if the two sets of
    bits differ in no more places than sets of that overlap can. Rows that share a label already are held against each other no more.
    """
    n = len(token)
    label, pairs = np.arange(n), [np.empty((2, 0), np.int64)]
    left, shift = np.arange(n), 1
    while True:
        left = left[left + shift < n]
        left = left[(token[left] == token[left + shift]) & (size[left] >= np.ceil(t * size[left + shift] - 1e-9))]
        if not len(left):
            break
        if shift > NEIGHBOURS:
            rest = np.flatnonzero(np.isin(token[:-1], token[left]) & (token[:-1] == token[1:]))
            pairs.append(np.stack([rest, rest + 1]))
            break
        one = left[label[left] != label[left + shift]]
        two = one + shift
        need = np.ceil(t / (1 + t) * (size[one] + size[two]) - 1e-9)
        good = np.minimum(size[one] - position[one], size[two] - position[two]) >= need
        good &= np.bitwise_count(bits[one] ^ bits[two]) <= size[one] + size[two] - 2 * need
        pairs.append(np.stack([one[good], two[good]]))
        if not shift & (shift - 1) or sum(p.shape[1] for p in pairs) > AT_ONCE:
            label, pairs = _joined(label, pairs)
        shift += 1
    return _joined(label, pairs)[0]


def _joined(label: np.ndarray, pairs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    moved = np.flatnonzero(label != np.arange(len(label)))
    a, b = np.concatenate([*pairs, np.stack([moved, label[moved]])], axis=1)
    return least_labels(len(label), a, b), [np.empty((2, 0), np.int64)]


def _asks(label, owner, place, size, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, group) for each row that shares its label: the number of the group's first line, or of each two blocks that may match."""
    many = np.bincount(label, minlength=len(label))
    row = np.flatnonzero(many[label] > 1)
    head, _ = _firsts((label[row],), owner[row], place[row])
    root = key_number(owner[row], place[row])[head]
    small = many[label[row]] <= BLOCK
    rows, roots = [row[small]], [root[small]]
    big = row[~small]
    for one in np.unique(label[big]):
        group = big[label[big] == one]
        group = group[np.lexsort((place[group], owner[group], size[group]))]
        blocks = np.array_split(group, -(-len(group) // BLOCK))
        name = root[np.searchsorted(row, group[0])]
        for i, a in enumerate(blocks):
            for j, b in enumerate(blocks[i:], i):
                if size[a[-1]] >= t * size[b[0]] - 1e-9:
                    both = a if i == j else np.concatenate([a, b])
                    rows.append(both)
                    roots.append(np.full(len(both), mix(np.array([name + U(i << 32 | j) + U(1)]))[0]))
    return np.concatenate(rows), np.concatenate(roots)


def met(docs: DataFrame, counts: np.ndarray, t: float, least: int) -> DataFrame:
    """SAID after the first meeting."""
    spark = docs.sparkSession
    buckets = parts(spark)
    sent_counts = spark.sparkContext.broadcast(counts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "doc_id", "line", "root", "entries"]
        for part in slices(batches):
            lines = Lines(part, sent_counts.value, least)
            if not len(lines.size):
                continue
            # Equal sets of this slice: the first is sent, the others are settled.
            head, first = _firsts((lines.other, lines.set), lines.owner, lines.place)
            later = (lines.owner != lines.owner[head]) | (lines.place != lines.place[head])
            if later.any():
                gone = _said(lines.owner[later], lines.place[later])
                yield pa.RecordBatch.from_arrays([pa.array(lines.owner[later] % buckets, pa.int32()), *gone.columns, pa.nulls(gone.num_rows, pa.binary())], names)
            pick = np.flatnonzero(first[lines.line] & (lines.position < _prefix(lines.size, t)[lines.line]))
            bucket = (mix(lines.token[pick] & MEET) % U(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(edges))
            for at in range(0, len(used), 256):
                some = used[at : at + 256]
                data = [_pack(lines, pick[by[edges[k] : edges[k + 1]]]) for k in some]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(data, pa.binary())], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            said = batch.filter(batch.column("doc_id").is_valid())
            if said.num_rows:
                yield said.select(["doc_id", "line", "root"])
            held += [x.as_py() for x in batch.column("entries") if x.is_valid]
        # Lines that may match share a token, so the tokens are taken in shares of a size that memory holds.
        shares = -(-sum(map(_count, held)) // AT_ONCE)
        for share in range(shares):
            taken = [_unpack(x, share, shares) for x in held]
            e = {name: np.concatenate([x[name] for x in taken]) for name in taken[0]}
            del taken
            # Equal sets have the same first token, under which they are settled.
            first = np.flatnonzero(e["position"] == 0)
            owner, place = e["owner"][first], e["place"][first]
            head, _ = _firsts((e["other"][first], e["set"][first]), owner, place)
            gone = (owner != owner[head]) | (place != place[head])
            yield _said(owner[gone], place[gone])
            # Tokens of a single entry end here.
            order = np.argsort(e["token"])
            alone = np.ones(len(order), bool)
            same = e["token"][order][1:] == e["token"][order][:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
            order = order[~alone]
            e = {name: e[name][order] for name in ("token", "bits", "same", "owner", "place", "size", "position")}
            _, first = _firsts((mix(e["same"].astype(np.uint64) ^ mix(e["bits"])), e["token"]), e["owner"], e["place"])
            order = np.flatnonzero(first)
            order = order[np.lexsort((e["size"][order], e["token"][order]))]
            e = {name: column[order] for name, column in e.items()}
            row, root = _asks(_groups(e["token"], e["size"], e["position"], e["bits"], t), e["owner"], e["place"], e["size"], t)
            owner, place = e["owner"][row], e["place"][row]
            once = np.unique(np.stack([owner, place, root.view(np.int64)]), axis=1) if len(row) else np.empty((3, 0), np.int64)
            yield _said(once[0], once[1], np.ascontiguousarray(once[2]))

    sent = docs.mapInArrow(send, "bucket int, doc_id long, line int, root long, entries binary")
    return sent.repartition(buckets, "bucket").mapInArrow(meet, SAID)


def sets_of(docs: DataFrame, lines: DataFrame, counts: np.ndarray, least: int) -> DataFrame:
    """(doc_id, line, size, sketch, tokens) of at least the given lines(doc_id, line): those that a filter of fixed size lets through."""
    spark = docs.sparkSession
    sent_counts, sent_filter = spark.sparkContext.broadcast(counts), spark.sparkContext.broadcast(key_filter(lines.select("doc_id", "line")))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lines = Lines(part, sent_counts.value, least, partial(in_filter, sent_filter.value))
            if len(lines.size):
                tokens = np.ascontiguousarray(lines.token.view(np.uint8).reshape(-1, 8)[:, :WIDTH]).reshape(-1)
                columns = [pa.array(lines.owner, pa.int64()), pa.array(lines.place, pa.int32()), pa.array(lines.size, pa.int32()), _binary(lines.wide().view(np.uint8), np.arange(len(lines.size) + 1) * 8 * WIDE), _binary(tokens, np.append(lines.at, len(lines.token)) * WIDTH)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line", "size", "sketch", "tokens"])

    return cut(docs.mapInArrow(send, "doc_id long, line int, size int, sketch binary, tokens binary"), "line-sets")


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


#: The likeliest match of a line in a group: in how many bits the sketches differ and which line it is; and the smallest and
#: the largest number of a line that may match.
LIKELY = "doc_id long, line int, root long, differ int, to_doc long, to_line int, low long, high long"


def likely(sets: DataFrame, said: DataFrame, t: float) -> DataFrame:
    """LIKELY for each line and group of said in which an earlier line may match, by the sketches."""

    def compare(root, owner, place, size, sketch) -> pa.RecordBatch:
        order = np.lexsort((place, owner, size, root))
        root, owner, place, size, sketch = root[order], owner[order], place[order], size[order], sketch[order]
        n, number = len(root), key_number(owner, place)
        best, to = np.full(n, 1 << 30), np.zeros(n, np.int64)
        low, high = np.full(n, np.iinfo(np.uint64).max), np.zeros(n, np.uint64)
        left, shift = np.arange(n), 1
        while len(left := left[left + shift < n]):
            left = left[(root[left] == root[left + shift]) & (size[left] >= np.ceil(t * size[left + shift] - 1e-9))]
            one, two = left, left + shift
            need = np.ceil(t / (1 + t) * (size[one] + size[two]) - 1e-9)
            differ = np.bitwise_count(sketch[one] ^ sketch[two]).sum(axis=1, dtype=np.int64)
            good = (differ <= size[one] + size[two] - 2 * need) & (number[one] != number[two])
            one, two, differ = one[good], two[good], differ[good]
            before = (owner[one] < owner[two]) | ((owner[one] == owner[two]) & (place[one] < place[two]))
            for x, y, d in ((two[before], one[before], differ[before]), (one[~before], two[~before], differ[~before])):
                low[x], high[x] = np.minimum(low[x], number[y]), np.maximum(high[x], number[y])
                first = (owner[y] < owner[to[x]]) | ((owner[y] == owner[to[x]]) & (place[y] < place[to[x]]))
                better = (d < best[x]) | ((d == best[x]) & first)
                best[x[better]], to[x[better]] = d[better], y[better]
            shift += 1
        x = np.flatnonzero(best < 1 << 30)
        columns = (owner[x], place[x], root[x], best[x], owner[to[x]], place[to[x]], low[x].view(np.int64), high[x].view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], [c.split()[0] for c in LIKELY.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, WIDE)
            held.append((*(batch.column(c).to_numpy() for c in ("root", "doc_id", "line", "size")), sketch))
            if sum(len(h[0]) for h in held) >= SKETCHES:  # what is left of the last group waits for the next batch
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                end = int(np.searchsorted(columns[0], columns[0][-1]))
                if end:
                    yield compare(*(c[:end].astype(np.int64) if k != 4 else c[:end] for k, c in enumerate(columns)))
                held = [tuple(c[end:] for c in columns)]
        if held:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield compare(*(c.astype(np.int64) if k != 4 else c for k, c in enumerate(columns)))

    rows = _joined_sets(sets.select("doc_id", "line", "size", "sketch"), said).select("root", "doc_id", "line", "size", "sketch")
    return rows.repartition(parts(rows.sparkSession), "root").sortWithinPartitions("root").mapInArrow(work, LIKELY)


def _joined_sets(sets: DataFrame, said: DataFrame) -> DataFrame:
    """The sets' rows, once for each group of said."""
    asked = said.groupBy(F.col("doc_id").alias("_doc_id"), F.col("line").alias("_line")).agg(F.collect_set("root").alias("_roots"))
    return sets.join(asked, (F.col("doc_id") == F.col("_doc_id")) & (F.col("line") == F.col("_line"))).withColumn("root", F.explode("_roots")).drop("_doc_id", "_line", "_roots")


def verified(sets: DataFrame, said: DataFrame, t: float) -> DataFrame:
    """(doc_id, line) of the lines that an earlier line matches in one of the groups of said(doc_id, line, root)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        earlier: dict[int, list[tuple]] = {}  # by size: sets of the group, each with the first line that holds it
        seen: set[bytes] = set()
        for batch in batches:
            gone = []
            for root, owner, place, tokens in zip(*(batch.column(c).to_pylist() for c in ("root", "doc_id", "line", "tokens")), strict=True):
                if root != group:
                    group, earlier, seen = root, {}, set()
                mine = frozenset([tokens[k : k + WIDTH] for k in range(0, len(tokens), WIDTH)])
                n = len(mine)
                for size in sorted(range(math.ceil(t * n - 1e-9), int(n / t + 1e-9) + 1), key=lambda s: abs(s - n)) if earlier else ():
                    need = math.ceil(t / (1 + t) * (n + size) - 1e-9)
                    if any(len(mine & other) >= need and (o, p) != (owner, place) for other, o, p in earlier.get(size, ())):
                        gone.append((owner, place))
                        break
                if tokens not in seen:
                    seen.add(tokens)
                    earlier.setdefault(n, []).append((mine, owner, place))
            if gone:
                owner, place = zip(*gone, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(place, pa.int32())], ["doc_id", "line"])

    rows = _joined_sets(sets.select("doc_id", "line", "tokens"), said).select("root", "doc_id", "line", "tokens")
    return rows.repartition(parts(rows.sparkSession), "root").sortWithinPartitions("root", "doc_id", "line").mapInArrow(judge, "doc_id long, line int").distinct()


def later_matches(docs: DataFrame, t: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """(doc_id, lines): for each document that has any, the places of its lines that an earlier line matches."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = word_counts(texts)
    said = cut(met(texts, counts, t, least), "line-groups")
    asked = said.filter("root is not null")
    sets = sets_of(texts, asked, counts, least)
    found = cut(likely(sets, asked, t), "line-likely")
    best = found.groupBy("doc_id", "line").agg(F.min(F.struct("differ", "to_doc", "to_line")).alias("to"), (F.min(F.least("low", "high")) < F.max(F.greatest("low", "high"))).alias("several"))
    best = best.select("doc_id", "line", "several", "to.to_doc", "to.to_line", F.xxhash64("to.to_doc", "to.to_line").alias("root"))
    best = cut(best, "line-best")
    one = cut(verified(sets, best.select("doc_id", "line", "root").union(best.select("to_doc", "to_line", "root").distinct()), t), "line-one")
    open_ = best.filter("several").join(one, ["doc_id", "line"], "left_anti").select("doc_id", "line")
    groups = found.join(open_, ["doc_id", "line"], "left_semi").select("root").distinct()
    rest = verified(sets, asked.join(groups, "root", "left_semi"), t)
    gone = said.filter("root is null").select("doc_id", "line").union(one).union(rest)
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(DOC_BITS))


def strip(docs: DataFrame, t: float = SIMILARITY, least: int = LEAST) -> tuple[DataFrame, str, str]:
    """The rows and columns of docs, text without later matches, and the names of two columns more: lines and removed."""
    key, gone, n_lines, n_removed, cell, bits = (free(docs, n) for n in ("_key", "_gone", "_lines", "_removed", "_cell", "_bits"))
    marks = cut(later_matches(docs, t, least), "line-marks").select(F.col("doc_id").alias(key), F.col("lines").alias(gone))
    own = F.col("doc_id").cast("long")
    # At most DOC_BITS / 64 rows, whatever the input.
    held = F.broadcast(marks.groupBy(F.shiftright(_bit(F.col(key)), 6).alias(cell)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), 64) as int))")).alias(bits)))
    filtered = docs.join(held, F.shiftright(_bit(own), 6) == F.col(cell), "left")
    hit = F.expr(f"coalesce(shiftright(`{bits}`, cast(pmod(xxhash64(cast(doc_id as bigint)), 64) as int)) & 1L, 0L) = 1L")
    text, columns = F.col("text").cast("string"), [F.col(f"`{c}`") for c in docs.columns]
    lines = F.split(text, "\n")
    count = F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias(n_lines)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    # In an array of one, so that a text is split once and not for each line.
    kept = F.array_join(F.get(F.transform(F.array(lines), lambda held: F.transform(left, lambda k: F.get(held, k))), F.lit(0)), "\n")

    def shown(value: Column) -> list[Column]:
        return [value.alias("text") if c == "text" else column for c, column in zip(docs.columns, columns, strict=True)]

    may = filtered.filter(hit).select(*columns).join(marks.hint("shuffle_hash"), own == F.col(key), "left")
    may = may.select(*shown(F.when(F.col(gone).isNull(), text).otherwise(kept)), count, F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_removed))
    rest = filtered.filter(~hit).select(*shown(text), count, F.lit(0).cast("long").alias(n_removed))
    return may.union(rest), n_lines, n_removed
