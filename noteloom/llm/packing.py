"""Best-fit packing by exact complements.

A document's token ids are cut into pieces of at most ``size`` tokens. The plan is made from
the histogram of piece lengths alone, which has at most ``size`` rows however many documents
there are: single, pair and triple length sums that exactly fill a gap are looked up by hash and consumed as often
as the counts of their lengths allow, and what fills none is packed best-fit, longest first. The
plan is a list of slots ``(length, first rank, number of sequences, first sequence, offset)``;
each piece finds its place from its length and its rank among the pieces of that length, which
is found by counts per block of documents, so no length is ever gathered in one task.

Defined results: a null or empty text has the closing id alone (one piece of length 1); an
empty table gives no rows; repeated rows each get places of their own; very long texts are cut into pieces and
lose nothing; a null doc_id is a key like any other; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import cut, parts, ship

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Texts are encoded in slices of about so many characters, so that memory does not follow the batch.
ENCODE_CHARS = 2_000_000


#: A whitespace run of two or more that holds a space; texts with one are encoded in one go.
SPACE_RUN = re.compile(r" \s|\s ")
#: Entries of a worker's table from space-led chunks to their ids, after which it starts anew.
CHUNKS_KEPT = 250_000


class ChunkEncoder:
    """Texts to their ids as little-endian unsigned 32-bit numbers, in bytes.

    The ids are those of the ``tokenizers`` file ``vocabulary``. Byte-level BPE splits before a lone
    space in every case, so a text's ids are those of its space-led chunks in order; each chunk is
    encoded once and looked up afterwards. ``ranks`` is the same vocabulary as ranks: single chunks
    are merged by it, which costs a tenth of a call to the tokenizer; texts in which chunks do not
    split, or that hold a special token's string, go to the tokenizer whole.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            merged = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merged, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if SPACE_RUN.search(text) or "\0" in text or any(x in text for x in self.special):
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            chunks = text.replace(" ", "\0 ").split("\0")
            if new := [c for c in set(chunks) if c not in self.known]:
                if len(self.known) + len(new) > CHUNKS_KEPT:
                    self.known, new = {}, list(set(chunks))
                for chunk in new:
                    ids = self.merge(chunk)
                    self.known[chunk] = struct.pack(f"<{len(ids)}I", *ids)
            yield b"".join(map(self.known.__getitem__, chunks))


@lru_cache(maxsize=1)
def _encoder(vocabulary: str, ranks: str, pattern: str) -> ChunkEncoder:
    """One per worker process, kept from task to task."""
    return ChunkEncoder(vocabulary, ranks, pattern)


def token_pieces(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, size: int, closing_id: int) -> DataFrame:
    """PIECES of every document: its ids and the closing id, cut from the end into pieces of ``size``.

    Only a document longer than ``size`` is cut; its first piece takes the remainder.
    ids_crc32 is the CRC-32 of the piece's ids as little-endian unsigned 32-bit numbers.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, close = _encoder(vocabulary, ranks, pattern), np.array([closing_id], dtype="<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end] or "") <= ENCODE_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                out: list[tuple] = []
                for key, found in zip(keys[at:end], encoder.ids([t or "" for t in texts[at:end]]), strict=True):
                    ids = memoryview(found + close)
                    start, piece = 0, 0
                    count = len(ids) // 4
                    while start < count:
                        length = (count - start) % size or size
                        out.append((key, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                        start, piece = start + length, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
                at = end

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, PIECES)


class Sums:
    """Which lengths are left and how many of each, with their single and pair sums; a length that is used up never comes back."""

    def __init__(self, counts: dict[int, int], size: int):
        self.left = {k: n for k, n in counts.items() if n > 0}
        self.lengths = sorted(self.left)
        self.size = size
        #: For each sum the larger halves of pairs that may still make it, largest last.
        self.halves: dict[int, list[int]] = {}

    def use(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect_left(self.lengths, length))

    def pair(self, total: int) -> tuple[int, int] | None:
        """The pair of lengths left that makes the sum, with the largest length there is."""
        if total not in self.halves:
            self.halves[total] = [b for b in self.lengths if total <= 2 * b < 2 * total and total - b in self.left]
        held = self.halves[total]
        while held:
            b = held[-1]
            if b in self.left and self.left.get(total - b, 0) > (2 * b == total):
                return b, total - b
            held.pop()
        return None

    def filling(self, length: int, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths left, the given one and none longer, that fill the gap exactly."""
        rest = gap - length
        if not rest:
            return (length,)
        if rest <= length and self.left.get(rest, 0) > (rest == length):
            return length, rest
        found = self.pair(rest)
        # A pair whose longer half is not the longest piece that fits would take the place of a longer one.
        if found and found[0] == self.lengths[bisect_left(self.lengths, min(rest, length) + 1) - 1] and self.left[length] > found.count(length):
            return length, *found
        return None


def plan_slots(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first_rank, sequences, first_sequence, offset) that place counts[length] pieces of each length.

    The longest piece left looks at the tightest gap that holds it, and starts a sequence where there is none. If it fills the gap by itself, with one piece more or
    with two more, such a combination is used as often as its counts and the gap's allow; else it is put there by best
    fit, and what remains is a gap again. Of two more the longer one has to be the longest that fits: combinations of
    shorter pieces take the gaps that longer ones need later (measured: up to 2 % more sequences on small tables). Each step uses up a
    length, a gap or a combination, so the work grows with ``size``, not with the counts.
    """
    sums = Sums(counts, size)
    if any(not 0 < k <= size for k in sums.left):
        raise ValueError("a length does not fit a sequence")
    used: dict[int, int] = dict.fromkeys(sums.left, 0)
    slots: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many)
    gaps: list[int] = []
    sequences = 0

    def put(pattern: tuple[int, ...], times: int, first: int, offset: int) -> None:
        for k in pattern:
            slots.append((k, used[k], times, first, offset))
            used[k] += times
            sums.use(k, times)
            offset += k

    def open_gap(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in groups:
                insort(gaps, gap)
            groups.setdefault(gap, []).append((first, n))

    while sums.lengths:
        head = sums.lengths[-1]
        at = bisect_left(gaps, head)
        if at == len(gaps):
            n = max(1, sums.left[head] // (size // head))
            put((head,), n, sequences, 0)
            open_gap(size - head, sequences, n)
            sequences += n
            continue
        gap = gaps[at]
        first, n = groups[gap].pop()
        if not groups[gap]:
            del groups[gap]
            gaps.pop(at)
        pattern = sums.filling(head, gap) or (head,)
        times = min(n, *(sums.left[k] // pattern.count(k) for k in pattern))
        put(pattern, times, first, size - gap)
        open_gap(gap - sum(pattern), first, times)
        open_gap(gap, first + times, n - times)
    return slots


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """pieces (written before, with doc_id, piece and length) with sequence_id and offset.

    Pieces of full length need no plan row of their own kind: they are slots like any other.
    """
    spark = pieces.sparkSession
    blocks = max(64, 4 * parts(spark))
    held = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    per_block = held.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("n"))
    per_block = cut(per_block, "piece-counts")
    histogram = {r["length"]: r["n"] for r in per_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    slots = spark.createDataFrame(plan_slots(histogram, size), "length long, first_rank long, sequences long, first_sequence long, offset long")
    before = per_block.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_block")) - F.col("n")).drop("n")
    local = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "start")
    ranked = held.withColumn("_rank", F.row_number().over(local) - 1).join(before, ["length", "_block"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    per_length = F.broadcast(slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "sequences", "first_sequence", "offset"))).alias("_slots")))  # at most ``size`` rows
    found = F.expr("filter(_slots, s -> _rank >= s.first_rank AND _rank < s.first_rank + s.sequences)[0]")
    placed = ranked.join(per_length, "length").withColumn("_slot", found)
    return placed.select(
        *[F.col(f"`{c}`") for c in pieces.columns],
        (F.col("_slot.first_sequence") + F.col("_rank") - F.col("_slot.first_rank")).alias("sequence_id"),
        F.col("_slot.offset").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, size: int = 1024, closing_id: int = 2) -> DataFrame:
    """One row per piece of docs(doc_id, text): PIECES, sequence_id and offset."""
    return pack(cut(token_pieces(docs, vocabulary, ranks, pattern, size, closing_id), "pieces"), size)
