"""SimHash near-duplicates by a Gray-ordered hierarchical index.

Fingerprints are made distinct and sorted by their rank in Gray order, in which neighbours share
long runs of bits. The index factors those shared masked patterns into upper nodes: a node of a
level holds one pattern of the leading bits, and its children the patterns of the next segment. A
search walks down level by level, adds up the differences seen so far, and drops a node with all
that lies under it as soon as the sum passes the limit.

Fingerprints within the limit of k bits agree in one of k + 1 stretches of bits, so there is an index
for each stretch, turned to lead; its blocks are ranges of the Gray order, and every fingerprint is
dealt out k + 1 times. A block answers with links to the smallest member of what it found connected, at
most one for each fingerprint it was given.

Defined results: words are runs of characters other than the six ASCII white-space characters; a
text with fewer words than a shingle is one shingle; a null, empty or blank text has fingerprint 0
and is linked like any other; equal texts share a fingerprint and so a component; rows whose key is
null keep their fingerprint and get no component; very long texts are taken whole; of a group the smallest doc_id
is the first, and rows that repeat a doc_id stay or go together; other columns, whatever their names, are carried along; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import cut, free, in_filter, key_filter, least_labels, parts, ship
from noteloom.llm.links import components
from noteloom.llm.words import BASE, mix, slices, words

SEED = 42
BITS = 64
#: Fingerprints a block should hold; the number of leading bits that make a block follows from it.
PER_BLOCK = 1 << 14
#: Queries searched at once, and bits that a level of the index adds.
AT_ONCE, SEGMENT = 2048, 8


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` lower-cased (A-Z) words joined by single spaces."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint): the fingerprint as a signed 64-bit number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(shingle_hashes(t.as_py(), width)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fingerprint"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, fingerprint long")


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Places of 64-bit patterns in Gray order."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A hierarchy over distinct fingerprints in Gray order, whose top nodes are the patterns of the ``lead`` leading bits."""

    def __init__(self, prints: np.ndarray, lead: int = 0):
        rank = gray_rank(prints)
        self.order = np.argsort(rank, kind="stable")
        self.prints = prints[self.order]
        self.bits = [lead, *range(lead + SEGMENT, BITS, SEGMENT), BITS]
        n = len(prints)
        self.leaf: list[np.ndarray] = []  # by level: the first leaf below each node, whose leading bits are the node's pattern
        for b in self.bits:
            key = _leading(self.prints, b)
            new = np.ones(n, bool)
            new[1:] = key[1:] != key[:-1]
            self.leaf.append(np.flatnonzero(new))
        self.ends = [np.append(x[1:], n) for x in self.leaf]
        self.children = []
        for upper, lower in zip(self.leaf[:-1], self.leaf[1:], strict=True):
            first = np.searchsorted(lower, upper)
            self.children.append((first, np.append(first[1:], len(lower))))
        self.top = _leading(rank[self.order][self.leaf[0]], lead)

    def search(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place in the given prints) with the same leading bits that differ in at most ``most`` bits."""
        found_q, found_p = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(queries), AT_ONCE):
            part = queries[at : at + AT_ONCE]
            lead = _leading(gray_rank(part), self.bits[0])
            node = np.minimum(np.searchsorted(self.top, lead), len(self.top) - 1)
            q = np.flatnonzero(self.top[node] == lead)
            node, so_far = node[q], np.zeros(len(q), np.uint8)
            for level, b in enumerate(self.bits[:-1]):
                single = self.ends[level][node] - self.leaf[level][node] == 1
                if single.any():  # nothing is shared below: the leaf itself is compared
                    leaf = self.leaf[level][node[single]]
                    near = np.bitwise_count(part[q[single]] ^ self.prints[leaf]) <= most
                    found_q.append(q[single][near] + at)
                    found_p.append(leaf[near])
                    q, node, so_far = q[~single], node[~single], so_far[~single]
                first, end = self.children[level]
                many = end[node] - first[node]
                step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                q, so_far, node = np.repeat(q, many), np.repeat(so_far, many), np.repeat(first[node], many) + step
                below = self.bits[level + 1]
                mask = np.uint64(((1 << (below - b)) - 1) << (BITS - below))
                so_far = so_far + np.bitwise_count((part[q] ^ self.prints[self.leaf[level + 1][node]]) & mask)
                keep = so_far <= most
                q, node, so_far = q[keep], node[keep], so_far[keep]
            found_q.append(q + at)
            found_p.append(self.leaf[-1][node])
        return np.concatenate(found_q), self.order[np.concatenate(found_p)]


def _leading(values: np.ndarray, bits: int) -> np.ndarray:
    return values >> np.uint64(BITS - bits) if bits else np.zeros(len(values), np.uint64)


def turned(prints: np.ndarray, by: int) -> np.ndarray:
    """The patterns turned left by so many bits."""
    return (prints << np.uint64(by)) | (prints >> np.uint64(BITS - by)) if by else prints


def links(prints: DataFrame, most: int, distinct: int, per_block: int = PER_BLOCK) -> DataFrame:
    """(a, b): links between ids of prints(id, fingerprint), distinct fingerprints, that connect what differs in at most ``most`` bits.

    The bits are cut into ``most`` + 1 stretches. Fingerprints within the limit agree in one stretch at
    least, so there is an index for each stretch, with the bits turned until it leads; the index's
    blocks are ranges of its Gray order. Each fingerprint is dealt out ``most`` + 1 times, however many there are.
    """
    cuts = np.linspace(0, BITS, most + 2).astype(int)
    stretches = [(int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    block_bits = min(int(min(w for _, w in stretches)), max(0, (max(distinct, 1) - 1) // per_block).bit_length())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(1).to_numpy().view(np.uint64)
            for k, (by, _) in enumerate(stretches):
                own = turned(prints, by)
                block = _leading(gray_rank(own), block_bits).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block * len(stretches) + k), batch.column(0), pa.array(own.view(np.int64))], ["block", "id", "fingerprint"])

    def search(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")  # so that the smallest label is the smallest id
        ids, prints = ids[order], table.column("fingerprint").to_numpy().view(np.uint64)[order]
        q, p = GrayIndex(prints, stretches[key[0].as_py() % len(stretches)][1]).search(prints, most)
        label = least_labels(len(ids), q, p)
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[moved], pa.int64()), "b": pa.array(ids[label[moved]], pa.int64())})

    ship(prints.sparkSession)
    dealt = prints.select("id", "fingerprint").mapInArrow(route, "block long, id long, fingerprint long")
    return dealt.groupBy("block").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (signed) and component_id, the smallest doc_id that links reach."""
    prints = cut(fingerprints(docs, width), "fingerprints")
    groups = cut(prints.filter("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("id")), "distinct-fingerprints")
    found = components(links(groups, most, groups.count()))
    roots = groups.join(found, groups["id"] == found["node"], "left").select(F.col("fingerprint").alias("_fingerprint"), F.coalesce("root", "id").alias("component_id"))
    rows = prints.join(roots, prints["fingerprint"] == roots["_fingerprint"], "left")
    return rows.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


#: Words of 64 bits in a wide fingerprint, and how many of them travel with an entry of the index of leads.
WIDE, SENT = 4, 2
#: Least bits of a lead, bits by which fingerprints outnumber leads at most, and the chance with which two texts just at the limit share a lead.
LEAD, CROWD, FOUND = 16, 8, 0.99
#: Standard deviations by which the bits of a candidate pair may exceed those expected at the limit.
SPREADS = 3.0
#: A shingle of a set is a hash of 48 bits, behind which the text's place in its slice is put where many sets are made at once.
SHINGLE_BITS = 48
#: Parts over which the members of one group are dealt.
SALTS = 16
#: Entries that a task compares at once.
ENTRIES = 600_000


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text of a column (at most 65,536 texts), as hashes in order, and how many each has."""
    found = words(column, lower=True)
    n, many, h = len(column), found.per_text(), found.hash
    if n > 1 << (64 - SHINGLE_BITS):
        raise ValueError("too many texts at once")
    text, first = np.repeat(np.arange(n), many), np.cumsum(many) - many
    step = np.uint64(BASE)
    whole = np.flatnonzero(text[: len(h) - width + 1] == text[width - 1 :]) if len(h) >= width else np.empty(0, np.int64)
    short = np.flatnonzero((many > 0) & (many < width))
    out = []
    for owner, start, size in ((text[whole], whole, np.full(len(whole), width)), (short, first[short], many[short])):
        made = size.astype(np.uint64)
        for k in range(width):
            made = np.where(k < size, made * step + h[np.minimum(start + k, len(h) - 1)], made) if len(h) else made
        out.append((owner.astype(np.uint64) << np.uint64(SHINGLE_BITS)) | (mix(made) >> np.uint64(64 - SHINGLE_BITS)))
    key = np.sort(np.concatenate(out))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key & np.uint64((1 << SHINGLE_BITS) - 1), np.bincount((key >> np.uint64(SHINGLE_BITS)).astype(np.int64), minlength=n)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE fingerprints of the same shingles, each of hashes mixed anew."""
    ones = np.zeros(WIDE * BITS, np.int64)
    for at in range(0, len(hashes), 255 * 64):  # eight counters of a byte to a word, which 255 rows cannot overflow
        part = hashes[at : at + 255 * 64]
        made = mix(part[:, None] + np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(BASE))
        bits = np.unpackbits(made.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").view(np.uint64)
        for row in range(0, len(part), 255):
            ones += bits[row : row + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def most_bits(similarity: float, bits: int) -> int:
    """Bits of so many in which texts whose shingle sets have this Jaccard similarity differ at most, but for rare chance."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + SPREADS * math.sqrt(bits * p * (1 - p)))


def leads(distinct: int, similarity: float) -> list[np.ndarray]:
    """The bits that lead each index: so many that few texts share a lead by chance, and so many indexes that texts at the limit do."""
    size = max(LEAD, math.ceil(math.log2(max(distinct, 2))) - CROWD)
    share = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** size
    rng = np.random.default_rng(SEED)
    return [np.sort(rng.choice(WIDE * BITS, size, replace=False)) for _ in range(math.ceil(math.log(1 - FOUND) / math.log(1 - share)))]


def near_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): linked are texts whose shingle sets have a Jaccard similarity of at least ``similarity``.

    At 0.8 fingerprints of 64 bits differ in about 10 bits, too many for an index of stretches. Wide fingerprints
    go to one index for each of many leads (``leads``): fingerprints are sorted by the Gray rank of the bits that lead, those with
    equal leads are a node, and within a node pairs are dropped as soon as the differences added up word by word pass the limit.
    Texts with a similarity at the limit share some lead with a chance of FOUND, nearer ones more often. What an index joins
    becomes a group; for each text the nearest smaller one of its groups is verified on the shingle sets themselves. Of the
    groups only those that this leaves in several components are looked at again, and their pairs across components verified too.
    A set is known by a hash of 64 bits.
    """
    names = [f"f{k}" for k in range(WIDE)]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _some(batches):
            held, many = shingle_sets(part.column(1), width)
            end = np.cumsum(many)
            made = np.array([wide_fingerprint(held[b - n : b]) if n else np.zeros(WIDE, np.uint64) for b, n in zip(end.tolist(), many.tolist(), strict=True)], np.uint64).reshape(-1, WIDE).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(np.ascontiguousarray(made[:, k])) for k in range(WIDE)], pa.array(_names(held, many).view(np.int64))], ["doc_id", *names, "same"])

    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
    made = cut(texts.mapInArrow(prints, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", same long"), "wide-fingerprints")
    distinct = cut(made.groupBy("same").agg(*[F.min(n).alias(n) for n in names], F.min("doc_id").alias("id")), "distinct-wide")
    met = cut(_met(distinct.select("same", *names), leads(distinct.count(), similarity), most_bits(similarity, SENT * BITS)), "near-met")
    best = met.filter("near is not null").groupBy("same").agg(F.min(F.struct("differ", "near")).alias("x")).select(F.col("x.near").alias("a"), F.col("same").alias("b"))
    best = cut(best, "near-best")
    asked = cut(distinct.join(met.select("same").distinct(), "same", "left_semi").select("same", "id"), "near-asked")
    sets = _sets(texts, asked, width)
    sure = cut(_verified(best, sets, similarity), "near-sure")
    known = cut(components(sure), "near-roots")
    more = cut(_across(met.select("same", "root").distinct(), distinct.select("same", *names), known, most_bits(similarity, WIDE * BITS)), "near-across")
    found = components(sure.union(_verified(more.join(best, ["a", "b"], "left_anti"), sets, similarity)))
    # A set that a third of all texts share, or a group of that size, is dealt out over SALTS; only what has several members is joined.
    rows = made.select("doc_id", "same", F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("_salt"))
    salted = lambda few: few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.join(salted(found.select(F.col("node").alias("same"), "root")), ["same", "_salt"], "left").select("doc_id", "_salt", F.coalesce("root", "same").alias("_root"))
    first = rows.groupBy("_root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(salted(first), ["_root", "_salt"], "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        for at in range(0, part.num_rows, 1 << (64 - SHINGLE_BITS)):
            yield part.slice(at, 1 << (64 - SHINGLE_BITS))


def _names(held: np.ndarray, many: np.ndarray) -> np.ndarray:
    """A number for each set of hashes, by its members and size; 0 for none."""
    total = np.append(np.uint64(0), np.cumsum(mix(held)))
    end = np.cumsum(many)
    return np.where(many > 0, mix(total[end] - total[end - many] + many.astype(np.uint64)), np.uint64(0))


#: What an index says of a set: the smallest set of its group, and the nearest smaller set that it met, if it met one.
MET = "same long, root long, near long, differ int"


def _met(rows: DataFrame, tables: list[np.ndarray], most: int) -> DataFrame:
    """MET of rows(same, f0, ...) from the indexes of all leads."""
    buckets = parts(rows.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                same, wide = part.column(0).to_numpy().view(np.uint64), np.stack([part.column(1 + k).to_numpy().view(np.uint64) for k in range(WIDE)], axis=1)
                bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").astype(np.uint64)
                node = np.stack([gray_rank(bits[:, lead] @ (np.uint64(1) << np.arange(len(lead), dtype=np.uint64))) * np.uint64(len(tables)) + np.uint64(k) for k, lead in enumerate(tables)], axis=1).ravel()
                row = np.repeat(np.arange(len(same)), len(tables))
                bucket = (mix(node) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
                used = np.flatnonzero(np.diff(edges))
                data = [np.column_stack([node[w], same[row[w]], wide[row[w], :SENT]]).T.tobytes() for w in (by[edges[k] : edges[k + 1]] for k in used)]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(data, pa.binary())], ["bucket", "entries"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x.as_py() for batch in batches for x in batch.column(1)]
        shares = -(-sum(map(len, held)) // (8 * (2 + SENT) * ENTRIES))
        for share in range(shares):
            every = [np.frombuffer(x, np.uint64).reshape(2 + SENT, -1) for x in held]
            columns = np.concatenate([x[:, mix(x[0] + np.uint64(5)) % np.uint64(shares) == share] for x in every], axis=1)
            del every
            columns = columns[:, np.lexsort((columns[1], columns[0]))]
            new = np.append(True, columns[0][1:] != columns[0][:-1]) if columns.shape[1] else np.empty(0, bool)
            alone = new & np.append(new[1:], True) if len(new) else new
            node, same, *wide = columns[:, ~alone]
            row, root, near, differ = _nearest(node, same.view(np.int64), wide, most)
            yield pa.RecordBatch.from_arrays([pa.array(same.view(np.int64)[row]), pa.array(root), pa.array(near, mask=differ < 0), pa.array(differ.astype(np.int32), mask=differ < 0)], ["same", "root", "near", "differ"])

    return rows.mapInArrow(send, "bucket int, entries binary").repartition(buckets, "bucket").mapInArrow(meet, MET).distinct()


def _nearest(node: np.ndarray, same: np.ndarray, wide: list[np.ndarray], most: int) -> tuple[np.ndarray, ...]:
    """(row, smallest set of its group, nearest smaller set that it met, differing bits) of the rows that met another; -1 bits if none is smaller.

    Rows are sorted by node. Two rows that are in one group already are not compared again if the larger one has met a smaller one.
    """
    n = len(node)
    label, pairs, pending = np.arange(n), [np.empty((2, 0), np.int64)], 0
    near, differ = np.zeros(n, np.int64), np.full(n, -1)
    left, shift = np.arange(n), 1
    while len(left := left[left + shift < n]):
        left = left[node[left] == node[left + shift]]
        one, two = left, left + shift
        small, large = np.where(same[one] < same[two], one, two), np.where(same[one] < same[two], two, one)
        open_ = (same[one] != same[two]) & ((label[one] != label[two]) | (differ[large] < 0))
        one, two, small, large = one[open_], two[open_], small[open_], large[open_]
        so_far = np.zeros(len(one), np.int64)
        for word in wide:
            so_far += np.bitwise_count(word[one] ^ word[two])
            keep = so_far <= most
            one, two, small, large, so_far = one[keep], two[keep], small[keep], large[keep], so_far[keep]
        pairs.append(np.stack([one, two]))
        pending += len(one)
        for part in (large == two, large == one):  # each row is once left and once right
            x, y, d = large[part], small[part], so_far[part]
            better = (differ[x] < 0) | (d < differ[x]) | ((d == differ[x]) & (same[y] < near[x]))
            near[x[better]], differ[x[better]] = same[y[better]], d[better]
        if not shift & (shift - 1) or pending > ENTRIES:
            label, pairs, pending = _merged(label, pairs), [np.empty((2, 0), np.int64)], 0
        shift += 1
    label = _merged(label, pairs)
    row = np.flatnonzero(np.bincount(label, minlength=n)[label] > 1)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label[row], same[row])
    return row, least[label[row]], near[row], differ[row]


def _merged(label: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
    moved = np.flatnonzero(label != np.arange(len(label)))
    return least_labels(len(label), *np.concatenate([*pairs, np.stack([moved, label[moved]])], axis=1))


def _across(groups: DataFrame, prints: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(a, b): the pairs of each of groups(same, root) within the limit whose sets known(node, root) has in different components."""

    def compare(component: np.ndarray, same: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all components but the largest, in lots, against all rows of other components."""
        value, which, many = np.unique(component, return_inverse=True, return_counts=True)
        a, b = [], []
        for x in np.flatnonzero(which != many.argmax()):
            y = np.flatnonzero((np.bitwise_count(wide ^ wide[x]).sum(axis=1) <= most) & (which != which[x]))
            a.append(np.minimum(same[x], same[y]))
            b.append(np.maximum(same[x], same[y]))
        return np.concatenate(a), np.concatenate(b)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            if len(held) < 64 and sum(h.shape[1] for h in held) < ENTRIES:
                continue
            rows = np.concatenate(held, axis=1)
            end = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from each(rows[:, :end])
            held = [rows[:, end:]]
        if held:
            yield from each(np.concatenate(held, axis=1))

    def each(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part in np.split(rows, np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1, axis=1) if rows.shape[1] else ():
            a, b = compare(part[1], part[2], np.ascontiguousarray(part[3:].T).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    own = known.select(F.col("node").alias("same"), F.col("root").alias("component"))
    rows = cut(groups.join(own, "same", "left").withColumn("component", F.coalesce("component", "same")), "near-components")
    split = rows.groupBy("root").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("root")
    held = rows.join(split, "root", "left_semi").join(prints, "same").select("root", "component", "same", *prints.columns[1:])
    return held.repartition(parts(rows.sparkSession), "root").sortWithinPartitions("root").mapInArrow(work, "a long, b long").distinct()


def _sets(texts: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(same, size, sketch, held) of the asked(same, id) sets, read off the texts of their first documents by a second scan."""
    sent = texts.sparkSession.sparkContext.broadcast(key_filter(asked.select("id")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _some(iter([batch.filter(pa.array(in_filter(sent.value, batch.column(0).to_numpy())))])):
                held, many = shingle_sets(part.column(1), width)
                end = np.cumsum(many)
                sets = [held[b - n : b] for b, n in zip(end.tolist(), many.tolist(), strict=True)]
                data = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, : SHINGLE_BITS // 8]).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(_names(held, many).view(np.int64)), part.column(0), pa.array(many, pa.int32()), pa.array(list(map(_sketch, sets)), pa.binary()), pa.array(data, pa.binary())], ["same", "id", "size", "sketch", "held"])

    found = texts.mapInArrow(work, "same long, id long, size int, sketch binary, held binary")
    return cut(found.join(asked.distinct(), ["same", "id"], "left_semi").dropDuplicates(["same"]).drop("id"), "near-sets")


def _sketch(hashes: np.ndarray) -> bytes:
    """Bits, at least two to a hash, of which each hash turns one: two sets differ in as many hashes as their sketches in bits, at least."""
    bits = max(256, 1 << (2 * max(len(hashes), 1) - 1).bit_length())
    return np.packbits(np.bincount((mix(hashes) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ, the longer one folded to the length of the other."""
    x, y = (np.frombuffer(s, np.uint64) for s in sorted((x, y), key=len))
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs(a, b) whose sets are similar: the sketches decide what cannot be, the sets themselves the rest."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for m, n, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                need = math.ceil(similarity / (1 + similarity) * (m + n) - 1e-9)
                good.append(min(m, n) >= need and _apart(x, y) <= m + n - 2 * need)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = f"V{SHINGLE_BITS // 8}"
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), kind), np.frombuffer(y.as_py(), kind)
                both = len(set(x.tolist()) & set(y.tolist()))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def joined(some: DataFrame, *columns: str) -> DataFrame:
        for c in "ab":
            some = some.join(sets.select(F.col("same").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in columns]), c)
        return some.select("a", "b", *[f"{c}_{x}" for x in columns for c in "ab"])

    left = cut(joined(pairs, "size", "sketch").mapInArrow(possible, "a long, b long"), "near-possible")
    return joined(left, "held").mapInArrow(similar, "a long, b long")


def keep_first(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without those whose group holds a smaller doc_id; rows without a doc_id stay."""
    groups = near_groups(docs, width, similarity)
    key = free(docs, "_key")
    gone = groups.filter("component_id < doc_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(key), "left_anti")
