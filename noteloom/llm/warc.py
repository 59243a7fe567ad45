"""WARC archives with a two-level capture index.

``write`` turns pages into WARC records, one gzip member each, which tasks append to archives, files of the shared
folder, and lists each record's place. The folder is reached through pyarrow's file systems, so its scheme has to be one that they know
(a plain path, file, hdfs, s3, gs). ``build_index`` sorts the captures by reversed-host URL key into compressed blocks
and keeps a sparse directory, one entry for each block. ``lookup`` finds keys by binary search: among
the shards' first keys, then in a shard's directory, then among the lines of one unpacked block; what
it returns are places, and ``read_ranges`` reads those ranges of the archives and nothing else.

Records with equal payloads of ``least`` bytes or more are stored once: that with the largest
page_id is a response, the others are revisits that refer to it.

Defined results: null html is an empty payload, a null url has the key ``-``; a page without an id is a response
that nothing refers to; repeated page rows are written each, and rows of one page_id with other html are judged by their own; a very long page is a record like any other; other columns, whatever their names, are not looked at; characters that would break a header line are percent-encoded; an empty table
gives no archives and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import cut, parts, ship
from noteloom.storage import shared_dir

#: Bytes after which an archive is closed, and captures to a block of the index.
ARCHIVE_BYTES, BLOCK_LINES = 1 << 30, 1000
#: Bytes between two wanted records that are read rather than skipped, and bytes read at once.
GAP, READ = 1 << 14, 1 << 22
CAPTURE = "key string, archive string, offset long, length long"
PLACE = ("archive", "offset", "length")
RECORD = "page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def url_key(url: str | None) -> str:
    """The reversed-host sort key of a URL: com,example,www:8080)/path?query."""
    if not url:
        return "-"
    try:
        split = urlsplit(url.strip())
        host = split.hostname or ""
        port = f":{split.port}" if split.port and (split.scheme, split.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        return "-" + _line(url)
    if not host:
        return "-" + _line(url)
    key = ",".join(reversed(host.lower().split("."))) + port + ")" + (split.path or "/") + ("?" + split.query if split.query else "")
    return _line(key)


def _line(text: str) -> str:
    """text without characters that end or split a line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)


def capture_key(url: str | None, page_id: int | None) -> str:
    """A key that sorts by URL key, then page; no two pages share it but those without an id under one URL."""
    return f"{url_key(url)} {'-' if page_id is None else format(page_id, '020d')}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record as a gzip member of its own."""
    sha = base64.b32encode(digest).decode()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = head if refers_to is not None else head + payload
    lines = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'-' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    lines.append(f"WARC-Payload-Digest: sha1:{sha}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """The fields of RECORD that one gzip member holds; a revisit's payload is not in it."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    stated = int(re.search(rb"Content-Length: (\d+)", http)[1])
    named = lambda name: fields.get(name, "-").removeprefix("<urn:page:").removesuffix(">")
    number = lambda name: None if named(name) == "-" else int(named(name))
    response = fields["WARC-Type"] == "response"
    found = hashlib.sha1(payload).hexdigest() if response else base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    return {"page_id": number("WARC-Record-ID"), "record_type": fields["WARC-Type"], "url": fields.get("WARC-Target-URI"), "payload_digest": found, "payload_bytes": len(payload) if response else stated, "refers_to": number("WARC-Refers-To"), "payload": payload if response else None}


def _digest(least: int) -> Column:
    """A digest of html that has ``least`` bytes or more, else null."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return F.when(F.octet_length(html) >= least, F.sha2(html, 256))


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, same, refers_to) of the pages whose payload, with the digest ``same``, an equal one with a larger page_id holds.

    Digests are grouped with partial maxima, so a payload that very many pages share costs no large group.
    """
    digests = cut(pages.select("page_id", _digest(least).alias("same")).filter("same is not null and page_id is not null"), "digests")
    shared = digests.groupBy("same").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).filter("refers_to > least").drop("least")
    return digests.join(shared, "same").filter("page_id < refers_to").select("page_id", "same", "refers_to").distinct()


def write(pages: DataFrame, least: int = 1000, date: str = "1970-01-01T00:00:00Z", folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes pages(page_id, url, html) to archives of ARCHIVE_BYTES or more; returns their folder and captures(key, PLACE).

    Every task attempt writes archives of its own; captures list those of the attempts that count.
    """
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/noteloom-warc-{uuid.uuid4().hex}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number, out, rows, size = TaskContext.get(), 0, None, [], 0
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for page_id, url, html, refers_to in zip(*[batch.column(k) for k in range(4)], strict=True):
                if out is None:
                    archive, size = f"noteloom-{context.partitionId():06d}-{context.taskAttemptId()}-{number:05d}.warc.gz", 0
                    out, number = store.open_output_stream(f"{root}/{archive}", compression=None), number + 1
                payload, url = (html.as_py() or "").encode(), url.as_py()
                member = record(page_id.as_py(), url, payload, hashlib.sha1(payload).digest(), refers_to.as_py(), date)
                rows.append((capture_key(url, page_id.as_py()), archive, size, len(member)))
                out.write(member)
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", *PLACE])
                rows = []
        if out is not None:
            out.close()

    ship(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    known = revisits(pages, least).withColumnRenamed("page_id", "_page_id")
    rows = pages.withColumn("_same", _digest(least)).join(known, (F.col("page_id") == F.col("_page_id")) & (F.col("_same") == F.col("same")), "left")
    rows = rows.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), "refers_to")
    return folder, cut(rows.mapInArrow(work, CAPTURE), "captures")


def opened(folder: str) -> tuple[FileSystem, str]:
    """The file system of a folder, by its scheme, and the folder's path in it."""
    store, path = FileSystem.from_uri(folder)
    return store, path.rstrip("/")


def build_index(captures: DataFrame, lines: int = BLOCK_LINES) -> tuple[DataFrame, DataFrame]:
    """Blocks (shard, block, data) and their sparse directory (shard, block, first_key, last_key)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, held = TaskContext.get().partitionId(), 0, []

        def packed() -> pa.RecordBatch:
            data = zlib.compress("\n".join(held).encode())
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "first_key": [_key(held[0])], "last_key": [_key(held[-1])], "data": [data]})

        for batch in batches:
            for row in batch.to_pylist():
                held.append("\t".join([row["key"], row["archive"], str(row["offset"]), str(row["length"])]))
                if len(held) == lines:
                    yield packed()
                    block, held = block + 1, []
        if held:
            yield packed()

    ship(captures.sparkSession)
    ordered = captures.repartitionByRange(parts(captures.sparkSession), "key").sortWithinPartitions("key")
    stored = cut(ordered.mapInArrow(work, "shard int, block int, first_key string, last_key string, data binary"), "index")
    return stored.select("shard", "block", "data"), stored.select("shard", "block", "first_key", "last_key")


def _key(line: str) -> str:
    return line.partition("\t")[0]


def lookup(blocks: DataFrame, directory: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, key, PLACE) of the captures whose key lies between low and high, both included, of queries(query, low, high)."""
    # One row for each shard, of which there are as many as the index had partitions.
    bounds = sorted((r["first_key"], r["last_key"], r["shard"]) for r in directory.groupBy("shard").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key")).collect())
    firsts, lasts = [b[0] for b in bounds], [b[1] for b in bounds]

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for k in range(bisect_left(lasts, row["low"]), bisect_right(firsts, row["high"])):
                    out.append((bounds[k][2], row["query"], row["low"], row["high"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)], ["shard", "query", "low", "high"])

    def to_blocks(asked: pa.Table, listed: pa.Table) -> pa.Table:
        entries = sorted(listed.to_pylist(), key=lambda r: r["first_key"])
        first, last = [r["first_key"] for r in entries], [r["last_key"] for r in entries]
        out = {"shard": [], "block": [], "query": [], "low": [], "high": []}
        for row in asked.to_pylist():
            for k in range(bisect_left(last, row["low"]), bisect_right(first, row["high"])):
                for name, value in (("shard", row["shard"]), ("block", entries[k]["block"]), ("query", row["query"]), ("low", row["low"]), ("high", row["high"])):
                    out[name].append(value)
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)})

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, asked in zip(batch.column(0), batch.column(1), strict=True):
                lines = zlib.decompress(data.as_py()).decode().split("\n")
                keys, out = [_key(x) for x in lines], []
                for row in asked.as_py():
                    for line in lines[bisect_left(keys, row["low"]) : bisect_right(keys, row["high"])]:
                        key, archive, offset, length = line.split("\t")
                        out.append((row["query"], key, archive, int(offset), int(length)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["query", "key", *PLACE])

    ship(queries.sparkSession)
    sharded = queries.select("query", "low", "high").mapInArrow(to_shards, "shard int, query long, low string, high string")
    hits = sharded.groupBy("shard").cogroup(directory.groupBy("shard")).applyInArrow(to_blocks, "shard int, block int, query long, low string, high string")
    # Queries of one block, in lots of bounded length, beside its bytes.
    lots = hits.groupBy("shard", "block", F.pmod(F.xxhash64("query"), F.lit(4)).alias("lot")).agg(F.collect_list(F.struct("query", "low", "high")).alias("asked"))
    return lots.join(blocks, ["shard", "block"]).select("data", "asked").mapInArrow(in_blocks, f"query long, {CAPTURE}")


def spans(offset: list[int], length: list[int]) -> list[tuple[int, int, int]]:
    """(first, last, end) of ranges to read at once: sorted places whose gaps are at most GAP, READ bytes or one record."""
    out: list[tuple[int, int, int]] = []
    for k, (at, n) in enumerate(zip(offset, length, strict=True)):
        if out and at - out[-1][2] <= GAP and max(at + n, out[-1][2]) - offset[out[-1][0]] <= READ:
            out[-1] = (out[-1][0], k + 1, max(at + n, out[-1][2]))
        else:
            out.append((k, k + 1, at + n))
    return out


def read_ranges(folder: str, places: DataFrame) -> DataFrame:
    """RECORD for each of places(PLACE): tasks take neighbouring places and read their ranges of the archives, no others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        store, root = opened(folder)
        name, held = None, None
        for batch in batches:
            archive, offset, length = (batch.column(c).to_pylist() for c in PLACE)
            edges = [0, *(k for k in range(1, len(archive)) if archive[k] != archive[k - 1]), len(archive)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if archive[low] != name:
                    if held is not None:
                        held.close()
                    name = archive[low]
                    held = store.open_input_file(f"{root}/{name}")
                for first, last, end in spans(offset[low:high], length[low:high]):
                    start = offset[low + first]
                    data = memoryview(held.read_at(end - start, start))
                    rows = [parse(bytes(data[offset[k] - start : offset[k] - start + length[k]])) for k in range(low + first, low + last)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)], names)

    ship(places.sparkSession)
    dealt = places.select(*PLACE).repartitionByRange(parts(places.sparkSession), "archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(work, RECORD)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes pages, finds every page by its key in the index, and reads its record back: RECORD without the payload."""
    folder, captures = write(pages, least)
    blocks, directory = build_index(captures)
    keyed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).distinct().mapInArrow(_page_queries, "query long, low string, high string")
    return read_ranges(folder, lookup(blocks, directory, keyed)).drop("payload")


def _page_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [capture_key(u, i) for i, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(keys, pa.string())], ["query", "low", "high"])
