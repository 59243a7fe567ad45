"""Media columns: GIF.

``read`` parses a GIF, decodes its LZW code streams, applies palettes, interlacing, transparency and
disposal, and gives timed frames. ``write`` stores 8-bit samples losslessly as frames of a GIF89a.
``frame_columns`` turns a table of GIF files into one row per frame with its colour histogram. ``store_texts`` keeps
each text as such a file, whose zeros are transparent and whose frames clear their place when they end, and
``media_features`` reads the bytes back from the pictures shown, one frame at a time.

Defined results: a file that is cut short or is no GIF gives the frames that can be read and an
error text, as does one whose header states, or whose kept frames sum to, more than MOST_SAMPLES samples; samples beyond
the palette show its last colour; a null file has no frames and no error; a null or empty text is one row of zeros; very long
texts are files of many frames; equal texts give equal files, rows that repeat are stored each; a null doc_id stays null; other
columns, whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import cut, ship

#: Samples to a row and rows to a frame of the files that ``write`` makes, and their delay in hundredths of a second.
ROW, FRAME_ROWS, DELAY = 64, 512, 4
#: Colour-histogram bins along each of red, green and blue.
HIST = 4
MOST_CODES = 4096
#: Samples of a canvas or frame above which a file is not read: its header may state any size.
MOST_SAMPLES = 1 << 26


@dataclass
class Frame:
    left: int
    top: int
    delay: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    index: np.ndarray
    canvas: np.ndarray | None = None


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """GIF-flavoured LZW: codes grow from bits + 1 to 12 bits, and a clear code starts the table anew when it is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    runs: list[list[int]] = []
    codes = [clear]
    table: dict[int, int] = {}
    get = table.get
    free = end + 1
    held = -1
    for sample in samples:
        if held < 0:
            held = sample
            continue
        key = held << 8 | sample
        code = get(key)
        if code is not None:
            held = code
            continue
        codes.append(held)
        held = sample
        if free < MOST_CODES:
            table[key] = free
            free += 1
        else:
            codes.append(clear)
            runs.append(codes)
            codes = []
            table.clear()
            free = end + 1
    if held >= 0:
        codes.append(held)
    codes.append(end)
    runs.append(codes)
    every = np.concatenate([np.array(r, np.uint32) for r in runs])
    layout = _layout(bits)[0]
    # The first run also holds the opening clear code, which has the width of a table's first code.
    width = np.concatenate([layout[np.maximum(np.arange(len(run)) - (k == 0), 0)] for k, run in enumerate(runs)])
    shifts = np.arange(12, dtype=np.uint32)
    spread = ((every[:, None] >> shifts) & 1).astype(np.uint8)
    return np.packbits(spread[shifts[None, :] < width[:, None]], bitorder="little").tobytes()


def _width(place: np.ndarray, end: int, bits: int) -> np.ndarray:
    """Bits of the code at a place after a clear code: enough for the largest code that the reader's table may hold."""
    known = np.minimum(end + np.maximum(place, 0), MOST_CODES - 1)
    return np.clip(np.floor(np.log2(np.maximum(known, 1))).astype(np.int64) + 1, bits + 1, 12)


@lru_cache(maxsize=16)
def _layout(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes by place since the clear code, past the last growth, and the bits before each place."""
    width = _width(np.arange(MOST_CODES + 2), (1 << bits) + 1, bits)
    return width, np.concatenate(([0], np.cumsum(width)))


def lzw_decode(data: bytes, bits: int, most: int) -> bytes:
    """The samples of a code stream, at most ``most`` of them; a stream that ends early gives what it held."""
    clear, end = 1 << bits, (1 << bits) + 1
    stream = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    start = [bytes([k]) for k in range(clear)] + [b"", b""]
    width, offset = _layout(bits)
    weights = 1 << np.arange(12)
    out: list[bytes] = []
    made, at, total = 0, 0, len(stream)
    table, last = list(start), b""
    place = 0
    base = at
    while made < most:
        # All codes up to the next clear code share one layout of widths, so they are cut out at once.
        if place < len(width):
            rel = offset[place:-1] - offset[place]
            step = width[place:]
        else:
            n = min((total - base) // 12, MOST_CODES)
            rel, step = 12 * np.arange(n), np.full(n, 12)
        fits = int(np.searchsorted(rel + step, total - base, side="right"))
        if not fits:
            break
        rel, step = rel[:fits], step[:fits]
        want = base + rel[:, None] + np.arange(12)
        cells = np.where(np.arange(12) < step[:, None], stream[np.minimum(want, total - 1)], 0)
        codes = cells @ weights
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else fits
        size = len(table)
        for code in codes[:stop].tolist():
            if code < size:
                entry = table[code]
                if last and size < MOST_CODES:
                    table.append(last + entry[:1])
                    size += 1
            elif code == size and last:
                entry = last + last[:1]
                table.append(entry)
                size += 1
            else:
                return b"".join(out)[:most]
            out.append(entry)
            last = entry
        made = sum(map(len, out)) if stop == fits else made
        if stop == fits:
            base, place = base + int(rel[-1] + step[-1]), place + fits
            continue
        if codes[stop] == end:
            break
        base += int(rel[stop] + step[stop])
        table, last, place = list(start), b"", 0
    return b"".join(out)[:most]


def grey_palette() -> np.ndarray:
    return np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def write(payload: bytes, row: int = ROW, frame_rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames show the payload (a positive multiple of ``row``), one after another: a byte is a grey, and zero is transparent."""
    if not payload or len(payload) % row:
        raise ValueError("the payload is no positive multiple of a row")
    rows = len(payload) // row
    out = [b"GIF89a", struct.pack("<HHBBB", row, min(rows, frame_rows), 0xF7, 0, 0), grey_palette().tobytes()]
    for at in range(0, rows, frame_rows):
        part = payload[at * row : (at + frame_rows) * row]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 2 << 2 | 1, delay, 0), b"\0\x2c", struct.pack("<HHHHB", 0, 0, row, len(part) // row, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join(out) + b"\x3b"


def _joined(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def read(data: bytes, render: bool = True, take: Callable[[Frame], None] | None = None) -> tuple[tuple[int, int], list[Frame], str | None]:
    """Canvas size (width, height), frames in order, and what went wrong, if anything did.

    With ``render`` each frame's canvas is the picture shown while it lasts: height x width x RGBA. With ``take`` each
    frame is given to it and none is kept; the canvas changes when the next frame is read.
    """
    frames: list[Frame] = []
    kept = 0
    size = (0, 0)
    try:
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("no GIF header")
        width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
        size, at, common = (width, height), 13, None
        if flags & 0x80:
            n = 2 << (flags & 7)
            common = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(n, 3)
            at += 3 * n
        control = (0, 0, None)
        if width * height > MOST_SAMPLES:
            raise ValueError("the canvas is too large")
        canvas = np.zeros((height, width, 4), np.uint8) if render else None
        while (kind := data[at]) != 0x3B:
            if kind == 0x21:
                body, after = _joined(data, at + 2)
                if data[at + 1] == 0xF9 and len(body) >= 4:
                    packed, delay, clear = struct.unpack("<BHB", body[:4])
                    control = (delay, packed >> 2 & 7, clear if packed & 1 else None)
                at = after
                continue
            if kind != 0x2C:
                raise ValueError("unknown block")
            left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            if w * h > MOST_SAMPLES:
                raise ValueError("a frame is too large")
            at += 10
            palette = common
            if flags & 0x80:
                n = 2 << (flags & 7)
                palette = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(n, 3)
                at += 3 * n
            bits = data[at]
            if not 0 < bits < 9:
                raise ValueError("no width of codes")
            body, at = _joined(data, at + 1)
            samples = lzw_decode(body, bits, w * h)
            index = np.frombuffer(samples.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if flags & 0x40:
                order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
                index = index[np.argsort(order, kind="stable")]
            delay, disposal, clear = control
            frame = Frame(left, top, delay, disposal, clear, palette if palette is not None else grey_palette(), index)
            control = (0, 0, None)
            before = canvas.copy() if canvas is not None and disposal == 3 else None
            if canvas is not None:
                _draw(canvas, frame)
                frame.canvas = canvas if take else canvas.copy()
            if take:
                take(frame)
            else:
                frames.append(frame)
                kept += w * h + (width * height if render else 0)
                if kept > MOST_SAMPLES:
                    raise ValueError("the frames are too large to be kept")
            if canvas is not None:
                if disposal == 2:
                    canvas[top : top + h, left : left + w] = 0
                elif disposal == 3:
                    canvas = before
            if len(samples) < w * h:
                raise ValueError("a code stream ends early")
        return size, frames, None
    except (IndexError, ValueError, struct.error) as wrong:
        return size, frames, str(wrong) or type(wrong).__name__


def _draw(canvas: np.ndarray, frame: Frame) -> None:
    index = frame.index[: max(0, canvas.shape[0] - frame.top), : max(0, canvas.shape[1] - frame.left)]
    h, w = index.shape
    colours = np.full((256, 4), 255, np.uint8)
    colours[: len(frame.palette), :3] = frame.palette
    colours[len(frame.palette) :, :3] = frame.palette[-1]
    area = canvas.view("<u4")[frame.top : frame.top + h, frame.left : frame.left + w, 0]
    np.copyto(area, colours.view("<u4")[:, 0][index], where=True if frame.transparent is None else index != frame.transparent)


def histogram(frame: Frame) -> np.ndarray:
    """Counts of HIST x HIST x HIST colours over the frame's own drawn samples."""
    step = 256 // HIST
    bins = (frame.palette.astype(np.int64) // step) @ np.array([HIST * HIST, HIST, 1])
    drawn = frame.index.ravel() if frame.transparent is None else frame.index[frame.index != frame.transparent]
    used = np.bincount(np.minimum(drawn, len(bins) - 1), minlength=len(bins))
    return np.bincount(bins, weights=used, minlength=HIST**3).astype(np.int64)


def shown_histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of HIST x HIST x HIST colours over the opaque samples of a picture."""
    step = 256 // HIST
    red, green, blue, alpha = (canvas[..., k] for k in range(4))
    bins = red // step * (HIST * HIST) + green // step * HIST + blue // step
    return np.bincount(bins[alpha == 255], minlength=HIST**3)


UNIT = 64
MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame) -> DataFrame:
    """MEDIA of docs(doc_id, text), written to the shared folder: each text's UTF-8 bytes, filled with zeros to a positive multiple of UNIT, as a GIF."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [(t.as_py() or "").encode() for t in part.column(1)]
                made = [write(t.ljust(max(UNIT, -(-len(t) // UNIT) * UNIT), b"\0")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n_bytes", "media"])

    ship(docs.sparkSession)
    return cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, MEDIA), "gif")


def media_features(stored: DataFrame) -> DataFrame:
    """FEATURES of MEDIA: what the pictures shown hold when the stored files are read back.

    feature is frames:hundredths:counts, the counts being those of the colour histogram's used bins over all pictures;
    what is transparent has no colour.
    """

    def one(key: int, n_bytes: int, data: bytes) -> tuple:
        parts: list[bytes] = []
        counted, lasts = np.zeros(HIST**3, np.int64), 0

        def take(frame: Frame) -> None:
            nonlocal counted, lasts
            shown = frame.canvas[: frame.index.shape[0]]
            parts.append((shown[..., 0] * (shown[..., 3] == 255)).tobytes())
            counted, lasts = counted + shown_histogram(shown), lasts + frame.delay

        _, _, error = read(data, take=take)
        if error:
            raise ValueError(f"the stored media of {key} can't be read: {error}")
        payload = b"".join(parts)
        used = ",".join(f"{k}={counted[k]}" for k in np.flatnonzero(counted))
        feature = f"{len(parts)}:{lasts}:{used}"
        return key, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for batch in batches:
            rows = [one(k, n, m.as_py()) for k, n, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    ship(stored.sparkSession)
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(work, FEATURES)


def frame_columns(media: DataFrame, key: str, column: str) -> DataFrame:
    """One row per frame: key, frame, start and length in hundredths of a second, place, size, histogram, samples, error,
    canvas size, picture and shown.

    place, size, histogram and samples are those of the part that the frame itself draws. picture is what is shown while
    the frame lasts, with palettes, transparency and disposal applied: RGBA, row by row, of the canvas size (width,
    height). shown is the histogram of its opaque colours.
    """
    schema = f"{key} long, frame int, starts long, lasts long, place array<int>, size array<int>, histogram array<long>, samples binary, error string, canvas array<int>, picture binary, shown array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["frame", "starts", "lasts", "place", "size", "histogram", "samples", "error", "canvas", "picture", "shown"]
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                canvas, frames, error = read(data.as_py() or b"") if data.is_valid else (None, [], None)
                starts, rows = 0, []
                for i, f in enumerate(frames):
                    rows.append((i, starts, f.delay, [f.left, f.top], [f.index.shape[1], f.index.shape[0]], histogram(f).tolist(), f.index.tobytes(), error, list(canvas), *((None, None) if f.canvas is None else (f.canvas.tobytes(), shown_histogram(f.canvas).tolist()))))
                    starts += f.delay
                rows = rows or [(0, 0, 0, None, None, None, None, error, None, None, None)]
                types = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.string(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), pa.int64()), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], [key, *names])

    ship(media.sparkSession)
    return media.select(F.col(key).cast("long"), column).mapInArrow(work, schema)
