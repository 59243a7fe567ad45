"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from noteloom.llm.words import mix
from noteloom import storage

#: Bits of a filter over keys, whatever their number, and the cells of a row of a fixed table that travels.
FILTER_BITS, ROW = 1 << 25, 1 << 13

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back; the shuffles that made it are released."""
    held = storage.cut(df, name)
    storage.release(df.sparkSession)
    return held


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which whoever starts the session sets to suit the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free(docs: DataFrame, name: str) -> str:
    """name, with underscores before it until docs has no such column."""
    held = {c.lower() for c in docs.columns}
    while name.lower() in held:
        name = "_" + name
    return name


_shipped: set[str] = set()


#: Rows of a batch that goes to a Python worker: whole texts are long, and a batch is held by the executor and by the worker.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once for each application, and batches of at most BATCH_ROWS rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    held = Path(tempfile.mkdtemp(prefix="noteloom-package-")) / "noteloom_package.zip"
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(held))
    _shipped.add(context.applicationId)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links a-b connect it to."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not np.array_equal(up := label[label], label):
            label = up


def fixed_table(rows: DataFrame, fill: Callable, kind: type, cells: int, packed: Callable) -> np.ndarray:
    """A table of ``cells`` cells that tasks fill and that is added up: fill(batches) gives a task's, packed(sums) the bytes of a sum.

    Rows of ROW cells travel; the driver gets len(packed(...)) bytes for each, whatever the number of rows of the input.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fill(batches).reshape(-1, ROW)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([planes(table[k]) for k in used], pa.binary())], ["row", "sums"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROW, np.uint64)
        for batch in batches:
            for sums in batch.column("sums"):
                total += from_planes(sums.as_py(), kind, ROW)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed(total).tobytes()], pa.binary())], ["row", "sums"])

    out: list = [packed(np.zeros(ROW, np.uint64))] * (cells // ROW)
    for row in rows.mapInArrow(work, "row int, sums binary").groupBy("row").applyInArrow(add, "row int, sums binary").collect():
        out[row["row"]] = np.frombuffer(row["sums"], np.uint8)
    return np.concatenate(out)


def planes(values: np.ndarray) -> bytes:
    """The bytes of little-endian numbers, all lowest bytes first, so that high bytes of zero compress to nothing."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type, n: int, at: int = 0) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).reshape(-1).view(kind)


def key_number(key: np.ndarray, place: np.ndarray | int = 0) -> np.ndarray:
    """A number of 64 bits for a key, or for a place under a key."""
    return mix(mix(key.astype(np.int64).view(np.uint64)) + np.asarray(place).astype(np.uint64))


def key_filter(keys: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits over keys(key[, place]): bytes in which the bit of each key is set."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(FILTER_BITS, np.uint8)
        for batch in batches:
            total[key_number(*(c.to_numpy() for c in batch.columns[:2])) & np.uint64(FILTER_BITS - 1)] = 1
        return total

    return fixed_table(keys, count, np.uint8, FILTER_BITS, lambda sums: np.packbits(sums > 0, bitorder="little"))


def in_filter(held: np.ndarray, key: np.ndarray, place: np.ndarray | int = 0) -> np.ndarray:
    """Which keys may be among those of the filter; all that are in it may."""
    bit = key_number(key, place) & np.uint64(FILTER_BITS - 1)
    return (held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
