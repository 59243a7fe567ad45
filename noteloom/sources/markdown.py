"""A Spark data source for folders of Markdown notes: ``spark.read.format("vault")``, ``df.write.format("vault")``.

Reading lists the folders once, on the driver, and deals the files over partitions by their bytes; tasks read them.
Filters on ``source_dir`` and ``fname`` are answered from the listing, so files that they rule out are never opened, and with the
option ``content`` set to false no file is. A note that is no valid UTF-8 has no content and is marked ``broken``.

Writing takes (path, content) rows, or (path, place, key, line) rows of which tasks make files line by line, so that a file of any number of
lines passes through bounded memory. Tasks write next to each file's place under a name of their own; when all have
ended the files are moved to their names, and if one fails for good, what was written is removed.

Paths are reached through pyarrow's file systems: plain ones and those of file, hdfs, s3, gs and abfs.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from noteloom.storage import ship

NAMES = "fname string, path string, source_dir string"
ROWS = f"{NAMES}, content string, broken boolean"
#: Bytes of a partition, what opening a file counts for, and bytes of text in a batch.
PARTITION_BYTES, OPEN_COST, BATCH_BYTES = 64 << 20, 1 << 20, 8 << 20
#: Schemes of paths that pyarrow reaches.
SCHEMES = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def known(path: str) -> bool:
    """Whether this source reaches the path."""
    scheme, found, _ = path.partition(":")
    return not found or "/" in scheme or scheme in SCHEMES


def opened(path: str) -> tuple[FileSystem, str]:
    """The file system of a path and the path in it; nothing in a path is taken for an escape."""
    if path.startswith("file:"):
        return LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    scheme, found, rest = path.partition("://")
    if not found:
        return LocalFileSystem(), path
    authority, _, rest = rest.partition("/")
    store, base = FileSystem.from_uri(f"{scheme}://{authority}/")
    return store, f"{base.rstrip('/')}/{rest}"


@dataclass
class Files(InputPartition):
    """(path, name, folder) of the files of a partition."""

    files: list[tuple[str, str, str]]


class VaultReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.root, self.columns = options["path"].rstrip("/"), columns
        self.folders = [x for x in options.get("dirs", "").split("|") if x]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for one in filters:
            if isinstance(one, (EqualTo, In, StringStartsWith, StringEndsWith)) and one.attribute in (("source_dir",), ("fname",)):
                self.filters.append(one)
            else:
                yield one

    def _passes(self, attribute: str, value: str) -> bool:
        """Whether the filters on the attribute let the value through."""
        tests = {In: lambda x: value in x, EqualTo: lambda x: value == x, StringStartsWith: value.startswith, StringEndsWith: value.endswith}
        return all(tests[type(one)](one.value) for one in self.filters if one.attribute == (attribute,))

    def partitions(self) -> list[Files]:
        store, root = opened(self.root)
        held, weight, out = [], 0, []
        for folder in self.folders:
            if not self._passes("source_dir", folder):
                continue
            listed = store.get_file_info(FileSelector(f"{root}/{folder}" if folder else root, allow_not_found=True, recursive=self.recursive))
            for info in sorted(listed, key=lambda x: x.path):
                if info.type != FileType.File or not info.base_name.endswith(".md") or not self._passes("fname", info.base_name):
                    continue
                held.append((self.root + info.path[len(root) :], info.base_name, folder))
                weight += OPEN_COST + (info.size if "content" in self.columns else 0)
                if weight >= self.size:
                    out.append(Files(held))
                    held, weight = [], 0
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.root)
        rows, size = [], 0
        for path, name, folder in partition.files:
            content, broken = None, None
            if "content" in self.columns:
                with store.open_input_file(opened(path)[1]) as held:
                    data = held.read()
                try:
                    content, broken = data.decode("utf-8"), False
                except UnicodeDecodeError:
                    broken = True
                size += len(data)
            rows.append({"fname": name, "path": path, "source_dir": folder, "content": content, "broken": broken})
            if len(rows) == 10_000 or size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.bool_() if c == "broken" else pa.string()) for c in self.columns], self.columns)


@dataclass
class Written(WriterCommitMessage):
    """(path, place, name for now) of the files that a task wrote."""

    files: list[tuple[str, str, str]]


class VaultWriter(DataSourceArrowWriter):
    def __init__(self, columns: list[str]):
        self.columns = columns

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, out, current = [], None, None
        text = self.columns.index("line" if "line" in self.columns else "content")
        ending = b"\n" if "line" in self.columns else b""
        made: set[str] = set()
        for batch in iterator:
            paths = batch.column(self.columns.index("path")).to_pylist()
            for path, value in zip(paths, batch.column(text)):
                if path != current or not ending:
                    if out is not None:
                        out.close()
                    current = path
                    store, place = opened(path)
                    folder = posixpath.dirname(place)
                    if folder not in made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    aside = f"{folder}/.{uuid.uuid4().hex}.part"
                    out = store.open_output_stream(aside, compression=None)
                    files.append((path, place, aside))
                out.write((value.as_buffer() if value.is_valid else b"") if not ending else bytes(value.as_buffer() if value.is_valid else b"") + ending)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        for path, place, aside in (x for m in messages if m is not None for x in m.files):
            opened(path)[0].move(aside, place)

    def abort(self, messages: list[Written | None]) -> None:
        for path, _, aside in (x for m in messages if m is not None for x in m.files):
            opened(path)[0].delete_file(aside)


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return ROWS if self.options.get("content", "true").lower() == "true" else NAMES

    def reader(self, schema: StructType) -> VaultReader:
        return VaultReader(dict(self.options), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> VaultWriter:
        return VaultWriter(schema.names)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VaultSource)


def read(spark: SparkSession, root: str, dirs: tuple[str, ...], content: bool = True, recursive: bool = True) -> DataFrame:
    """ROWS of the notes below the folders of root that exist; NAMES without content."""
    register(spark)
    reader = spark.read.format("vault").option("dirs", "|".join(dirs)).option("content", str(content).lower()).option("recursive", str(recursive).lower())
    return reader.load(root)


def write(rows: DataFrame) -> None:
    """Writes rows(path, content), a file for each, or rows(path, place, key, line), a file for each path with its lines in order of place, then key."""
    register(rows.sparkSession)
    if "line" in rows.columns:
        rows = rows.repartition(F.col("path")).sortWithinPartitions("path", "place", "key").select("path", "line")
    else:
        rows = rows.select("path", "content")
    rows.write.format("vault").mode("append").save()


def delete(paths: DataFrame) -> None:
    """Deletes the files of paths(path), by tasks; what is gone already is no error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = opened(path)
                if store.get_file_info(place).type == FileType.File:
                    store.delete_file(place)
            yield batch

    paths.select("path").mapInArrow(work, "path string").write.format("noop").mode("append").save()
