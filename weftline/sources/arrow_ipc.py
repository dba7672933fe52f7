"""Arrow IPC files as a Spark data source, read and written in parallel.

Spark has no built-in `arrow` format.  Readers get whole files, or runs of the
record batches of a large file; writers produce one file per task, which become
visible only when the whole job commits.
"""
from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "arrow_ipc"
SPLIT_BYTES = 512 * 1024 * 1024
DRIVER_THREADS = 32
WILD = re.compile(r"[*?\[]")


def _qualified(spark: SparkSession, path: str) -> str:
    """The path on the cluster's default file system, as Spark itself reads it."""
    root = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return path if ":" in path or root.startswith("file:") else root.rstrip("/") + path


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and its own path: local, or any URI Arrow knows (hdfs, s3, gs; s3a and s3n are s3)."""
    if "://" in path:
        return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    if path.startswith("file:"):
        path = path[len("file:"):]
    return pafs.LocalFileSystem(), os.path.abspath(path)


def _fixed_part(path: str) -> str:
    """The folder above the first part of a path that holds a wildcard."""
    parts = path.split("/")
    return "/".join(parts[:next(i for i, p in enumerate(parts) if WILD.search(p))])


def _data_files(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """A file, the files of a folder and the folders in it, or those that fit a path with wildcards.

    Names that start with _ or . are passed over.  A wildcard stays within one
    level; a folder that fits stands for all files below it.
    """
    glob = WILD.search(path.split("://")[-1])
    system, base = _filesystem(_fixed_part(path) if glob else path)
    info = system.get_file_info(base)
    if info.type == pafs.FileType.File:
        return system, [info]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(pafs.FileSelector(base, recursive=True))
    below = [(f, f.path[len(base):].strip("/").split("/")) for f in found if f.type == pafs.FileType.File]
    if glob:
        levels = path[len(_fixed_part(path)):].strip("/").split("/")
        below = [(f, parts) for f, parts in below if len(parts) >= len(levels) and all(map(fnmatchcase, parts, levels))]
    files = [f for f, parts in below if not any(p.startswith(("_", ".")) for p in parts)]
    return system, sorted(files, key=lambda f: f.path)


def _footer(system: pafs.FileSystem, file: pafs.FileInfo) -> pa.Schema:
    with system.open_input_file(file.path) as source:
        return pa.ipc.open_file(source).schema


@dataclass
class _Batches(InputPartition):
    file: str
    first: int
    last: int | None


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split_bytes: int):
        self.path, self.schema, self.names, self.split_bytes = path, schema, schema.names, split_bytes

    def partitions(self) -> list[InputPartition]:
        system, files = _data_files(self.path)

        def parts_of(file: pafs.FileInfo) -> list[_Batches]:
            if file.size <= self.split_bytes:
                return [_Batches(file.path, 0, None)]
            # Only the footer is read here.
            with system.open_input_file(file.path) as source:
                n = pa.ipc.open_file(source).num_record_batches
            step = max(1, n * self.split_bytes // file.size)
            return [_Batches(file.path, i, min(i + step, n)) for i in range(0, n, step)]

        with ThreadPoolExecutor(DRIVER_THREADS) as pool:
            return [part for parts in pool.map(parts_of, files) for part in parts]

    def read(self, part: _Batches) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(_fixed_part(self.path) if WILD.search(self.path.split("://")[-1]) else self.path)
        want = to_arrow_schema(self.schema)
        with system.open_input_file(part.file) as source:
            whole = pa.ipc.open_file(source).schema
            own = [n for n in self.names if whole.get_field_index(n) >= 0]
            wanted = pa.ipc.IpcReadOptions(included_fields=sorted(whole.get_field_index(n) for n in own))
            reader = pa.ipc.open_file(source, options=wanted) if own else pa.ipc.open_file(source)
            for i in range(part.first, reader.num_record_batches if part.last is None else part.last):
                batch = reader.get_batch(i)
                # A column that this file lacks is null, one of a narrower type is widened.
                columns = [self._widened(batch.column(f.name), f.type) if f.name in own else pa.nulls(batch.num_rows, f.type) for f in want]
                yield pa.RecordBatch.from_arrays(columns, names=self.names)

    @staticmethod
    def _widened(column: pa.Array, kind: pa.DataType) -> pa.Array:
        plain = pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_null(column.type)
        return column.cast(kind) if plain and column.type != kind else column


@dataclass
class _Written(WriterCommitMessage):
    file: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = _filesystem(self.path)
        folder = f"{base}/{self.staging}"
        name = f"part-{uuid.uuid4().hex}.arrow"
        system.create_dir(folder, recursive=True)
        first = next(batches, None)
        if first is None:
            return _Written(None)
        with system.open_output_stream(f"{folder}/{name}") as sink, pa.ipc.new_file(sink, first.schema) as writer:
            writer.write_batch(first)
            for batch in batches:
                writer.write_batch(batch)
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = _filesystem(self.path)
        system.create_dir(base, recursive=True)
        old = _data_files(self.path)[1] if self.overwrite else []
        # Retried tasks may have left files behind: only reported ones move in.
        names = [m.file for m in messages if m is not None and m.file]
        if not names:  # an empty table is a file without rows, which keeps the columns
            names = [f"part-{uuid.uuid4().hex}.arrow"]
            system.create_dir(f"{base}/{self.staging}", recursive=True)
            with system.open_output_stream(f"{base}/{self.staging}/{names[0]}") as sink, pa.ipc.new_file(sink, to_arrow_schema(self.schema)):
                pass
        # The old files go first: a driver lost in between leaves too little, which shows, but never old rows among new ones.
        with ThreadPoolExecutor(DRIVER_THREADS) as pool:
            list(pool.map(lambda f: system.delete_file(f.path), old))
            list(pool.map(lambda n: system.move(f"{base}/{self.staging}/{n}", f"{base}/{n}"), names))
        self._drop_staging(system, base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop_staging(*_filesystem(self.path))

    def _drop_staging(self, system, base: str) -> None:
        folder = f"{base}/{self.staging}"
        if system.get_file_info(folder).type == pafs.FileType.Directory:
            system.delete_dir(folder)


class ArrowIpcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        system, files = _data_files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no Arrow files in {self.options['path']}")
        with ThreadPoolExecutor(DRIVER_THREADS) as pool:
            found = list(pool.map(lambda f: _footer(system, f), files))
        merged = pa.unify_schemas([s.remove_metadata() for s in found], promote_options="permissive")
        whole = from_arrow_schema(merged, prefer_timestamp_ntz=True)
        wanted = self.options.get("columns")
        if not wanted:
            return whole
        return StructType([whole[c] for c in wanted.split("\x1f")])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite)


def read_arrow(spark: SparkSession, path: str, columns: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Arrow IPC file, folder with its subfolders, or path with wildcards.

    Files above `split_bytes` are shared among tasks.  The columns of all files are
    taken together: one that a file lacks is null there, numbers widen.

    Spark cannot push a projection into a Python source, so name the `columns`
    a query needs to read only those.
    """
    spark.dataSource.register(ArrowIpcSource)
    reader = spark.read.format(FORMAT).option("splitBytes", split_bytes)
    if columns:
        reader = reader.option("columns", "\x1f".join(columns))
    return reader.load(_qualified(spark, path))


def write_arrow(df: DataFrame, path: str) -> DataFrame:
    """One Arrow IPC file per task, replacing what is there; returns the input."""
    df.sparkSession.dataSource.register(ArrowIpcSource)
    df.write.format(FORMAT).mode("overwrite").save(_qualified(df.sparkSession, path))
    return df
