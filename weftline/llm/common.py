"""Helpers the operators of this subpackage share: lineage cuts, text buffers, word hashes."""
from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words: everything of ASCII but letters and digits.
ALNUM_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
#: Bytes that separate words when only white space does.
SPACE_WORD = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
#: ASCII letters to lower case, all other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
LOWER_TABLE = {c: c + 32 for c in range(65, 91)}

UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_ASCII = UPPER_ASCII.lower()


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once and keep it in the shared checkpoint folder.

    The cluster names that folder in `spark.checkpoint.dir`.  Only a local
    session without one (as in tests) gets a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="weftline-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one after another, and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset:]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text)))
        ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """Bit mixer over 64-bit words (fixed values of the splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word and the n + 1 word offsets of the texts."""
    size = len(raw)
    if size == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = is_word[raw]
    fresh = np.zeros(size + 1, dtype=bool)
    fresh[offsets] = True
    before = np.empty(size, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    after = np.empty(size, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    length = ends - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray(shape=(size + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    todo, step = np.arange(len(starts)), 0
    while len(todo):
        left = length[todo] - step
        part = eights[starts[todo] + step]
        short = left < 8
        if short.any():
            keep = np.where(short, (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
            part = part & keep
        h[todo] = mix(h[todo] * np.uint64(0x9E3779B97F4A7C15) ^ part)
        todo, step = todo[left > 8], step + 8
    return h, np.searchsorted(starts, offsets)


def give_back() -> None:
    """Return what Arrow, numpy and Python have freed to the system: workers are used again by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """The same function of batches; its memory is given back at its end."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_group(run: Callable, least: int = 2 << 20) -> Callable:
    """The same function of one group's table; memory is given back after groups of at least `least` bytes."""
    def tidied(table: pa.Table) -> pa.Table:
        size = table.nbytes
        out = run(table)
        del table
        if size >= least:
            give_back()
        return out

    return tidied
