"""Shared helpers of the training-data operators: Arrow text buffers as numpy
arrays, word segmentation and hashing, the shared folder, key ranges.

A word is a maximal run of ASCII digits, ASCII letters and bytes from 0x80
(any part of a non-ASCII character), with A-Z lower-cased.  Working on UTF-8
bytes keeps whole batches inside numpy.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; bounds memory for any document length.
CHUNK_BYTES = 1 << 20
#: Bytes of a batch that Spark hands to a worker, before the row that fills it.
BATCH_BYTES = 8 << 20

_FOLD = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _FOLD[_b] = _b
for _b in range(0x41, 0x5B):
    _FOLD[_b] = _b + 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_HASH = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_HASH = _BYTE_HASH[_FOLD]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        full = np.full(max(n, 64), _BASE, np.uint64)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
    return _powers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (uint64), start and end byte of every word of a run of texts.

    ``offsets`` are the texts' bounds in ``data``; no word crosses one.
    """
    hashes, starts, ends = [], [], []
    size, at = len(data), 0
    while at < size:
        cut = min(at + CHUNK_BYTES, size)
        while cut < size:  # cut where no word is in progress
            tail = np.flatnonzero(_FOLD[data[at:cut]] == 0)
            if len(tail):
                cut = at + int(tail[-1]) + 1
                break
            cut = min(cut + CHUNK_BYTES, size)
        part = data[at:cut]
        inside = _FOLD[part] != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        lo, hi = np.searchsorted(offsets, [at, cut])
        bounds = offsets[lo:hi] - at
        if len(bounds):
            first[bounds] = inside[bounds]
            bounds = bounds[bounds > 0] - 1
            last[bounds] = inside[bounds]
        s = np.flatnonzero(first)
        e = np.flatnonzero(last) + 1
        if len(s):
            n = e - s
            before = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(before, n)
            value = _BYTE_HASH[part[inside]] * _power_table(int(n.max()))[place]
            hashes.append(mix64(np.add.reduceat(value, before) + n.astype(np.uint64)))
            starts.append(s + at)
            ends.append(e + at)
        at = cut
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def word_bounds(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n+1 positions in the list of words at which each text's words begin."""
    return np.searchsorted(starts, offsets)


def row_groups(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in row runs of at most ``limit`` text bytes (one long text may exceed it)."""
    _, offsets = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def release_memory() -> None:
    """Gives freed memory back to the system, as workers outlive tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _released(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release_memory()

    return run


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_BYTES``, so that long texts don't fill a worker's memory.

    The limit is a setting of the session, set here.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) != str(BATCH_BYTES):
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(_released(function), schema)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """Lists of the given lengths over flat values."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is configured, a local session gets one of its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='wideframe-shared-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a written table."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def drop_tables(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that no plan reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Words of the column ``text`` in DuckDB's SQL.
SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def key_ranges(df: DataFrame, key: str, parts: int, tie: str) -> Column:
    """Number of the range of each row in the order of a long key, then of the long ``tie``, a hash.

    About ``parts`` ranges with about equal row counts; a key that fills several ranges
    is dealt to them by ``tie``.  Null keys have ranges of their own before all
    others, as many as their rows fill.  Only the bounds and two counts reach the driver.
    """
    if parts < 2:
        return F.lit(0)
    shares = [i / parts for i in range(1, parts)]
    row = df.select(F.percentile_approx(F.col(key), shares, 10_000).alias("q"), F.count(key).alias("n"), F.count(F.lit(1)).alias("total")).first()

    def of(n: Column) -> Column:
        """Which of n equal parts of all hashes."""
        return F.least(F.floor((F.col(tie) / 2.0**64 + 0.5) * n), n - 1)

    nulls = F.lit(1 + (row["total"] - row["n"]) * parts // max(row["total"], 1))
    bounds, number = row["q"] or [], F.lit(0)
    if bounds:
        array = F.lit(bounds)
        number = F.size(F.filter(array, lambda b: b <= F.col(key)))
        if len(set(bounds)) < len(bounds):
            own = F.greatest(F.lit(1), F.size(F.filter(array, lambda b: b == F.col(key))))
            number = number - own + 1 + of(own)
    return F.when(F.col(key).isNull(), of(nulls) - nulls).otherwise(number).cast("int")
