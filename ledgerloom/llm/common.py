"""Shared plumbing of the training-data operators: work tables, text buffers, word hashing.

Word and shingle identities are 64-bit hashes. Two different words of one corpus share a
hash with probability about n^2 / 2^65 (n distinct words), which stays below one in a
thousand for a billion distinct words.
"""

from __future__ import annotations

import ctypes
import functools
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: UTF-8 bytes of text that one vectorised step handles (longer documents are one step each).
STEP_BYTES = 1 << 20
#: Bytes of an Arrow batch that a Python worker gets (a longer row is a batch of its own).
BATCH_BYTES = 1 << 22

#: What a Python worker keeps from task to task, by name.
KEPT: dict[str, object] = {}

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_K = np.uint64(0x9E3779B97F4A7C15)
#: The low k bytes of eight.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master
    (single-machine runs and tests) may go without and gets a temporary folder; on a cluster a
    missing setting is an error, since no machine's own folder is shared."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = "file://" + os.path.join(tempfile.gettempdir(), "ledgerloom-work")
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: later jobs neither
    recompute it nor depend on any one executor. `release` removes it."""
    spark = df.sparkSession
    bound_batches(spark)
    path = work_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_table = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove work tables that no later job reads."""
    for df in tables:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._work_table)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES go to Python workers, whatever the length of the
    texts; a setting of the session's own below that stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None) or ""
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def forget(keep: str = "") -> None:
    """Drop what earlier tasks of this worker put into KEPT under another name."""
    for k in [k for k in KEPT if k != keep]:
        del KEPT[k]


def give_back() -> None:
    """Hand this process's free memory back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run, keep: str = ""):
    """A function over Arrow batches that gives free memory back when a task ends: workers
    live on, and what they keep counts against the executor. KEPT loses all but keep."""

    @functools.wraps(run)
    def wrapped(batches):
        forget(keep)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id is in fold 0 of the numbering but is
    told apart by callers that compare with a number (null never equals)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string")) % F.lit(parts)


def in_fold(doc_id: Column | str, parts: int, k: int) -> Column:
    """True where the id's fold is k; false for null ids."""
    return F.coalesce(fold(doc_id, parts) == F.lit(k), F.lit(False))


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """(first, last) row ranges of at most `limit` bytes each, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the n + 1 offsets of its rows; null: empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the rows' bytes, and each row's number of words."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_WS[raw]
    cut = offsets[:-1][(np.diff(offsets) > 0)]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[cut] = inside[cut]
    over = inside.copy()
    over[:-1] &= ~inside[1:]
    over[cut[1:] - 1] = inside[cut[1:] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(over) + 1
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return starts, ends, counts


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word (A-Z lower-cased if asked), eight of its bytes at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        padded = np.zeros(len(raw) + 8, np.uint8)
        padded[: len(raw)] = _LOWER[raw] if lower else raw
        eight = np.ndarray(len(raw) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
        size = ends - starts
        h = mix(size.astype(np.uint64) * _K + (eight[starts] & _MASK[np.minimum(size, 8)]))
        rest, at = np.flatnonzero(size > 8), 8
        while len(rest):
            x = eight[starts[rest] + at] & _MASK[np.minimum(size[rest] - at, 8)]
            h[rest] = mix(h[rest] * _K + x)
            at += 8
            rest = rest[size[rest] > at]
        return h


def combine(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of several, in order."""
    with np.errstate(over="ignore"):
        h = hashes[0].copy()
        for x in hashes[1:]:
            h = mix(h * _K + x)
        return h
