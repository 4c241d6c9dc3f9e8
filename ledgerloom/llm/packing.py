"""Packing by minimum bin slack: whole windows are cut off each document, and the multiset
of remaining lengths (at most window - 1 different ones) fills further windows, each by a
bitset subset-sum that comes closest to the capacity.

The solver sees lengths and their counts only, so its input is bounded by the window size
whatever the corpus; documents are matched to its answer by their rank among the equally
long remainders.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import encoder
from .common import materialize, steps, trimmed, utf8

WINDOW = 2048


def closest_subset(counts: dict[int, int], capacity: int, first: int) -> dict[int, int]:
    """How many of each length to put into a window that holds `first` already, so that the
    sum comes as near to capacity as can be: reachable sums are the bits of an integer,
    counts enter as powers of two, and the choice is read back from the sums reachable
    before each chunk."""
    used = {first: 1}
    room = capacity - first
    goal = 1 << room
    reach, mask = 1, (1 << (room + 1)) - 1
    chunks: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        n = min(counts[length] - (length == first), room // length if length <= room else 0)
        k = 1
        while n > 0:
            k = min(k, n)
            chunks.append((length, k, reach))
            reach = (reach | reach << (length * k)) & mask
            n -= k
            k *= 2
            if reach & goal:
                break
        if reach & goal:
            break
    left = reach.bit_length() - 1
    for length, k, before in reversed(chunks):
        if not before >> left & 1:
            used[length] = used.get(length, 0) + k
            left -= length * k
    return used


def minimum_bin_slack(counts: dict[int, int], capacity: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(lengths with their numbers, how many windows look so) until no length is left. Each
    window starts with the longest left; a filling is used again as often as the counts
    allow, so the number of fillings depends on the different lengths, not on the rows."""
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        filling = closest_subset(left, capacity, max(left))
        times = min(left[k] // n for k, n in filling.items())
        for k, n in filling.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((filling, times))
    return out


def tokenised_pieces(documents: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: the windows cut off a document, then what remains. `part` and
    `nth` number the equally long pieces of a task's rows."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part, seen, enc = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64), encoder(path)
        end = np.array([end_id], "<u4")
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in steps(offsets, 1 << 19):
                ids_, rows = enc.encode_utf8(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                cols: list[list] = [[], [], [], [], [], [], []]
                for i in range(b - a):
                    ids = np.append(ids_[rows[i] : rows[i + 1]], end)
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        k = len(piece)
                        data = piece.tobytes()
                        for c, v in zip(cols, (a + i, start, k, zlib.crc32(data), len(ids), int(seen[k]), data if with_ids else b""), strict=True):
                            c.append(v)
                        seen[k] += 1
                got = [batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:6]), pa.array([part] * len(cols[0]), pa.int64())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth", "part"]
                if with_ids:
                    got.append(pa.array(cols[6], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(got, names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, nth long, part long" + ", ids binary" * with_ids
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(run, path), schema)


def pack_documents(documents: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every
    piece; ids: little-endian unsigned 32-bit, if asked for.

    A null or empty text is its end id alone. Null and repeated ids: rows count as documents
    of their own. Empty table: no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    pieces = materialize(tokenised_pieces(documents, path, end_id, window, doc_id, text, with_ids), "pack-pieces")
    # rank of a piece among the equally long ones: those of earlier parts, then its own part's
    counted = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counted = counted.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    totals = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, sequence = [], 0
    taken: dict[int, int] = {}
    fillings = minimum_bin_slack({k: v for k, v in totals.items() if k < window}, window)
    if window in totals:
        fillings.append(({window: 1}, totals[window]))
    for filling, times in fillings:
        offset = 0
        for length in sorted(filling, reverse=True):
            n, low = filling[length], taken.get(length, 0)
            slots.append((length, low, low + n * times, n, sequence, offset))
            taken[length] = low + n * times
            offset += n * length
        sequence += times
    # at most a few rows for each different length and filling: the window's size bounds both
    plan = spark.createDataFrame(slots, "length long, low long, high long, each long, first long, base long")
    ranked = pieces.join(counted.select("length", "part", "earlier"), ["length", "part"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    plan = plan.withColumnRenamed("length", "__length")
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("__length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    at = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.expr("(rank - low) div each")).alias("sequence_id"),
        (F.col("base") + (at % F.col("each")) * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )
