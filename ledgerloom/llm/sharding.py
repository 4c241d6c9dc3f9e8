"""Sharding by histogram sort: exact bytes below candidate boundaries, refined until the
splitters meet the tolerance, then one exchange of whole documents. Built-in functions only."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, release

LAW = "bytes"
_LOW = -(1 << 63)
#: A refinement looks at so many more bits of the key.
_BITS = 8
#: Bytes of documents that one task of the exchange takes.
PART_BYTES = 256 << 20
#: Tasks of the exchange at most; beyond that a task takes more bytes.
PARTS = 100_000


@dataclass(frozen=True)
class Splitter:
    """Rows whose key (k1, k2) is below (first, second) lie left of it."""

    first: int
    second: int
    bytes_below: int


def keyed(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, k1, k2): k1 hashes the text, so equal texts are neighbours
    in key order; k2 hashes the id and orders them."""
    t = F.coalesce(F.col(text), F.lit(""))
    return documents.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(t) + F.lit(8)).cast("bigint").alias("size"),
        F.xxhash64(t).alias("k1"),
        _k2(doc_id).alias("k2"),
    )


def _k2(doc_id: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(17))


def _search(rows: DataFrame, key: str, targets: list[float], below: int, total_rows: int, slack: float) -> list[tuple[int, int, int | None]]:
    """For each target the boundary of `key` whose bytes to its left come nearest to it:
    (boundary, bytes left of it, None), or (value, bytes left of it, rows) where one value
    alone spans the target by more than slack, so that the caller may look inside.

    Each round counts the bytes of every sub-range of the ranges still open, over all rows
    of those ranges; what comes to the driver is at most 2^_BITS counts a target."""
    done: dict[float, tuple[int, int, int | None]] = {}
    # open ranges: prefix of the key (shifted), bytes below it, and the targets inside
    shift = 64 - _BITS
    open_ = {None: (below, sorted(targets))}
    while open_:
        part = rows if None in open_ else rows.where(F.shiftright(key, shift + _BITS).isin([p for p in open_]))
        got = part.groupBy(F.shiftright(key, shift).alias("p")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy("p").collect()
        by: dict = {}
        for r in got:
            by.setdefault(None if None in open_ else r["p"] >> _BITS, []).append((r["p"], r["b"], r["n"]))
        then: dict = {}
        for prefix, (base, wanted) in open_.items():
            cells = by.get(prefix, [])
            if not cells:
                for t in wanted:
                    done[t] = (_LOW, base, None)
                continue
            ends, left = [], base
            for _, b, _n in cells:
                left += b
                ends.append(left)
            for t in wanted:
                i = min(bisect_left(ends, t), len(cells) - 1)
                p, b, n = cells[i]
                start, stop = ends[i] - b, ends[i]
                near, edge = (start, p << shift) if t - start <= stop - t else (stop, (p + 1) << shift)
                if abs(near - t) <= slack:
                    done[t] = (edge, near, None)
                elif shift == 0:
                    done[t] = (p, start, n)
                else:
                    then.setdefault(p, (start, []))[1].append(t)
        open_ = then
        shift -= _BITS
        if shift < 0:
            break
    return [done[t] for t in targets]


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.01) -> list[Splitter]:
    """shards - 1 boundaries that leave total * j / shards bytes to their left, each within
    tolerance of a shard's share, or as near as whole rows allow."""
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not n or shards < 2:
        return []
    share = total / shards
    targets = [share * j for j in range(1, shards)]
    found = _search(rows, "k1", targets, 0, n, tolerance * share)
    out: list[Splitter | None] = [None if inside else Splitter(edge, _LOW, near) for edge, near, inside in found]
    inner: dict[int, list[int]] = {}
    for j, (value, _, inside) in enumerate(found):
        if inside:
            inner.setdefault(value, []).append(j)
    for value, which in inner.items():  # at most one value a boundary
        start = found[which[0]][1]
        deep = _search(rows.where(F.col("k1") == F.lit(value)), "k2", [targets[j] for j in which], start, n, tolerance * share)
        whole = rows.where(F.col("k1") == F.lit(value)).agg(F.sum("size")).first()[0]
        for j, (edge, near, inside) in zip(which, deep, strict=True):
            if inside:  # rows of one id and text: nothing tells them apart
                b = rows.where((F.col("k1") == F.lit(value)) & (F.col("k2") == F.lit(edge))).agg(F.sum("size")).first()[0]
                second = edge if targets[j] - near <= near + b - targets[j] else edge + 1
                near = near if second == edge else near + b
                out[j] = Splitter(value, second, near)
            else:
                out[j] = Splitter(value, edge, near) if near < start + whole else Splitter(value + 1, _LOW, near)
    return sorted(out, key=lambda s: (s.first, s.second))


def _at_least(s: Splitter):
    """Keys not below the splitter, kept inside the range of 64-bit integers."""
    if s.first > (1 << 63) - 1:
        return F.lit(False)
    if s.second > (1 << 63) - 1:
        return F.col("k1") > F.lit(s.first)
    if s.second <= _LOW:
        return F.col("k1") >= F.lit(s.first)
    return (F.col("k1") > F.lit(s.first)) | ((F.col("k1") == F.lit(s.first)) & (F.col("k2") >= F.lit(s.second)))


def _exchanged(documents: DataFrame, shards: int, tolerance: float, doc_id: str, text: str, part_bytes: int) -> DataFrame:
    """The rows of documents, columns named c0, c1, ..., in their shards, with `shard` and
    `slot`: whole rows go over one exchange, each to the one task of its part of a shard.

    A shard is cut into parts of about part_bytes by a hash of the key, so that no task holds
    a whole shard of a large table; the counts of all parts, from the keys alone, say where a
    part's slots begin. Parts number PARTS at most (or one a shard), which bounds the table
    of beginnings that is broadcast.
    """
    rows = materialize(keyed(documents, doc_id, text).select("size", "k1", "k2"), "shard-keys")
    cuts = splitters(rows, shards, tolerance)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    m = max(1, min(-(-total // (shards * part_bytes)), PARTS // shards))
    shard = F.lit(0)
    for s in cuts:
        shard = shard + _at_least(s).cast("int")
    part = (shard * F.lit(m) + F.pmod(F.xxhash64("k1", "k2"), F.lit(m))).cast("int")
    names = documents.columns
    inner = [f"c{i}" for i in range(len(names))]
    key, body = inner[names.index(doc_id)], inner[names.index(text)]
    d = documents.toDF(*inner)
    t = F.coalesce(F.col(body), F.lit(""))
    d = d.withColumns({"k1": F.xxhash64(t), "k2": _k2(key)})
    d = d.withColumn("part", part).repartitionById(shards * m, "part")
    d = d.withColumn("slot", F.row_number().over(W.partitionBy("part").orderBy("k1", "k2", key)).cast("bigint") - 1)
    if m > 1:
        counted = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
        before = W.partitionBy(F.expr(f"part div {m}")).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        begins = materialize(counted.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")), "shard-begins")
        d = d.join(F.broadcast(begins), "part", "left").withColumn("slot", F.col("slot") + F.col("begin"))
    release(rows)
    return d.select(*inner, F.expr(f"cast(part div {m} as int)").alias("shard"), "slot")


def shard_documents(documents: DataFrame, shards: int = 24, tolerance: float = 0.01, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, read off the
    documents where the exchange has put them.

    The law is `bytes`: shards hold nearly equal bytes. Equal texts share a shard unless their
    group reaches over a boundary that the law needs. Slots number a shard's rows without
    gaps. Null text: size 8, the crc of no bytes. Null ids are ids like any other; rows of one
    id and text stay together. Empty table: no rows. Other columns of documents, whatever
    their names, play no part.
    """
    names = documents.columns
    key, body = (f"c{names.index(x)}" for x in (doc_id, text))
    t = F.coalesce(F.col(body), F.lit(""))
    return _exchanged(documents, shards, tolerance, doc_id, text, part_bytes).select(
        F.col(key).alias("doc_id"),
        (F.octet_length(t) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(documents: DataFrame, folder: str, shards: int = 24, tolerance: float = 0.01, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Write whole documents, one folder a shard (`shard=0`, ...), rows in key order inside a
    file, and read them back: the columns of documents, slot and shard. A column of documents
    that has one of these two names keeps it; ours then gets underscores in front."""
    names = documents.columns
    taken = {n.lower() for n in names}
    own = []
    for n in ("slot", "shard"):
        while n in taken:
            n = "_" + n
        own.append(n)
    d = _exchanged(documents, shards, tolerance, doc_id, text, part_bytes)
    d = d.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], F.col("slot").alias(own[0]), F.col("shard").alias(own[1]))
    d.write.partitionBy(own[1]).parquet(folder)
    return documents.sparkSession.read.schema(d.schema).parquet(folder)
