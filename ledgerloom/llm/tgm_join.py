"""N-gram Jaccard join by a token-group matrix.

Documents become sets of word shingles (64-bit hashes); equal sets are one class. Similar
classes form groups of about GROUP members: a set made mostly of shingles that many documents
share goes by the smallest of those, so that near copies meet, any other set by its rarest
shingle. A group's row of the matrix is the union of its members' shingles. A class visits a group only if the two
share enough of their rarest shingles (a prefix in which any two partners meet COMMON times)
with a member of a size that could link, and the group is opened only if its union holds enough of the class's shingles for some member to link. Opened
groups are counted exactly, so every link between different sets is found; what leaves a task
is a spanning forest of its links, and components come from star contractions over those.

Shingles that many documents share come last in the order of rarity. That order is taken
from a sample of the documents; it steers the work only, any order gives the same links.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import combine, materialize, mix, release, steps, trimmed, utf8, word_hashes, word_spans

GROUP = 128
#: Shingles of all members of a group, over which it is cut as well: very long texts.
GROUP_SHINGLES = 1_000_000
#: A shingle that so many documents of the sample hold is hot.
HOT = 64
#: Largest map, in powers of two bits, that keeps unwanted texts out of a shuffle: 32 MB.
MARKS = 28
#: One document in so many is counted for the order of rarity, and so many shingles ranked.
SAMPLE_ONE_IN = 16
RANKED = 1_000_000
#: Prefix shingles that two linked sets share at least.
COMMON = 3
#: Visitors that a task takes for one group at a time.
VISITORS = 512


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingles of `words` words, A-Z lower-cased; a shorter row
    with words is one shingle, an empty one none."""
    starts, ends, counts = word_spans(raw, offsets)
    h = word_hashes(raw, starts, ends)
    k = max(0, len(h) - words + 1)
    grams = combine([np.full(k, words, np.uint64), *(h[j : k + j] for j in range(words))]) if k else h[:0]
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            s = np.sort(grams[at : at + n - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            out.append(combine([np.full(1, n, np.uint64), *(h[at + j : at + j + 1] for j in range(n))]))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _each(batches, column: int, words: int):
    """(batch, row number, set) of every row."""
    for batch in batches:
        raw, offsets = utf8(batch.column(column))
        for a, b in steps(offsets):
            for i, s in enumerate(shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)):
                yield batch, a + i, s


def set_key(s: np.ndarray) -> int:
    """One 64-bit key of a set, as a signed integer."""
    with np.errstate(over="ignore"):
        x = np.array([s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64), len(s)], np.uint64)
        return int(combine([x[:1], x[1:2], x[2:]]).view(np.int64)[0])


class Rarity:
    """The global order of shingles: unranked ones by value, then ranked ones by how often
    the sample held them."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        order = np.argsort(shingles)
        self.shingles, self.counts = shingles[order], counts[order].astype(np.int64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.shingles >> np.uint64(42)).astype(np.int64)] = True

    def prefix(self, s: np.ndarray, length: int) -> tuple[np.ndarray, int, np.uint64]:
        """The first `length` shingles of a sorted set in the order of rarity; how many of them,
        from the front, are not hot; and the shingle that the set's group goes by."""
        if not len(self.shingles):
            return s[:length], min(length, len(s)), s[0]
        maybe = np.flatnonzero(self.maybe[(s >> np.uint64(42)).astype(np.int64)])
        at = np.searchsorted(self.shingles, s[maybe])
        at[at == len(self.shingles)] = 0
        hit = self.shingles[at] == s[maybe]
        ranked, counts = maybe[hit], self.counts[at[hit]]
        rare = np.ones(len(s), bool)
        rare[ranked] = False
        first = s[rare][:length]
        cold = len(first)
        if cold < length:
            common = np.argsort(counts, kind="stable")[: length - cold]
            cold += int((counts[common] < HOT).sum())
            first = np.concatenate([first, s[ranked][common]])
        return first, cold, s[ranked[0]] if 2 * len(ranked) >= len(s) else first[0]


def rarity(texts: DataFrame, words: int) -> Rarity:
    """Counts the shingles of one document in SAMPLE_ONE_IN; at most RANKED come back."""
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_ONE_IN)) == 0).select("text")

    def run(batches):
        held, size = [], 0
        for _, _, s in _each(batches, 0, words):
            held.append(s)
            size += len(s)
            if size > 500_000:
                v, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n.astype(np.int64))], ["s", "n"])
                held, size = [], 0
        if size:
            v, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n.astype(np.int64))], ["s", "n"])

    counted = some.mapInArrow(trimmed(run), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where("n >= 2")
    counted = materialize(counted, "tgm-rarity")
    # the count from which at most RANKED shingles are left, from a histogram of counts
    steps_ = counted.groupBy(F.floor(F.log2(F.col("n").cast("double")) * 8).alias("step")).agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in steps_:
        total += r["k"]
        if total > RANKED:
            break
        least = r["step"]
    if least is None:
        release(counted)
        return Rarity(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    got = counted.where(F.floor(F.log2(F.col("n").cast("double")) * 8) >= least).toPandas()
    release(counted)
    return Rarity(got["s"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy())


def common_of(percent: int) -> int:
    """COMMON, or fewer where linked different sets may share fewer shingles than that."""
    return COMMON if percent >= 100 else max(1, min(COMMON, percent // (100 - percent)))


def _documents(texts: DataFrame, order: Rarity, words: int, percent: int, id_type: str) -> DataFrame:
    """(doc_id, n, cls, tk, prefix, hot, mh) of each row: tk is the hash of its id and text,
    prefix and hot its prefix's shingles that are not hot and that are, mh the shingle that its
    group goes by."""
    shared, common = texts.sparkSession.sparkContext.broadcast(order), common_of(percent)
    names = ["doc_id", "n", "cls", "tk", "prefix", "hot", "mh"]

    def lists(parts):
        sizes = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(parts).view(np.int64)))

    def run(batches):
        rank, none = shared.value, np.zeros(0, np.uint64)
        for batch in batches:
            n, cls, pre, hot, by = [], [], [], [], []
            for _, _, s in _each([batch], 1, words):
                k = len(s)
                n.append(k)
                cls.append(set_key(s) if k else None)
                p, cold, g = rank.prefix(s, k - (percent * k + 99) // 100 + common) if k else (none, 0, None)
                pre.append(p[:cold])
                hot.append(p[cold:])
                by.append(int(g.view(np.int64)) if k else None)
            if n:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), batch.column(2), lists(pre), lists(hot), pa.array(by, pa.int64())], names)

    schema = f"doc_id {id_type}, n long, cls long, tk long, prefix array<long>, hot array<long>, mh long"
    return texts.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("tk")).mapInArrow(trimmed(run), schema)


class Group:
    """One group's row of the matrix and, once opened, its members."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.size)
        at = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[at], owner[at]
        self.union, self.first = np.unique(tokens, return_index=True)
        self.last = np.append(self.first[1:], len(tokens))

    def links(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Members that link with the set; empty if the bound keeps the group closed."""
        at = np.searchsorted(self.union, s)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == s]
        if (100 + percent) * len(at) < percent * (len(s) + int(self.size.min())):
            return np.zeros(0, np.int64)
        a, b = self.first[at], self.last[at]
        size = b - a
        where = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
        shared = np.bincount(self.owner[where], minlength=len(self.size))
        return np.flatnonzero((100 + percent) * shared >= percent * (len(s) + self.size))


def _links(rows, percent: int):
    """A spanning forest of the links of one (group, part), as pairs of classes. rows, members
    before visitors: (kind, first, cls, set); visitors are met one at a time and not kept."""
    members: dict[int, np.ndarray] = {}
    root: dict[int, int] = {}
    group, ids, inside = None, [], False

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def joined(a: int, s: np.ndarray):
        for j in group.links(s, percent).tolist():
            x, y = find(a), find(ids[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                yield a, ids[j]

    def opened():
        nonlocal group, ids
        ids = list(members)
        group = Group(list(members.values()))
        root.update((c, c) for c in ids)
        if inside:
            for c in ids:
                yield from joined(c, members[c])

    for kind, first, c, s in rows:
        if kind == 0:
            members[c] = s.copy()
            inside |= first
        elif members:
            if group is None:
                yield from opened()
            root.setdefault(c, c)
            yield from joined(c, s)
    if group is None and inside and len(members) > 1:
        yield from opened()


def _verify(percent: int):
    def rows_of(batches):
        for batch in batches:
            column = batch.column(5)
            _, off, data = column.buffers()
            off = np.frombuffer(off, np.int32, len(column) + 1, column.offset * 4)
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            keys = [batch.column(i).to_pylist() for i in range(5)]
            for i, (gid, part, kind, first, c) in enumerate(zip(*keys, strict=True)):
                yield (gid, part), (kind, first, c, raw[off[i] : off[i + 1]].view(np.uint64))

    def run(batches):
        a, b = [], []
        for _, rows in itertools.groupby(rows_of(batches), key=lambda r: r[0]):
            for x, y in _links((r for _, r in rows), percent):
                a.append(x)
                b.append(y)
            if len(a) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return trimmed(run)


def components(edges: DataFrame, name: str = "tgm-edges") -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the component's least node. Large
    and small stars in turn until nothing changes; every round is a table of at most as many
    edges, and no node's neighbours are gathered."""
    spark = edges.sparkSession
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)

    def state(e):
        return e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(least, "a")
        small = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        done, edges = edges, materialize(small, name)
        release(done)
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def jaccard_components(documents: DataFrame, words: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: rows link when 100 * intersection >=
    percent * union of their shingle sets.

    Null or wordless texts have no shingles and stay alone (component_id is their doc_id).
    Null ids: rows link as others do, but the smallest id is taken over ids that are not
    null (null if there is none). Repeated ids and rows: each row is a document; the rows of
    an id are not linked by it. Empty table: no rows.
    """
    id_type = documents.schema[doc_id].dataType.simpleString()
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = rarity(texts, words)
    docs = materialize(_documents(texts, order, words, percent, id_type), "tgm-documents")
    # one row of each class
    first = W.partitionBy("cls").orderBy("tk")
    cls = docs.where("n > 0").select("cls", "tk", "n", "prefix", "hot", "mh").withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    cls = materialize(cls, "tgm-classes")
    chunks = F.ceil(F.greatest(F.col("k") / GROUP, F.col("size") / GROUP_SHINGLES))
    big = cls.groupBy("mh").agg(F.count("*").alias("k"), F.sum("n").alias("size")).where((F.col("k") > GROUP) | ((F.col("k") > 1) & (F.col("size") > GROUP_SHINGLES)))
    big = materialize(big.select("mh", chunks.alias("chunks")), "tgm-large")
    grouped = cls.join(big, "mh", "left").withColumn("gid", F.xxhash64("mh", F.pmod(F.xxhash64("cls"), F.coalesce("chunks", F.lit(1)))))
    # rows of prefix shingles that two groups at least hold; hot ones are held by many anyway
    met = W.partitionBy("s")
    live = grouped.select("cls", "gid", "n", F.explode("prefix").alias("s")).withColumns({"lo": F.min("gid").over(met), "hi": F.max("gid").over(met)}).where("lo <> hi").drop("lo", "hi")
    live = materialize(live.unionByName(grouped.select("cls", "gid", "n", F.explode("hot").alias("s"))), "tgm-shared")
    # classes and groups that meet in a prefix shingle: a group's number of the pair is the larger
    there = live.groupBy("s", F.col("gid").alias("g")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    fits = (F.col("g") > F.col("gid")) & (100 * F.col("hi") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("lo"))
    visits = live.join(there, "s").where(fits).groupBy("cls", F.col("g").alias("gid")).agg(F.count("*").alias("k")).where(F.col("k") >= common_of(percent)).drop("k")
    visits = materialize(visits, "tgm-visits")
    nv = visits.groupBy("gid").agg(F.count("*").alias("nv"))
    members = grouped.select("cls", "tk", "gid")
    size = members.groupBy("gid").agg(F.count("*").alias("k")).join(nv, "gid", "left").where("k > 1 or nv is not null")
    size = materialize(size.select("gid", F.greatest(F.lit(1), F.ceil(F.coalesce("nv", F.lit(0)) / VISITORS)).cast("int").alias("parts")), "tgm-sizes")
    members = members.join(size, "gid")
    wanted = members.select("cls", "tk").unionByName(cls.select("cls", "tk").join(visits.select("cls").distinct(), "cls", "left_semi")).distinct()

    def run(batches):
        seen: set[int] = set()  # a repeated row needs its set but once
        for batch in batches:
            c, out = [], []
            for _, _, s in _each([batch], 0, words):
                key = set_key(s)
                if key not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(key)
                    c.append(key)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(out, pa.binary())], ["cls", "set"])

    # the texts of wanted rows are marked in a bitmap: what it lets through besides, some
    # hundredths at 32 bits a row, finds no class below
    wanted = materialize(wanted.select("tk"), "tgm-wanted")
    bits = 1 << min(MARKS, max(20, (32 * wanted.count()).bit_length()))
    cell, place = F.shiftright(F.col("tk").bitwiseAND(F.lit(bits - 1)), 15), F.col("tk").bitwiseAND(F.lit((1 << 15) - 1))
    marks = wanted.groupBy(cell.alias("cell")).agg(F.bitmap_construct_agg(place).alias("bits"))
    some = texts.where("text <> ''").select("text", F.xxhash64("doc_id", "text").alias("tk")).withColumn("cell", cell).join(F.broadcast(marks), "cell")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    some = some.where(F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1)
    sets = materialize(some.select("text").mapInArrow(trimmed(run), "cls long, set binary"), "tgm-sets")
    own = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("gid", "part", F.lit(0).alias("kind"), (F.col("part") == 0).alias("first"), "cls")
    come = visits.join(size, "gid").select("gid", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), F.lit(False).alias("first"), "cls")
    at = own.unionByName(come).join(sets, "cls").select("gid", "part", "kind", "first", "cls", "set")
    at = at.repartition("gid", "part").sortWithinPartitions("gid", "part", "kind")
    roots = components(at.mapInArrow(_verify(percent), "a long, b long"))
    release(cls, big, live, visits, size, wanted, sets)
    least = docs.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    linked = roots.withColumnRenamed("node", "cls").join(least, "cls")
    by_root = materialize(linked.groupBy("root").agg(F.min("least").alias("component")), "tgm-components")
    linked = linked.join(by_root, "root").select("cls", "component")
    named = least.join(linked, "cls", "left").select("cls", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"))
    return docs.select("doc_id", "n", "cls").join(named, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(documents: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", one_an_id: bool = True) -> DataFrame:
    """The rows of documents whose id is the smallest of their component, with all their
    columns, whatever their names; one row an id, or without one_an_id one row of each
    component, so that texts of an id that do not link all stay.

    Null ids: such rows go by a hash of their text instead, behind every real id; one row of
    each such text is considered. Null, empty and wordless texts link with nothing, so one row
    of each such id and text stays. Repeated rows: one stays. Empty table: no rows.
    """
    names = documents.columns
    inner = [f"c{i}" for i in range(len(names))]
    d = documents.toDF(*inner)
    at, value = f"c{names.index(doc_id)}", F.coalesce(F.col(f"c{names.index(text)}"), F.lit(""))
    digits = lambda x: F.lpad(F.hex(x), 16, "0")
    behind = F.concat(F.lit("F" * 18), digits(F.xxhash64(value)))
    if documents.schema[doc_id].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        # ids as bytes that sort as the numbers do
        key = digits(F.col(at).cast("bigint").bitwiseXOR(F.lit(-(1 << 63))))
    else:
        key = F.hex(F.col(at).cast("string").cast("binary"))
    if not one_an_id:  # a row is its id and text
        key = F.concat(key, digits(F.xxhash64(value)))
    keyed = d.withColumn("key", F.unhex(F.coalesce(key, behind)))
    best = jaccard_components(keyed.select("key", value.alias("value")), words, percent, "key", "value")
    firsts = best.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("key")).distinct()
    one = W.partitionBy("key").orderBy(F.xxhash64(value))
    kept = keyed.join(firsts, "key", "left_semi").withColumn("n", F.row_number().over(one)).where("n = 1")
    return kept.select(*inner).toDF(*names)
