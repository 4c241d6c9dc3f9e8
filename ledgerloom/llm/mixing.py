"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A small
flow network routes pattern capacity to source quotas; using a pattern's words a second time
costs more than the first, so repetition is spread before it deepens. What a pattern gives
is then drawn from its documents in the order of a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD_RE, materialize

#: Patterns that the driver routes at most; more are an error, never a silent cut.
MAX_PATTERNS = 200_000


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> dict[str | None, float]:
    """Words wanted of each source: sources in code point order (null last) take the weights
    in turn and share `share` times all words; a target stops at `limit` times its source's
    size and the excess is shared again by weight until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    out: dict[str | None, float] = {}
    open_ = list(names)
    while open_:
        rest = total - sum(out.values())
        weight = sum(w[s] for s in open_)
        now = {s: rest * w[s] / weight for s in open_}
        over = [s for s in open_ if now[s] > limit * sizes[s]]
        if not over:
            out.update(now)
            break
        out.update({s: float(limit * sizes[s]) for s in over})
        open_ = [s for s in open_ if s not in out]
    return out


class _Network:
    """Arcs in pairs: arc 2 i and its reverse 2 i + 1."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def add(self, a: int, b: int, room: int) -> int:
        k = len(self.to)
        self.to += [b, a]
        self.room += [room, 0]
        self.out[a].append(k)
        self.out[b].append(k + 1)
        return k

    def fill(self, start: int, end: int) -> None:
        """Augment to a maximum flow: blocking flows along shortest paths."""
        while True:
            level = [-1] * len(self.out)
            level[start], now = 0, [start]
            while now and level[end] < 0:
                then = []
                for a in now:
                    for k in self.out[a]:
                        b = self.to[k]
                        if self.room[k] and level[b] < 0:
                            level[b] = level[a] + 1
                            then.append(b)
                now = then
            if level[end] < 0:
                return
            nth, way = [0] * len(self.out), []
            while True:
                a = self.to[way[-1]] if way else start
                if a == end:
                    room = min(self.room[k] for k in way)
                    for k in way:
                        self.room[k] -= room
                        self.room[k ^ 1] += room
                    way = way[: next(i for i, k in enumerate(way) if not self.room[k])]
                elif nth[a] == len(self.out[a]):
                    if not way:
                        break
                    level[a] = -1
                    way.pop()
                else:
                    k = self.out[a][nth[a]]
                    if self.room[k] and level[self.to[k]] == level[a] + 1:
                        way.append(k)
                    else:
                        nth[a] += 1


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int], repeats: int) -> list[list[int]]:
    """Words routed from each pattern to each of its sources: as much of the quotas as can be
    met, at the least cost, where the k-th use of a pattern's words costs k - 1 a word.

    Every path through a pattern's k-th use costs the same k - 1 whatever the pattern, so
    successive shortest paths come level by level: each level's arcs are opened and the flow
    filled up before the next, dearer one."""
    p, s = len(capacity), len(quota)
    start, end = p + s, p + s + 1
    net = _Network(p + s + 2)
    routed = [[net.add(i, p + j, c * repeats) for j in members[i]] for i, c in enumerate(capacity)]
    for j, q in enumerate(quota):
        net.add(p + j, end, q)
    for _ in range(repeats):
        for i, c in enumerate(capacity):
            net.add(start, i, c)
        net.fill(start, end)
    out = [[0] * s for _ in range(p)]
    for i, arcs in enumerate(routed):
        for j, k in zip(members[i], arcs, strict=True):
            out[i][j] += net.room[k ^ 1]
    return out


def word_count(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_RE)).cast("bigint")


def draw(rows: DataFrame, wanted: DataFrame, rows_a_cell: int = 200) -> DataFrame:
    """rows (pattern, size, u in [0, 1)) plus `extra` (0 or 1), so that the sizes with extra 1
    of a pattern sum to nearly `want` of `wanted` (pattern, want, n).

    Whole cells of u are taken while they fit; cells are counted coarsely, then finely inside
    the one coarse cell that the limit falls into; the rows of the last fine cell (about
    `rows_a_cell`) are taken longest first while they fit. What is broadcast has a row for
    each pattern at most, and patterns are bounded by MAX_PATTERNS.
    """
    fine = F.greatest(F.lit(1), (F.col("n") / F.lit(rows_a_cell)).cast("bigint"))
    wanted = wanted.select("pattern", "want", fine.alias("cells"))
    wanted = wanted.withColumn("wide", F.expr("greatest(1L, cast(ceil(sqrt(cells)) as bigint))"))
    r = rows.join(F.broadcast(wanted), "pattern")
    r = r.withColumn("cell", F.least(F.floor(F.col("u") * F.col("cells")), F.col("cells") - 1)).withColumn("area", F.expr("cell div wide"))

    def cut(sums: DataFrame, by: str) -> DataFrame:
        before = W.partitionBy("pattern").orderBy(by).rowsBetween(W.unboundedPreceding, -1)
        s = sums.withColumn("left", F.col("want") - F.coalesce(F.sum("b").over(before), F.lit(0)))
        first = s.where(F.col("left") < F.col("b")).groupBy("pattern").agg(F.min_by(F.struct(by, "left"), by).alias("x"))
        return first.select("pattern", F.col(f"x.{by}").alias(f"cut_{by}"), F.col("x.left").alias(f"{by}_want"))

    areas = cut(r.groupBy("pattern", "area").agg(F.sum("size").alias("b"), F.max("want").alias("want")), "area")
    inside = r.join(F.broadcast(areas), "pattern").where(F.col("area") == F.col("cut_area"))
    cells = cut(inside.groupBy("pattern", "cell").agg(F.sum("size").alias("b"), F.max("area_want").alias("want")), "cell")
    both = areas.join(cells, "pattern", "left")
    r = r.join(F.broadcast(both), "pattern", "left")
    last = r.where(F.col("cell") == F.col("cut_cell"))
    sure = r.where(F.col("cut_cell").isNull() | (F.col("cell") != F.col("cut_cell"))).select(*rows.columns, F.coalesce((F.col("cell") < F.col("cut_cell")).cast("int"), F.lit(1)).alias("extra"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", extra int"
    names = rows.columns

    def fill(pdf):
        import pandas as pd

        left, extra = int(pdf["cell_want"].iloc[0]), []
        pdf = pdf.sort_values(["size", "u"], ascending=[False, True], kind="stable")
        for size in pdf["size"]:
            take = 0 < size <= left
            left -= size if take else 0
            extra.append(int(take))
        out = pd.DataFrame({c: pdf[c] for c in names})
        out["extra"] = extra
        i = pdf.index[(pdf["size"] > left) & (out["extra"] == 0)]
        if left > 0 and len(i):  # one more row where that comes nearer
            best = pdf.loc[i, "size"].idxmin()
            if pdf.loc[best, "size"] - left < left:
                out.loc[best, "extra"] = 1
        return out

    return sure.unionByName(last.groupBy("pattern").applyInPandas(fill, schema))


def mix_documents(documents: DataFrame, members: F.Column, repeats: int = 2, seed: int = 2024, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """(keep..., doc_id, size, pattern, source, source_size, target, copies, taken) of every row.

    members: array of source names that a document belongs to (null names are a source). The
    flow says how many words of a pattern go to each of its sources; a hash deals the
    pattern's documents to these in proportion, and each lot is drawn for its own words.
    source: the one that a row's copies go to (its first one where the flow leaves the pattern
    out); source_size and target are that source's. copies: 0 to repeats; taken = copies *
    size.

    Null text: size 0, never taken. Null ids are ids. Rows of one id and text share their
    place in the draw, and reruns agree up to which of such equal rows is taken. Empty table:
    no rows. Other columns are not read, whatever their names. Sources and patterns, not
    documents, come to the driver; more than MAX_PATTERNS patterns raise an error.
    """
    spark = documents.sparkSession
    kept = [F.col(c).alias(f"keep_{c}") for c in keep]
    d = documents.select(F.col(doc_id).alias("doc_id"), word_count(F.col(text)).alias("size"), F.array_sort(F.array_distinct(members)).alias("m"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"), *kept)
    # null sources survive in the key: a JSON array tells null from the text "null"
    d = d.withColumn("pattern", F.to_json("m", {"ignoreNullFields": "false"}))
    chance = lambda n: F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("crc"), F.lit(n)), 11) / F.lit(float(1 << 53))
    d = materialize(d.select("doc_id", "size", "pattern", "m", chance(seed).alias("u"), chance(seed + 1).alias("lot"), *[f"keep_{c}" for c in keep]), "mix-sizes")
    found = d.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("m").alias("m")).orderBy("pattern").limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    sizes: dict[str | None, int] = {}
    for r in found:
        for s in r["m"]:
            sizes[s] = sizes.get(s, 0) + r["size"]
    want = targets(sizes, weights, share, float(repeats))
    names = sorted((s for s in want if s is not None)) + [None] * (None in want)
    at = {s: i for i, s in enumerate(names)}
    flow = min_cost_flow([r["size"] for r in found], [[at[s] for s in r["m"]] for r in found], [round(want[s]) for s in names], repeats)
    # lots of a pattern: sources with their words, and where each lot of the hash ends
    lots = []
    for r, f in zip(found, flow, strict=True):
        total, ends, left = sum(f), [], 0
        for s in r["m"]:
            if f[at[s]]:
                left += f[at[s]]
                ends.append((left / total, s, f[at[s]]))
        ends = ends or [(1.0, r["m"][0] if r["m"] else None, 0)]
        ends[-1] = (1.0, *ends[-1][1:])
        lots += [(r["pattern"], low, high, f"{r['pattern']} {k}", s, sizes.get(s, 0), float(want.get(s, 0.0)), words) for k, (low, (high, s, words)) in enumerate(zip([0.0] + [e[0] for e in ends], ends, strict=False))]
    table = spark.createDataFrame(lots, "p string, low double, high double, line string, source string, source_size long, target double, words long")
    # a row for each pattern and source of it; MAX_PATTERNS bounds them
    dealt = d.drop("m").join(F.broadcast(table.select("p", "low", "high", "line")), (F.col("pattern") == F.col("p")) & (F.col("lot") >= F.col("low")) & (F.col("lot") < F.col("high"))).drop("p", "low", "high", "lot")
    dealt = dealt.withColumnRenamed("pattern", "members").withColumnRenamed("line", "pattern")
    held = {r["pattern"]: (r["size"], r["n"]) for r in dealt.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    plan = []
    for _, _, _, line, source, source_size, target, words in lots:
        size, n = held.get(line, (0, 0))
        whole, rest = divmod(min(words, repeats * size), size) if size else (0, 0)
        plan.append((line, source, source_size, target, int(whole), int(rest), n))
    table = spark.createDataFrame(plan, "pattern string, source string, source_size long, target double, whole int, want long, n long")
    drawn = draw(dealt, table.select("pattern", "want", "n"))
    out = drawn.join(F.broadcast(table.select("pattern", "source", "source_size", "target", "whole")), "pattern")
    copies = F.col("whole") + F.when(F.col("whole") < repeats, F.col("extra")).otherwise(0)
    out = out.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("int"))
    return out.select(*[F.col(f"keep_{c}").alias(c) for c in keep], "doc_id", "size", F.col("members").alias("pattern"), "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def mix_rows(documents: DataFrame, source: str = "source", repeats: int = 2, seed: int = 2024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix itself: each row of documents as often as the mix takes it, with all its
    columns, whatever their names. Null sources are a source; null and wordless texts are
    never taken; repeated rows are each drawn for themselves. Empty table: no rows."""
    names = documents.columns
    inner = tuple(f"c{i}" for i in range(len(names)))
    d = documents.toDF(*inner)
    mixed = mix_documents(d, F.array(F.col(inner[names.index(source)])), repeats, seed, inner[names.index(doc_id)], inner[names.index(text)], inner)
    mixed = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return mixed.select(*inner).toDF(*names)
