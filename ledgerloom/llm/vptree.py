"""Approximate nearest neighbours by vantage-point trees, one per shard.

Vectors are scaled to length one, where the largest cosine is the smallest distance. A tree
node keeps a vantage vector and the distances that bound its inner and outer half. The
triangle inequality gives a gap for each half on the way: no vector of the half is nearer than
that. A half is skipped when the largest gap on its way, plus (relax - 1) times the root of
the sum of their squares, exceeds the k-th distance found so far: relax 1 skips only what
cannot hold a nearer vector (exact search), larger values skip more. The registered search
takes relax from a bounded sample, as the largest of RELAX that finds TARGET of the sample's
true neighbours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bound_batches, materialize

#: Factors to choose from, and the share of a sample's neighbours that the chosen one finds.
RELAX = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 12.0, 16.0)
TARGET = 0.95
#: Queries of the sample.
ASKED = 200
#: Blocks of queries that one task holds with a shard.
BLOCKS = 16


class VPTree:
    """A tree over unit vectors; search goes over many queries at once."""

    def __init__(self, vectors: np.ndarray, leaf: int = 96, seed: int = 5):
        self.x = np.ascontiguousarray(vectors)
        self.leaf = leaf
        self.rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []  # (vantage, inner low, inner high, outer low, outer high, inner, outer) or (rows,)
        self.root = self._grow(np.arange(len(vectors)))

    def _grow(self, rows: np.ndarray) -> int:
        if len(rows) <= self.leaf:
            self.nodes.append((rows,))
            return len(self.nodes) - 1
        some = self.rng.choice(rows, min(len(rows), 12), replace=False)
        probe = self.rng.choice(rows, min(len(rows), 60), replace=False)
        spread = [np.var(np.linalg.norm(self.x[probe] - self.x[i], axis=1)) for i in some]
        v = int(some[int(np.argmax(spread))])
        d = np.linalg.norm(self.x[rows] - self.x[v], axis=1)
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        a, b = order[:half], order[half:]
        if d[order[0]] == d[order[-1]]:  # nothing to split by
            self.nodes.append((rows,))
            return len(self.nodes) - 1
        at = len(self.nodes)
        self.nodes.append(())
        inner, outer = self._grow(rows[a]), self._grow(rows[b])
        self.nodes[at] = (v, d[a].min(), d[a].max(), d[b].min(), d[b].max(), inner, outer)
        return at

    def search(self, queries: np.ndarray, k: int, relax: float = 1.0, slack: float = 1e-9) -> list[np.ndarray]:
        """Row numbers of each query's candidates: all rows found whose distance is within
        slack of the k-th smallest found. `compared` counts the rows that queries met in
        leaves."""
        n = len(queries)
        near = np.full((n, k), np.inf)
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        self.compared = 0

        def offer(q: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
            keep = d <= near[q, -1:] + slack
            best = np.sort(np.concatenate([near[q], np.where(keep, d, np.inf)], axis=1), axis=1)[:, :k]
            near[q] = best
            for i in np.flatnonzero(keep.any(axis=1)):
                found[q[i]].append((rows[keep[i]], d[i][keep[i]]))

        def visit(at: int, q: np.ndarray, most: np.ndarray, squares: np.ndarray) -> None:
            node = self.nodes[at]
            if len(node) == 1:
                rows = node[0]
                self.compared += len(rows) * len(q)
                sq = np.maximum(2 - 2 * (queries[q] @ self.x[rows].T), 0)
                offer(q, rows, np.sqrt(sq))
                return
            v, lo1, hi1, lo2, hi2, inner, outer = node
            d = np.linalg.norm(queries[q] - self.x[v], axis=1)
            gap1 = np.maximum(np.maximum(lo1 - d, d - hi1), 0)
            gap2 = np.maximum(np.maximum(lo2 - d, d - hi2), 0)
            first = gap1 - (d < (hi1 + lo2) / 2) * 1e-12 <= gap2

            def enter(child: int, which: np.ndarray, gap: np.ndarray) -> None:
                top, sum_ = np.maximum(most, gap), squares + gap * gap
                which = which & (top + (relax - 1) * np.sqrt(sum_) <= near[q, -1] + slack)
                if which.any():
                    visit(child, q[which], top[which], sum_[which])

            enter(inner, first, gap1)
            enter(outer, ~first, gap2)
            enter(outer, first, gap2)
            enter(inner, ~first, gap1)

        if len(self.x) and n:
            visit(self.root, np.arange(n), np.zeros(n), np.zeros(n))
        out = []
        for i in range(n):
            if not found[i]:
                out.append(np.zeros(0, np.int64))
                continue
            rows, d = (np.concatenate(x) for x in zip(*found[i], strict=True))
            out.append(np.unique(rows[d <= near[i, -1] + slack]))
        return out


def chosen_relax(unit: np.ndarray, k: int, target: float = TARGET, asked: int = ASKED) -> float:
    """The largest of RELAX that, among the sample's unit vectors, finds `target` of the k
    nearest of `asked` of them; 1 for an empty sample."""
    if not len(unit):
        return 1.0
    q = unit[:: max(1, len(unit) // asked)][:asked]
    d = np.sort(np.sqrt(np.maximum(2 - 2 * (q @ unit.T), 0)), axis=1)[:, : k + 1]
    tree, best = VPTree(unit), 1.0
    for relax in RELAX[1:]:
        got = tree.search(q, d.shape[1], relax)
        hits = sum(int((np.sqrt(np.maximum(2 - 2 * (q[i] @ unit[r].T), 0)) <= d[i, -1] + 1e-9).sum()) for i, r in enumerate(got))
        if hits < target * d.size:
            break
        best = relax
    return best


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by way of their largest component, so nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b, each row summed alone, so equal rows give equal bits."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5, relax: float | None = None, shard_rows: int = 4096, block: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k
    rows of largest cosine found among all others, ties to the smaller id.

    Rows without an id, and vectors that are null, empty, zero or hold a null or a value
    that is not finite, take no part; vectors meet only vectors of their own length. Rows of
    one vector are indexed once with their k + 1 smallest ids, so copies cost nothing.
    Repeated ids: a query never finds a row of its own id. Empty table: no rows.

    Other columns are not read. relax: see VPTree.search; None takes it from one shard of
    vectors at most, 1 is exact.

    Every shard (about shard_rows different vectors, dealt by hash) gets every block of
    queries, the stated query set against all rows; a block travels as one packed row, a task
    holds a shard and BLOCKS blocks at most, and a shard hands on k answers for each query.
    """
    spark = embeddings.sparkSession
    bound_batches(spark)
    v = F.col(vector).cast("array<double>")
    d = embeddings.select(F.col(vec_id).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    d = d.where(F.expr("size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(v, x -> x <> 0)"))
    d = d.groupBy("v", "id").agg(F.lit(1).alias("one")).drop("one")
    rank = F.row_number().over(W.partitionBy("v").orderBy("id"))
    base = materialize(d.withColumn("n", rank).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vp-vectors")
    counted = base.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()
    if not counted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = max(1, -(-max(r["n"] for r in counted) // shard_rows))
    rows = base.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "v", "ids")
    if relax is None:
        most = max(counted, key=lambda r: (r["n"], r["dim"]))["dim"]
        some = rows.where((F.col("dim") == most) & (F.col("shard") == 0)).select("v").orderBy(F.xxhash64("v")).limit(shard_rows).toPandas()["v"].tolist()
        relax = chosen_relax(_unit(np.array(sorted(map(tuple, some)), np.float64).reshape(-1, most)), k)
    asked = d.where(F.col("id") % every == 0)
    n_asked = asked.count()
    blocks = max(1, -(-n_asked // block))
    asked = asked.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), "v", "id")
    # one row a block, then one copy of it for each shard
    packed = asked.groupBy("dim", "b").agg(F.collect_list(F.struct("id", "v")).alias("q"))
    groups = -(-blocks // BLOCKS)
    spread = packed.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), (F.col("b") % groups).alias("part"), "q")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(key, left, right):
        dim = key[0]
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        x = np.array(left["v"].tolist(), np.float64).reshape(-1, dim)
        tree = VPTree(_unit(x))
        ids = left["ids"].tolist()
        out_q, out_v, out_s = [], [], []
        for q in right["q"]:
            qid = np.array([r["id"] for r in q], np.int64)
            y = np.array([r["v"] for r in q], np.float64).reshape(-1, dim)
            # the query's own vector may fill a place: one more is asked for
            for i, rows_ in enumerate(tree.search(_unit(y), k + 1, relax)):
                if not len(rows_):
                    continue
                score = cosine(np.broadcast_to(y[i], (len(rows_), dim)), x[rows_])
                got = [(-s, w) for s, r in zip(score, rows_, strict=True) for w in ids[r] if w != qid[i]]
                got.sort()
                for s, w in got[:k]:
                    out_q.append(qid[i])
                    out_v.append(w)
                    out_s.append(-s)
        return pd.DataFrame({"query_id": np.array(out_q, np.int64), "vec_id": np.array(out_v, np.int64), "score": np.array(out_s, np.float64)})

    near = rows.groupBy("dim", "shard", "part").cogroup(spread.groupBy("dim", "shard", "part")).applyInPandas(search, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
