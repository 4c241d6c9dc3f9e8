"""Naive Bayes support vectors: hashed n-gram indicators scaled by class log-count ratios,
a linear hinge-loss model by dual coordinate descent, and a logistic calibration.

The model is fitted on the driver from a bounded sample of labelled rows
(`sample_rows`, whose features come from the executors as integer lists, never as texts).
Scoring is one narrow map over whole texts: no shuffle, memory of one step of text.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, combine, in_fold, materialize, steps, trimmed, utf8, word_hashes, word_spans

#: Labelled rows that a fit takes at most, and those of each class that choose its features.
SAMPLE_ROWS = 20_000
CHOOSE_ROWS = 800
#: Bytes of text whose features are made at once: a dozen arrays of their size are alive then.
STEP = 1 << 18
#: Rows at a time, however short.
STEP_ROWS = 256
#: Bits of the hashed feature table.
BITS = 22

Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def characters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character of the rows (A-Z lower-cased), and the rows' offsets in
    characters. A character is a byte and the continuation bytes behind it."""
    b = _LOWER[raw].astype(np.uint32)
    if not len(raw) or raw.max() < 128:
        return b, offsets
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    b = b[starts]
    wide = np.flatnonzero(raw[starts] >= 0xC0)
    for j in range(1, 4):
        p = starts[wide] + j
        wide, p = wide[p < len(raw)], p[p < len(raw)]
        more = (raw[p] & 0xC0) == 0x80
        wide, p = wide[more], p[more]
        b[wide] = b[wide] << np.uint32(8) | raw[p]
    return b, np.searchsorted(starts, offsets)


def char_ngrams(raw: np.ndarray, offsets: np.ndarray, orders=(4, 5, 6, 7, 8, 9), bits: int = BITS):
    """(row, feature) of every character n-gram of the lower-cased rows, n-grams within a row."""
    rows, feats = [], []
    b, offsets = characters(raw, offsets)
    row_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    n = len(b)
    with np.errstate(over="ignore"):
        h = b.copy()
        for k in range(2, max(orders) + 1):
            if n < k:
                break
            h = h[: n - k + 1] * np.uint32(0x01000193) + b[k - 1 :]
            if k in orders:
                x = (h ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                x = (x ^ (x >> np.uint32(15))) >> np.uint32(32 - bits) if bits < 32 else x
                same = row_of[: n - k + 1] == row_of[k - 1 :]
                rows.append(row_of[: n - k + 1][same])
                feats.append(x[same])
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.uint32)
    return np.concatenate(rows), np.concatenate(feats)


#: Bytes that neighbouring parts of a long row share, so that no n-gram is lost between them.
char_ngrams.overlap = 4 * 9


def found(features: Features, raw: np.ndarray, offsets: np.ndarray):
    """(first row, last row, rows, features) of runs of rows: at most STEP bytes and STEP_ROWS
    rows at a time. A longer row comes in overlapping parts where the features allow it, so
    memory does not follow the longest text; a feature may then come more than once."""
    overlap = getattr(features, "overlap", None)
    for a, b in steps(offsets, STEP):
        if overlap and offsets[b] - offsets[a] > STEP:
            for at in range(offsets[a], offsets[b], STEP):
                end = min(offsets[b], at + STEP)
                while end < offsets[b] and raw[end] & 0xC0 == 0x80:  # a character stays whole
                    end += 1
                part = raw[max(offsets[a], at - overlap) : end]
                yield (a, b, *features(part, np.array([0, len(part)])))
            continue
        for i in range(a, b, STEP_ROWS):
            j = min(b, i + STEP_ROWS)
            yield (i, j, *features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))


_KIND = np.full(256, 1, np.uint8)  # 1: letters without case and bytes of longer characters
_KIND[:128] = 0
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3


def form_ngrams(raw: np.ndarray, offsets: np.ndarray, orders=(1, 2, 3), bits: int = BITS):
    """(row, feature) of word-form n-grams.

    A word's form: kind of its first character and of its second (lower, upper, digit or the
    very symbol), its last three characters' kinds or symbols, and whether the words from it
    on (one, and three) repeat what the same text said earlier. Letters never enter as such,
    so the forms carry over to unseen words and languages.
    """
    starts, ends, counts = word_spans(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.uint32)
    row_of = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    form = np.where(_KIND[raw] > 0, _KIND[raw], raw).astype(np.uint64)
    at = lambda p, ok: np.where(ok, form[np.clip(p, 0, len(raw) - 1)], 0)
    size = ends - starts
    words = word_hashes(raw, starts, ends)
    n = len(words)
    again = np.zeros(n, np.uint64)
    again[1:] = (words[1:] == words[:-1]) & (row_of[1:] == row_of[:-1])
    seen = np.zeros(n, np.uint64)
    if n >= 3:
        with np.errstate(over="ignore"):
            tri = combine([words[:-2], words[1:-1], words[2:], row_of[:-2].astype(np.uint64)])
        inside = row_of[:-2] == row_of[2:]
        order = np.argsort(tri, kind="stable")
        later = np.zeros(n - 2, bool)
        later[order[1:]] = tri[order[1:]] == tri[order[:-1]]
        seen[:-2] = later & inside
    long = np.minimum(size, 12) // 4
    token = combine([at(starts, size > 0), at(starts + 1, size > 1), at(ends - 1, size > 0), at(ends - 2, size > 1), at(ends - 3, size > 2), again, seen, long.astype(np.uint64)])
    rows, feats = [], []
    for k in orders:
        if n < k:
            break
        h = combine([np.full(n - k + 1, k, np.uint64), *(token[j : n - k + 1 + j] for j in range(k))])
        same = row_of[: n - k + 1] == row_of[k - 1 :]
        rows.append(row_of[: n - k + 1][same])
        feats.append((h[same] >> np.uint64(64 - bits)).astype(np.uint32))
    return np.concatenate(rows), np.concatenate(feats)


@dataclass
class Model:
    """Weights of chosen features and the calibration of their sum."""

    features: Features
    slots: np.ndarray  # of the hash table: number of the chosen feature, or -1
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    meta: dict = field(default_factory=dict)

    def decision(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, k = len(offsets) - 1, len(self.weights)
        out = np.full(n, self.bias)
        if not k:
            return out
        held, present = None, None
        for a, b, rows, feats in found(self.features, raw, offsets):
            if held != (a, b):
                if held:
                    out[held[0] : held[1]] += (present * self.weights).sum(axis=1)
                held, present = (a, b), np.zeros((b - a, k), np.bool_)
            at = self.slots[feats]
            hit = at >= 0
            present[rows[hit], at[hit]] = True
        if held:
            out[held[0] : held[1]] += (present * self.weights).sum(axis=1)
        return out

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.decision(raw, offsets) + self.shift, -500, 500)))


def log_count_ratios(docs: list[np.ndarray], y: np.ndarray, k: int, alpha: float = 1.0) -> np.ndarray:
    """ln of (smoothed share of the feature among class 1) / (the same of class 0)."""
    p, q = np.full(k, alpha), np.full(k, alpha)
    for x, c in zip(docs, y, strict=True):
        (p if c else q)[x] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(docs: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 30, tol: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss (L1) support vectors: minimise |w|^2/2 + cost * sum hinge, one dual
    variable at a time in random order, with projected-gradient stopping. docs: indices of
    present features, values: what a present feature counts. Returns weights and bias."""
    w, bias, rng = np.zeros(len(values)), 0.0, np.random.default_rng(seed)
    sign = np.where(y > 0, 1.0, -1.0)
    n = len(docs)
    square = np.array([float((values[x] ** 2).sum()) + 1.0 for x in docs])
    balance = np.where(y > 0, n / max(1, 2 * (y > 0).sum()), n / max(1, 2 * (y <= 0).sum())) * cost
    alpha = np.zeros(n)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n):
            x = docs[i]
            g = sign[i] * (float(w[x] @ values[x]) + bias) - 1
            pg = min(g, 0.0) if alpha[i] <= 0 else max(g, 0.0) if alpha[i] >= balance[i] else g
            worst = max(worst, abs(pg))
            if pg:
                new = min(max(alpha[i] - g / square[i], 0.0), balance[i])
                step = (new - alpha[i]) * sign[i]
                alpha[i] = new
                w[x] += step * values[x]
                bias += step
        if worst < tol:
            break
    return w, bias


def calibrate(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through decision values, by Newton steps on
    targets drawn in by the class sizes, as Platt does."""
    pos, neg = int((y > 0).sum()), int((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        g = np.array([((p - t) * f).sum() + 1e-3 * a, (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * f * f).sum() + 1e-3, (s * f).sum()], [(s * f).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        size = np.abs(d).max()
        d = d * min(1.0, 5.0 / max(size, 1e-12))
        a, b = a - d[0], b - d[1]
        if size < 1e-8:
            break
    return float(a), float(b)


def _distinct(features: Features, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None):
    """((first row, last row), sorted different row << 32 | feature) of runs of rows; with a
    table, of its numbers of the features that it has."""
    for run, parts in itertools.groupby(found(features, raw, offsets), key=lambda x: x[:2]):
        pairs = np.zeros(0, np.int64)
        for _, _, rows, feats in parts:
            if table is not None:
                feats = table[feats]
                rows, feats = rows[feats >= 0], feats[feats >= 0]
            pairs = np.union1d(pairs, rows.astype(np.int64) << 32 | feats.astype(np.int64))
        yield run, pairs


def _choose(texts: DataFrame, ids: pd.DataFrame, features: Features, most: int, least_docs: int) -> np.ndarray:
    """The table slots to use: those whose presence depends most on the class, by the G
    statistic. Tasks count a slot's rows by class and Spark adds the counts up, so only the
    chosen slots come to the driver, however long the texts."""
    spark = texts.sparkSession
    some = F.broadcast(spark.createDataFrame(ids[["id", "y"]], "id string, y int"))
    least_docs = min(least_docs, max(1, len(ids) // 4))

    def total(held):
        slots, n = np.unique(np.concatenate(held), return_counts=True)
        one = slots & 1
        return pa.RecordBatch.from_arrays([pa.array((slots >> 1).astype(np.int64)), pa.array(n * one), pa.array(n * (1 - one))], ["slot", "p", "q"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for (a, b), pairs in _distinct(features, raw, offsets):
                held += [(pairs & 0xFFFFFFFF) << 1 | y[a + (pairs >> 32)], -2 | y[a:b]]
                size += len(pairs)
                if size > 1_000_000:
                    yield total(held)
                    held, size = [], 0
        if held:
            yield total(held)

    counts = texts.join(some, "id").select("y", "text").mapInArrow(trimmed(run), "slot long, p long, q long").groupBy("slot").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    counts = materialize(counts.where((F.col("p") + F.col("q") >= least_docs) | (F.col("slot") < 0)), "nbsvm-slots")
    sizes = counts.where("slot < 0").first()  # slot -1 counts the rows themselves
    if sizes is None or not sizes["p"] or not sizes["q"]:
        return np.zeros(0, np.int64)
    n1, n0 = F.lit(float(sizes["p"])), F.lit(float(sizes["q"]))
    part = lambda o, e: o * F.log(F.greatest(o, F.lit(1e-12)) / F.greatest(e, F.lit(1e-12)))
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    share = (p + q) / (n1 + n0)
    g = part(p, n1 * share) + part(q, n0 * share) + part(n1 - p, n1 * (1 - share)) + part(n0 - q, n0 * (1 - share))
    best = counts.where("slot >= 0").withColumn("g", F.round(g, 6)).where("g > 3").orderBy(F.desc("g"), "slot").limit(most)
    return np.sort(best.toPandas()["slot"].to_numpy(np.int64))


def fit(docs: list[np.ndarray], y: np.ndarray, chosen: np.ndarray, features: Features, bits: int = BITS, cost: float = 0.1, folds: int = 3, fresh: np.ndarray | None = None) -> Model:
    """docs: each row's indices into chosen (the table slots in use). fresh: rows that took
    no part in choosing them; if both classes are among those, the calibration uses these
    alone. An empty or one-class sample gives a constant score: near the class if there is
    one, 0.5 if there is no row."""
    slots = np.full(1 << bits, -1, np.int16)
    if len(y) == 0 or len(set(y.tolist())) < 2:
        p = 0.5 if len(y) == 0 else (len(y) * float(y[0] > 0) + 0.5) / (len(y) + 1)
        return Model(features, slots, np.zeros(0), 0.0, 0.0, float(np.log(p / (1 - p))), {"rows": len(y)})
    slots[chosen] = np.arange(len(chosen), dtype=np.int16)

    def solve(rows: np.ndarray):
        sub, c = [docs[i] for i in rows], y[rows]
        if len(set(c.tolist())) < 2:
            return None
        r = log_count_ratios(sub, c, len(chosen)) if len(chosen) else np.zeros(0)
        w, bias = dual_coordinate_descent(sub, r, c, cost)
        return w * r, bias

    order = np.random.default_rng(11).permutation(len(y))
    f, known = np.zeros(len(y)), np.zeros(len(y), bool)
    for k in range(folds):
        test = order[k::folds]
        got = solve(np.setdiff1d(order, test))
        if got is None:
            continue
        f[test] = [got[1] + got[0][docs[i]].sum() for i in test]
        known[test] = True
    w, bias = solve(np.arange(len(y)))
    both = lambda m: m.any() and len(set(y[m].tolist())) == 2
    if fresh is not None and both(known & fresh) and min((y[known & fresh] > 0).sum(), (y[known & fresh] <= 0).sum()) >= 50:
        known &= fresh
    elif not both(known):
        known[:] = True
        f = np.array([bias + w[x].sum() for x in docs])
    slope, shift = calibrate(f[known], y[known])
    return Model(features, slots, w, bias, slope, shift, {"rows": len(y), "features": len(w)})


def sample_labelled(labels: DataFrame, label: str, train, rows: int, doc_id: str = "doc_id") -> pd.DataFrame:
    """(id as text, label) of at most `rows` labelled training ids: labels disagreeing on an
    id are averaged and rounded, null labels and ids drop out, and the ids are taken in the
    order of a hash, so the sample is the same in every run and partitioning."""
    y = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & train)
    y = y.groupBy(F.col(doc_id).cast("string").alias("id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    return y.orderBy(F.xxhash64("id"), "id").limit(rows).toPandas()


def _features_of(texts: DataFrame, ids: pd.DataFrame, features: Features, slots: np.ndarray) -> pd.DataFrame:
    """(id, f) of the sampled rows: f the numbers of the chosen features it has, as 32-bit
    integers. The ids are broadcast; their number is bounded by the sample."""
    spark = texts.sparkSession
    chosen = F.broadcast(spark.createDataFrame(ids[["id"]], "id string"))
    shared = spark.sparkContext.broadcast(slots)

    def extract(batches):
        table = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            lists = []
            for (a, b), pairs in _distinct(features, raw, offsets, table):
                cut = np.searchsorted(pairs >> 32, np.arange(b - a + 1))
                low = (pairs & 0xFFFFFFFF).astype(np.int32)
                lists += [low[cut[i] : cut[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.binary())], ["id", "f"])

    got = texts.join(chosen, "id").select("id", "text").mapInArrow(trimmed(extract), "id string, f binary").toPandas()
    return got.sort_values(["id", "f"], kind="stable").drop_duplicates("id") if len(got) else got


def train_model(documents: DataFrame, labels: DataFrame, label: str, features: Features, fold: tuple[int, int], doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, choose_rows: int = CHOOSE_ROWS, bits: int = BITS, most: int = 2048, least_docs: int = 3, **options) -> Model:
    """Fit on labelled rows outside fold (parts, held_out): features are chosen on at most
    `choose_rows` rows of each class, ratios, weights and calibration come from at most
    `sample_rows` rows. Of an id with several texts one text trains."""
    parts, held = fold
    ids = sample_labelled(labels, label, ~in_fold(doc_id, parts, held), sample_rows, doc_id)
    if not len(ids) or ids["y"].nunique() < 2:
        return fit([], ids["y"].to_numpy(np.int64), np.zeros(0, np.int64), features, bits)
    texts = documents.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    few = ids.groupby("y").head(choose_rows)
    chosen = _choose(texts, few, features, most, least_docs)
    slots = np.full(1 << bits, -1, np.int16)
    slots[chosen] = np.arange(len(chosen), dtype=np.int16)
    got = _features_of(texts, ids, features, slots).merge(ids, on="id")
    fresh = ~got["id"].isin(set(few["id"])).to_numpy()
    return fit([np.frombuffer(x, np.int32) for x in got["f"]], got["y"].to_numpy(np.int64), chosen, features, bits, fresh=fresh, **options)


def score_documents(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row; a null text scores as an empty one."""
    kind = documents.schema[doc_id].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.score(raw, offsets), pa.float64())], ["doc_id", "score"])

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(run), f"doc_id {kind}, score double")
