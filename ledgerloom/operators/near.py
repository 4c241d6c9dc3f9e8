"""Rows of equal keys, nearby dates and amounts within a tolerance: all pairs, or the first
partner of each row whose text is alike."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bands import stretches

#: Rows that a task looks at together, and pairs that it makes at a time.
ROWS, PAIRS = 50_000, 2_000_000
#: Ratios of text pairs that a task remembers.
KNOWN = 500_000
FIRST = "entry_id string, preparer_id string, partner string, ratio double, days int, first_cents long, second_cents long"


def _reach(tolerance: float) -> float:
    """Logarithms of amounts within the tolerance are this near, rounding included."""
    return math.log1p(tolerance) + 1e-6


def amount_pairs(rows: DataFrame, keys: list[str], window: int, tolerance: float) -> DataFrame:
    """Pairs (a_<name>, b_<name>), a first by date and id, of unequal positive amounts that
    differ by at most the tolerance of the smaller one. A row lists the somewhat larger
    amounts of its stretch, so a pair is met once, and kept where its first row is at home."""
    names = ["entry_id", "posting_date", "preparer_id", "amount_cents", "description", "tokens"]
    r = stretches(rows.dropna(subset=[*keys, "posting_date"]).where("amount_cents > 0"), "posting_date", window, 4, later_only=True)
    r = r.withColumn("__g", F.ln(F.col("amount_cents").cast("double")))
    by = ", ".join([*keys, "__at"])
    near = f"collect_list(struct({', '.join(names)}, __d, __home)) over (partition by {by} order by __g range between current row and {_reach(tolerance)!r}D following)"
    p = r.withColumn("y", F.expr(near)).withColumn("y", F.explode("y"))
    x, y = F.struct("posting_date", "entry_id"), F.struct("y.posting_date", "y.entry_id")
    lo, hi = F.col("amount_cents"), F.col("y.amount_cents")
    gap = (hi - lo).cast("double") / lo.cast("double")
    p = p.where((lo < hi) & (gap <= tolerance) & (F.abs(F.col("y.__d") - F.col("__d")) <= window) & (F.col("entry_id") != F.col("y.entry_id")))
    first = x < y
    p = p.where((first & F.col("__home")) | (~first & F.col("y.__home"))).withColumn("__first", first)
    a = [F.when(F.col("__first"), F.col(c)).otherwise(F.col(f"y.{c}")).alias(f"a_{c}") for c in names]
    b = [F.when(F.col("__first"), F.col(f"y.{c}")).otherwise(F.col(c)).alias(f"b_{c}") for c in names]
    return p.select(*a, *b)


def first_near(rows: DataFrame, keys: list[str], window: int, tolerance: float, least: float) -> DataFrame:
    """For each row the partner that comes first by date and id, of those of amount_pairs with
    the same reference tokens, or of unlike texts (where one has no tokens) whose ratio is at
    least `least`: (entry_id, preparer_id, partner, ratio, days, first_cents, second_cents),
    ratio null for tokens. Rows meet in one exchange, ordered by amount; pairs stay inside a
    task, so neither they nor rows are shuffled again."""
    r = stretches(rows.dropna(subset=[*keys, "posting_date", "description"]).where("amount_cents > 0"), "posting_date", window)
    r = r.select(*keys, "__at", "__home", "entry_id", "__d", "amount_cents", "description", F.array_join("tokens", "\x1f").alias("tokens"))
    by = [*keys, "__at"]
    r = r.repartition(*by).sortWithinPartitions(*by, "amount_cents")
    return r.mapInArrow(_First(by, window, tolerance, least), FIRST)


class _First:
    def __init__(self, by: list[str], window: int, tolerance: float, least: float):
        self.by, self.window, self.tolerance, self.least = by, window, tolerance, least
        self.known: dict[tuple[str, str], float] = {}

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = settled = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            settled = np.zeros(t.num_rows, bool) if settled is None else np.concatenate([settled, np.zeros(t.num_rows, bool)])
            if np.count_nonzero(~settled) >= ROWS:
                out, held, settled = self.settle(held, settled, False)
                yield from out.to_batches()
        if held is not None:
            yield from self.settle(held, settled, True)[0].to_batches()

    def settle(self, t: pa.Table, settled: np.ndarray, last: bool):
        """Partners of the rows whose amounts' band has come whole; and the rows that later
        ones may still need."""
        n = t.num_rows
        t = t.combine_chunks()
        cell = np.zeros(n, np.int64)
        for c in self.by:
            v = t.column(c).combine_chunks()
            code = v.dictionary_encode().indices.to_numpy(zero_copy_only=False) if pa.types.is_string(v.type) else v.to_numpy(zero_copy_only=False)
            cell[1:] |= code[1:] != code[:-1]
        cell = np.cumsum(cell)
        amount = t.column("amount_cents").to_numpy()
        reach = _reach(self.tolerance)
        place = cell * 64.0 + np.log(amount.astype(np.float64))
        ready = np.ones(n, bool) if last else place + reach < place[-1]
        todo = np.flatnonzero(ready & ~settled & t.column("__home").to_numpy(zero_copy_only=False))
        out = self.partners(t, todo, place, amount, reach)
        settled = settled | ready
        waiting = np.flatnonzero(~settled)
        keep = int(np.searchsorted(place, place[waiting[0]] - reach, "left")) if len(waiting) else n
        return out, t.slice(keep), settled[keep:]

    def partners(self, t: pa.Table, todo: np.ndarray, place: np.ndarray, amount: np.ndarray, reach: float) -> pa.Table:
        day = t.column("__d").to_numpy()
        coded = lambda c: t.column(c).combine_chunks().dictionary_encode()
        ids, texts, tokens = coded("entry_id"), coded("description"), coded("tokens")
        words = np.array(ids.dictionary.to_pylist(), object)
        turn = np.empty(len(words), np.int64)
        turn[np.argsort(words, kind="stable")] = np.arange(len(words))
        id_ = turn[ids.indices.to_numpy()]
        rank = np.empty(len(day), np.int64)
        rank[np.lexsort((id_, day))] = np.arange(len(day))
        text, token = texts.indices.to_numpy().astype(np.int64), tokens.indices.to_numpy()
        text_of = texts.dictionary.to_pylist()
        has = np.array([bool(x) for x in tokens.dictionary.to_pylist()], bool)[token] if len(tokens.dictionary) else np.zeros(len(day), bool)
        lo, hi = np.searchsorted(place, place[todo] - reach, "left"), np.searchsorted(place, place[todo] + reach, "right")
        ends = np.cumsum(hi - lo)
        found_i, found_j, found_r = [], [], []
        at = 0
        while at < len(todo):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            count = (hi - lo)[at:to]
            i = np.repeat(todo[at:to], count)
            j = np.repeat(lo[at:to] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            ok = (np.abs(day[i] - day[j]) <= self.window) & (amount[i] != amount[j]) & (id_[i] != id_[j])
            i, j = i[ok], j[ok]
            small, large = np.minimum(amount[i], amount[j]), np.maximum(amount[i], amount[j])
            both = has[i] & has[j]
            ok = ((large - small).astype(np.float64) / small.astype(np.float64) <= self.tolerance) & np.where(both, token[i] == token[j], text[i] != text[j])
            i, j, both = i[ok], j[ok], both[ok]
            order = np.lexsort((rank[j], i))
            got = self.first(i[order], j[order], both[order], rank, text, text_of)
            for x, y in zip((found_i, found_j, found_r), got, strict=True):
                x.append(y)
            at = to
        i, j, r = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((found_i, np.int64), (found_j, np.int64), (found_r, np.float64)))
        early = rank[i] < rank[j]
        return pa.table({
            "entry_id": t.column("entry_id").take(pa.array(i)), "preparer_id": t.column("preparer_id").take(pa.array(i)), "partner": t.column("entry_id").take(pa.array(j)),
            "ratio": pa.array(r, mask=np.isnan(r)), "days": pa.array(np.abs(day[i] - day[j]).astype(np.int32)),
            "first_cents": pa.array(np.where(early, amount[i], amount[j])), "second_cents": pa.array(np.where(early, amount[j], amount[i])),
        })

    def first(self, i, j, both, rank, text, text_of):
        """The first of each i's pairs, in their order, that passes. Ratios are asked for in
        rounds of 1, 1, 2, 4, ... pairs a row, of rows that have none yet."""
        start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(i)])
        best, ratio = np.full(len(start), -1), np.full(len(start), np.nan)
        done, step = 0, 1
        while True:
            rows = np.flatnonzero((best < 0) & (size > done))
            if not len(rows):
                break
            count = np.minimum(size[rows] - done, step)
            owner = np.repeat(rows, count)
            p = np.repeat(start[rows] + done - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            early = rank[i[p]] < rank[j[p]]
            a, b = np.where(early, text[i[p]], text[j[p]]), np.where(early, text[j[p]], text[i[p]])
            r = np.where(both[p], np.nan, 0.0)
            ask = np.flatnonzero(~both[p])
            if len(ask):
                pairs, back = np.unique(a[ask] * len(text_of) + b[ask], return_inverse=True)
                r[ask] = np.array([self.ratio(text_of[x // len(text_of)], text_of[x % len(text_of)]) for x in pairs.tolist()])[back]
            passed = np.flatnonzero(both[p] | (r >= self.least))
            mine, k = np.unique(owner[passed], return_index=True)
            best[mine], ratio[mine] = p[passed[k]], r[passed[k]]
            done, step = done + step, done + step
        hit = best >= 0
        return i[best[hit]], j[best[hit]], ratio[hit]

    def ratio(self, a: str, b: str) -> float:
        """Ratcliff-Obershelp ratio, order-sensitive; its cheap upper bounds come first."""
        r = self.known.get((a, b))
        if r is None:
            m = SequenceMatcher(None, a, b)
            r = m.ratio() if m.real_quick_ratio() >= self.least and m.quick_ratio() >= self.least else -1.0
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[a, b] = r
        return r
