"""LM scoring with a gated recurrent language model in numpy.

Words are numbered by how often the training documents hold them. The most frequent ones
(the end of a document among them), HEAD_ROOT times the root of the number of distinct words,
have an input and an output of their own in the network; its output softmax is factored into
classes of nearly equal mass and words within a class. The other words fall into BANDS of
like counts, the last one of all words that are not near; a band is one input and one more
class, and its words divide its probability by their counts.

Training is truncated back-propagation: lanes of documents are cut into windows, gradients
stay inside a window, the state goes on into the next. The training documents are dealt to a
few rounds, and a round's to parts that are trained apart and whose parameters are averaged,
so every training document is learned once, to its end. Scoring carries the state across
windows from a document's first word to its end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, in_fold, materialize, steps, trimmed, utf8, word_hashes, word_spans

#: Head words: HEAD_ROOT times the square root of the number of distinct words.
HEAD_ROOT = 4
#: Bands of other words, by count.
BANDS = 4
#: A near word with a count up to this is in the last band, with words never seen: what is
#: rare in training texts stands for what is new in others.
RARE = 8
HIDDEN = 16
#: Words whose counts are broadcast for direct look-up (16 bytes each); others are joined.
NEAR = 200_000
#: Shares of the training documents that are learned one after the other, each document once.
ROUNDS = 3
#: Tokens of each part of a share that is trained apart.
PART_TOKENS = 1_000_000
#: Lanes of a part, and the size of the first round's steps.
WIDTH = 384
RATE = 0.03
#: Tokens that a task scores at a time.
SCORED = 1 << 21
#: Parameters in one row of a task's result.
PIECE = 1 << 15
END = np.uint64(0xE0D0E0D0E0D0E0D1)
LN10 = np.log(10.0)


def tokens_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' tokens, each row closed by END, and the n + 1 offsets of rows."""
    starts, ends, counts = word_spans(raw, offsets)
    h = word_hashes(raw, starts, ends)
    rows = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(rows[-1], END, np.uint64)
    word = np.ones(rows[-1], bool)
    word[rows[1:] - 1] = False
    out[word] = h
    return out, rows


def token_counts(texts: DataFrame) -> DataFrame:
    """(h, c) over all rows of texts; tasks add up half a million tokens before they hand on."""

    def batch_of(held):
        v, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for a, b in steps(offsets):
                h, _ = tokens_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                held.append(h)
                size += len(h)
                if size > 1_000_000:
                    yield batch_of(held)
                    held, size = [], 0
        if size:
            yield batch_of(held)

    return texts.select("text").mapInArrow(trimmed(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


class Vocabulary:
    """The head words, their classes, the bands of other words, and the near words' counts.

    Numbers: head words from 0, bands from k (the last one holds what is not near), then the
    start of a document."""

    def __init__(self, near_h: np.ndarray, near_c: np.ndarray, head: np.ndarray, total: int, distinct: int, bands: int = 1):
        order = np.argsort(near_h)
        self.h, self.c = near_h[order], near_c[order].astype(np.int64)
        bits = max(8, len(self.h).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.cell = np.searchsorted((self.h >> self.shift).astype(np.int64), np.arange((1 << bits) + 1))
        at = np.searchsorted(self.h, head)
        self.k = len(head)
        self.bands = bands
        self.start = self.k + bands
        self.number = np.full(len(self.h) + 1, self.start - 1, np.int32)  # of each near word, and of all others
        if bands > 1 and len(self.h):  # equal in the logarithm of the count; the rarest with those not near
            rest = np.ones(len(self.h), bool)
            rest[at] = False
            lc = np.log(self.c)
            top = lc[rest].max() if rest.any() else 0.0
            low = max(np.log(RARE), lc.min())
            self.number[:-1] = self.k + np.clip((top - lc) / max(top - low, 1e-9) * (bands - 1), 0, bands - 1).astype(np.int32)
        self.number[at] = np.arange(self.k)
        self.head_c = self.c[at]
        self.total, self.distinct = total, distinct
        self.log_c = np.append(np.log10(self.c + 0.5), 0.0)
        # classes in order of frequency, each of nearly the same mass
        n = self.classes = max(1, round(0.6 * np.sqrt(self.k)))
        mass = np.cumsum(np.sqrt(self.head_c))
        self.of = np.minimum((mass - 1e-9) / max(mass[-1], 1e-9) * n, n - 1).astype(np.int32) if self.k else np.zeros(0, np.int32)
        self.first = np.searchsorted(self.of, np.arange(n + 1))
        # masses of bands; the last also holds one word never seen
        b = self.number[:-1] - self.k
        rest = b >= 0
        self.mass = np.bincount(b[rest], self.c[rest] + 0.5, bands).astype(float)
        self.mass[-1] = (total - int(self.head_c.sum())) + 0.5 * (distinct - self.k + 1) - self.mass[:-1].sum()
        self.other_mass = float(self.mass[-1])
        #: log10 of a near word's share of its band, 0 for head words and what is not near
        self.log_share = np.zeros(len(self.h) + 1)
        self.log_share[:-1][rest] = self.log_c[:-1][rest] - np.log10(self.mass[b[rest]])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each token among the near words, len(near) if it is none: the first of the
        sorted near words that share the token's top bits, then the next ones."""
        n = len(self.h)
        cell = (h >> self.shift).astype(np.int64)
        at, end = self.cell[cell], self.cell[cell + 1]
        out = np.full(len(h), n, np.int64)
        todo = np.flatnonzero(at < end)
        at, end, h = at[todo], end[todo], h[todo]
        while len(todo):
            hit = self.h[at] == h
            out[todo[hit]] = at[hit]
            at = at + 1
            go = ~hit & (at < end)
            todo, at, end, h = todo[go], at[go], end[go], h[go]
        return out


def new_model(v: Vocabulary, seed: int = 3) -> dict[str, np.ndarray]:
    """Random recurrent weights; output biases start at the words' shares. The gates update,
    reset and candidate lie one after the other in wx, u and b."""
    rng, k = np.random.default_rng(seed), v.k
    f = np.float32
    m = {
        "wx": rng.normal(0, 0.1, (3, v.start + 1, HIDDEN)).astype(f),  # inputs: head words, bands, start
        "u": (rng.normal(0, 1, (3, HIDDEN, HIDDEN)) / np.sqrt(HIDDEN)).astype(f),
        "b": np.zeros((3, HIDDEN), f),
        "wc": np.zeros((HIDDEN, v.classes + v.bands), f),
        "bc": np.zeros(v.classes + v.bands, f),
        "ww": rng.normal(0, 0.01, (k, HIDDEN)).astype(f),
        "bw": np.log(v.head_c + 0.5).astype(f),
    }
    mass = np.bincount(v.of, v.head_c, v.classes) if k else np.zeros(v.classes)
    m["bc"][: v.classes] = np.log(mass + 0.5)
    m["bc"][v.classes :] = np.log(np.maximum(v.mass, 0.5))
    m["bc"] -= m["bc"].max()
    for c in range(v.classes):  # the scores of a class start near zero
        a, b = v.first[c], v.first[c + 1]
        if a < b:
            m["bw"][a:b] -= m["bw"][a:b].max()
    return m


def lanes(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Pieces dealt to lanes, longest first to the shortest lane; lanes by falling length."""
    import heapq

    width = max(1, min(width, len(lengths)))
    heap = [(0, i) for i in range(width)]
    out: list[list[int]] = [[] for _ in range(width)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        size, i = heapq.heappop(heap)
        out[i].append(d)
        heapq.heappush(heap, (size + int(lengths[d]), i))
    return sorted(out, key=lambda x: -sum(int(lengths[d]) for d in x))


class Lanes:
    """Token sequences side by side. A lane is a row of pieces: whole documents, or with `cut`
    parts of at most so many tokens, each of which starts from the zero state. Memory is a few
    numbers a token, however long the longest document."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, width: int, start: int, cut: int = 0):
        self.ids, self.start = ids, start
        size = np.diff(rows)
        n = -(-size // cut) if cut else np.ones(len(size), np.int64)
        doc = np.repeat(np.arange(len(size)), n)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        first = rows[:-1][doc] + nth * cut
        length = np.minimum(rows[1:][doc] - first, cut) if cut else size
        plan = lanes(length, width)
        order = np.array([d for x in plan for d in x], np.int64)
        k = length[order]
        ends = np.cumsum(k)
        self.token = (np.repeat(first[order] - (ends - k), k) + np.arange(ends[-1] if len(ends) else 0)).astype(np.int32)
        self.opens = np.zeros(len(self.token), bool)  # places of pieces' first tokens
        self.opens[ends - k] = True
        self.begins = np.zeros(len(ids), bool)  # tokens that begin a document
        self.begins[rows[:-1]] = True
        self.size = np.array([int(length[x].sum()) for x in plan], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def windows(self, length: int):
        """(token, valid, target, before, carry) of each window, steps x live lanes: where a
        lane has ended, valid is False; carry is 0 where a piece begins, else 1."""
        for t in range(0, int(self.size.max(initial=0)), length):
            live = int((self.size > t).sum())
            step = np.arange(t, min(t + length, int(self.size[0])))[:, None]
            valid = step < self.size[:live]
            place = np.minimum(self.at[:live] + step, self.at[:live] + self.size[:live] - 1)
            token = self.token[place]
            before = np.where(self.begins[token], self.start, self.ids[np.maximum(token - 1, 0)])
            yield token, valid, self.ids[token], before, np.where(self.opens[place], np.float32(0), np.float32(1))


def _states(m: dict, before: np.ndarray, carry: np.ndarray, h: np.ndarray, keep: bool = False):
    """Hidden states after each step's input, the last one, and (if asked for) what
    back-propagation needs. Update and reset gates are (1 + tanh) / 2."""
    steps_, width = before.shape
    x = before.ravel()
    a = [np.take(m["wx"][g], x, axis=0) for g in range(3)]
    for g in range(3):
        a[g] += m["b"][g]
        a[g] = a[g].reshape(steps_, width, HIDDEN)
    out = np.empty((steps_, width, HIDDEN), np.float32)
    saved = np.empty((5, steps_ if keep else 1, width, HIDDEN), np.float32)
    for t in range(steps_):
        z, r, n, gn, p = saved[:, t if keep else 0]
        np.multiply(h, carry[t][:, None], out=p)
        for gate, g in ((z, 0), (r, 1)):
            np.matmul(p, m["u"][g], out=gate)
            gate += a[g][t]
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
        np.matmul(p, m["u"][2], out=gn)
        np.multiply(r, gn, out=n)
        n += a[2][t]
        np.tanh(n, out=n)
        h = out[t]
        np.subtract(p, n, out=h)
        h *= z
        h += n
    return out, h, saved


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the rows, kept below the largest 32-bit numbers, and the rows' sums."""
    np.minimum(x, np.float32(80), out=x)
    e = np.exp(x)
    total = e @ np.ones(x.shape[1], np.float32)
    total += np.float32(1e-35)
    return e, total


def log_probs(m: dict, v: Vocabulary, h: np.ndarray, target: np.ndarray, grad: dict | None = None):
    """Natural log probability of each target given its state; with grad (zeros), puts the
    output layers' gradients of the mean negative log-likelihood there and returns that of the
    states."""
    of = np.append(v.of, v.classes + np.arange(v.bands, dtype=np.int32))[target]
    # tokens of a class lie together
    order = np.argsort(of.astype(np.int16) if v.classes + v.bands < 1 << 15 else of, kind="stable")
    of, y, h = of[order], target[order], h[order]
    rows, one = np.arange(len(h)), np.ones(len(h), np.float32)
    x = h @ m["wc"]
    x += m["bc"]
    e, total = _softmax(x)
    got = x[rows, of] - np.log(total)
    dh = None
    if grad is not None:
        total *= np.float32(len(h))
        e *= (1 / total)[:, None]
        e[rows, of] -= np.float32(1 / len(h))
        grad["wc"] += h.T @ e
        grad["bc"] += one @ e
        dh = e @ m["wc"].T
    cut = np.searchsorted(of, np.arange(v.classes + 1))
    for c in range(v.classes):
        a, b = v.first[c], v.first[c + 1]
        i, j = cut[c], cut[c + 1]
        if i == j or b - a < 2:
            continue
        hi = h[i:j]
        x = hi @ m["ww"][a:b].T
        x += m["bw"][a:b]
        e, total = _softmax(x)
        k, w = rows[: j - i], y[i:j] - a
        got[i:j] += x[k, w] - np.log(total)
        if grad is not None:
            total *= np.float32(len(h))
            e *= (1 / total)[:, None]
            e[k, w] -= np.float32(1 / len(h))
            np.matmul(e.T, hi, out=grad["ww"][a:b])
            grad["bw"][a:b] = one[: j - i] @ e
            dh[i:j] += e @ m["ww"][a:b]
    out = np.empty(len(got), got.dtype)
    out[order] = got
    if grad is not None:
        back = np.empty_like(dh)
        back[order] = dh
        dh = back
    return out, dh


def _sum_rows(at: np.ndarray, several: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers in at, and the sum of each one's rows in each of several arrays."""
    order = np.argsort(at.astype(np.int16) if at.max(initial=0) < 1 << 15 else at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first], np.stack([np.add.reduceat(x[order], first) for x in several])


def gradients(m: dict, v: Vocabulary, target: np.ndarray, before: np.ndarray, valid: np.ndarray, carry: np.ndarray, h: np.ndarray):
    """(mean log probability, gradients of its negative, inputs that `wx` has gradients of,
    last state) of one window whose lanes start from the states h."""
    out, last, (z, r, n, gn, p) = _states(m, before, carry, h, keep=True)
    grad = {k: np.zeros_like(x) for k, x in m.items() if k != "wx"}
    if valid.all():
        got, d = log_probs(m, v, out.reshape(-1, HIDDEN), target.ravel(), grad)
        dh_all = d.reshape(out.shape)
    else:
        got, d = log_probs(m, v, out[valid], target[valid], grad)
        dh_all = np.zeros_like(out)
        dh_all[valid] = d
    # what the chain rule multiplies a state's gradient by, for all steps at once
    into_z, into_r, into_n, free = 1 - z, 1 - r, n * n, p - n
    np.subtract(1, into_n, out=into_n)
    into_n *= into_z
    into_z *= z
    into_z *= free
    into_z *= 2
    into_r *= r
    into_r *= gn
    into_r *= 2
    dz, dr, dn, dg = np.empty((4, *out.shape), np.float32)
    uz, ur, un = (np.ascontiguousarray(m["u"][g].T) for g in range(3))
    dh = np.zeros_like(h)
    for t in range(len(out) - 1, -1, -1):
        dh += dh_all[t]
        np.multiply(dh, into_n[t], out=dn[t])
        np.multiply(dh, into_z[t], out=dz[t])
        np.multiply(dn[t], into_r[t], out=dr[t])
        np.multiply(dn[t], r[t], out=dg[t])
        dh *= z[t]
        dh += dz[t] @ uz
        dh += dr[t] @ ur
        dh += dg[t] @ un
        dh *= carry[t][:, None]
    flat = [x.reshape(-1, HIDDEN) for x in (dz, dr, dn)]
    used, grad["wx"] = _sum_rows(before.ravel(), flat)
    q = p.reshape(-1, HIDDEN).T
    for g, (x, y) in enumerate(zip(flat, (*flat[:2], dg.reshape(-1, HIDDEN)), strict=True)):
        grad["b"][g] = x.sum(axis=0)
        grad["u"][g] = q @ y
    return float(got.mean()), grad, used, last


def train(m: dict, v: Vocabulary, ids: np.ndarray, rows: np.ndarray, rate: float, width: int = WIDTH, window: int = 24, steps_: int = 48) -> dict:
    """One pass of truncated back-propagation over every token, with Adam steps; returns the
    new parameters. Documents longer than a lane's share are cut, so that lanes end together;
    few tokens go in fewer lanes, so that there are `steps_` steps at least."""
    m = {k: x.copy() for k, x in m.items()}
    one = {k: np.zeros_like(x) for k, x in m.items()}
    two = {k: np.zeros_like(x) for k, x in m.items()}
    width = max(1, min(width, len(ids) // (window * steps_)))
    side = Lanes(ids, rows, width, v.start, max(window, -(-len(ids) // width)))
    h, step = np.zeros((len(side.size), HIDDEN), np.float32), 0
    for _, valid, target, before, carry in side.windows(window):
        _, grad, used, h = gradients(m, v, target, before, valid, carry, h[: valid.shape[1]])
        step += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        size, low = np.float32(rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)), np.float32(1e-8)
        for k, g in grad.items():
            at = (slice(None), used) if k == "wx" else slice(None)
            a, b = one[k][at], two[k][at]
            g *= np.float32(0.1) * scale
            a *= np.float32(0.9)
            a += g
            g *= g  # 0.01 times the square
            b *= np.float32(0.99)
            b += g
            if k == "wx":
                one[k][at], two[k][at] = a, b
            by = np.sqrt(b)
            by += low
            np.divide(a, by, out=by)
            by *= size
            m[k][at] -= by
    return m


def score_ids(m: dict, v: Vocabulary, ids: np.ndarray, rows: np.ndarray, width: int = WIDTH, window: int = 32) -> np.ndarray:
    """log10 probability of each document's sequence of head words and bands."""
    n = len(rows) - 1
    if not n or not v.k:
        return np.zeros(n)
    side = Lanes(ids, rows, width, v.start)
    out = np.zeros(len(ids), np.float32)
    h = np.zeros((len(side.size), HIDDEN), np.float32)
    for token, valid, target, before, carry in side.windows(window):
        states, h, _ = _states(m, before, carry, h[: valid.shape[1]])
        if valid.all():
            out[token.ravel()] = log_probs(m, v, states.reshape(-1, HIDDEN), target.ravel())[0]
        else:
            out[token[valid]] = log_probs(m, v, states[valid], target[valid])[0]
    return np.add.reduceat(out, rows[:-1], dtype=np.float64) / LN10


def _pack(m: dict) -> np.ndarray:
    return np.concatenate([m[k].ravel() for k in sorted(m)])


def _unpack(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = flat[at : at + n].reshape(like[k].shape).astype(np.float32)
        at += n
    return out


def _mean_of(table: pa.Table) -> pa.Table:
    """The weighted mean of one piece of the parameters."""
    w = table.column("w").to_numpy()
    x = np.zeros(len(table.column("x")[0].as_py()) // 4)
    for b, k in zip(table.column("x"), w, strict=True):
        x += np.frombuffer(b.as_py(), np.float32) * (k / w.sum())
    return pa.table({"i": table.column("i")[:1], "x": pa.array([x.astype(np.float32).tobytes()], pa.binary()), "w": pa.array([float(w.sum())])})


def fit(texts: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> dict:
    """Train on all rows of texts (doc_id, text), each of them once: a round takes the next of `rounds` shares of the
    documents, its parts of about PART_TOKENS tokens run apart, and the token-weighted mean of
    their parameters starts the next round."""
    spark = texts.sparkSession
    m = new_model(v)
    if not v.k:
        return m
    vocab = spark.sparkContext.broadcast(v)
    parts = max(1, round(v.total / rounds / PART_TOKENS))
    # a task trains its parts one after another and hands on their sum, in pieces
    tasks = min(parts, 2 * spark.sparkContext.defaultParallelism)
    few = max(1, int(np.sqrt(tasks)))

    def number(batches):
        w = vocab.value
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            out = []
            for a, b in steps(offsets):
                h, rows = tokens_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = w.number[w.find(h)]
                out += [ids[rows[i] : rows[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    share = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(rounds))
    for k in range(rounds):
        shared, rate = spark.sparkContext.broadcast(m), RATE * 0.6**k
        dealt = texts.select("text").where(share == k).mapInArrow(trimmed(number), "ids binary")
        dealt = dealt.select("ids", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int").alias("part"))
        dealt = dealt.repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part")

        def run(batches, shared=shared, rate=rate):
            def trained(docs):
                docs.sort(key=lambda x: (len(x), x.tobytes()))
                rows = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
                return _pack(train(shared.value, vocab.value, np.concatenate(docs), rows, rate)).astype(np.float64) * rows[-1], int(rows[-1])

            total, weight, docs, part, first = 0.0, 0, [], None, 0
            for b in batches:
                for x, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if at != part and docs:
                        got, n = trained(docs)
                        total, weight, docs = total + got, weight + n, []
                    part = at
                    docs.append(np.frombuffer(x, np.int32))
            if docs:
                got, n = trained(docs)
                total, weight = total + got, weight + n
                first = part % tasks % few
                for i, a in enumerate(range(0, len(total), PIECE)):
                    x = (total[a : a + PIECE] / weight).astype(np.float32).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([first], pa.int32()), pa.array([x], pa.binary()), pa.array([float(weight)])], ["i", "g", "x", "w"])

        # means of groups of tasks, then of groups: no task gets a row of every other one
        mean = dealt.mapInArrow(trimmed(run), "i int, g int, x binary, w double")
        mean = mean.groupBy("i", "g").applyInArrow(_mean_of, "i int, x binary, w double")
        got = mean.groupBy("i").applyInArrow(_mean_of, "i int, x binary, w double").collect()
        if got:
            m = _unpack(np.concatenate([np.frombuffer(r["x"], np.float32) for r in sorted(got, key=lambda r: r["i"])]), m)
        shared.unpersist()
    return m


def score_documents(documents: DataFrame, fold_of: tuple[int, int] = (5, 1), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Null texts are empty: one token, the end. A null doc_id is not held out, so its row
    trains. Repeated ids and rows: each row is a document. No training rows: every count is
    zero, base_score and score are sums of log10(1). Empty table: no rows.
    """
    spark = documents.sparkSession
    kind = documents.schema[doc_id].dataType.simpleString()
    parts, held = fold_of
    d = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    train_rows = d.where(~in_fold("doc_id", parts, held))
    counts = materialize(token_counts(train_rows), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the smallest count such that at most NEAR words have it, from a histogram of counts
    level = F.floor(F.log2(F.col("c").cast("double")) * 16)
    seen, least = 0, None
    for r in counts.groupBy(level.alias("s")).agg(F.count("*").alias("k")).orderBy(F.desc("s")).collect():
        seen += r["k"]
        if seen > NEAR:
            break
        least = r["s"]
    near = counts.where(level >= least).toPandas() if least is not None else counts.orderBy(F.desc("c"), "h").limit(NEAR).toPandas()
    near = near.sort_values(["c", "h"], ascending=[False, True])
    near_h = near["h"].to_numpy(np.int64).view(np.uint64)
    v = Vocabulary(near_h, near["c"].to_numpy(), near_h[: round(HEAD_ROOT * np.sqrt(distinct))], int(total), int(distinct), BANDS)
    model = fit(train_rows, v)
    shared = spark.sparkContext.broadcast((v, model))

    def run(batches):
        from pyspark import TaskContext

        w, m = shared.value
        rid = TaskContext.get().partitionId() << 33
        held, size = [], 0

        def scored():
            """Rows of all held documents, then one of each of their words that are not near."""
            nonlocal rid
            docs, ids, n, known, logs, tails, others, row, far = zip(*held, strict=True)
            n = np.concatenate(n)
            net = score_ids(m, w, np.concatenate(ids), np.concatenate([[0], np.cumsum(n)]))
            key = rid + np.arange(len(n))
            ids_ = pa.concat_arrays([x for d in docs for x in (d.chunks if isinstance(d, pa.ChunkedArray) else [d])])
            yield pa.RecordBatch.from_arrays([
                pa.array(key), pa.nulls(len(n), pa.int64()), ids_, pa.array(n), pa.array(np.concatenate(known)), pa.array(np.concatenate(logs)),
                pa.array(net + np.concatenate(tails)), pa.array(np.concatenate(others)),
            ], names)
            base = np.cumsum([0] + [len(x) for x in known])
            r, x = np.concatenate([a + b for a, b in zip(row, base, strict=False)]), np.concatenate(far)
            for a in range(0, len(r), 1 << 18):
                k = len(r[a : a + (1 << 18)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(key[r[a : a + k]]), pa.array(x[a : a + k].view(np.int64)), pa.nulls(k, ids_.type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()),
                    pa.nulls(k, pa.float64()), pa.nulls(k, pa.int64()),
                ], names)
            rid += len(n)

        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in steps(offsets):
                h, rows = tokens_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = w.find(h)
                row = np.repeat(np.arange(b - a), np.diff(rows))
                far = at == len(w.h)
                held.append((
                    batch.column(0).slice(a, b - a), w.number[at], np.diff(rows), np.bincount(row[~far], minlength=b - a), np.bincount(row, w.log_c[at], b - a),
                    np.bincount(row, w.log_share[at], b - a), np.bincount(row[far], minlength=b - a), row[far], h[far],
                ))
                size += len(h)
                if size > SCORED:
                    yield from scored()
                    held, size = [], 0
        if held:
            yield from scored()

    names = ["rid", "h", "doc_id", "n_tokens", "near", "log_c", "net", "others"]
    out = materialize(d.mapInArrow(trimmed(run), f"rid long, h long, doc_id {kind}, n_tokens long, near long, log_c double, net double, others long"), "lm-scores")
    far = out.where("h is not null").select("rid", "h").join(counts, "h", "left")
    far = far.groupBy("rid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("far_log"), F.count("c").alias("far_known"))
    docs = out.where("h is null").drop("h").join(far, "rid", "left").fillna({"far_log": 0.0, "far_known": 0})
    base = float(np.log10(total + 0.5 * (distinct + 1)))
    tail = float(np.log10(v.other_mass))
    return docs.select(
        "doc_id", in_fold("doc_id", parts, held).alias("held_out"), "n_tokens",
        (F.col("near") + F.col("far_known")).alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("log_c") + F.col("far_log") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("net") + F.col("far_log") - F.col("others") * F.lit(tail)).alias("score"),
    )
