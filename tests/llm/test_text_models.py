import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import gru_lm, nbsvm
from ledgerloom.llm.quality import quality_scores
from ledgerloom.llm.rules import RULES, keep_good, quality_rules
from ledgerloom.llm.toxicity import drop_toxic, toxicity_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score", [quality_scores, toxicity_scores])
def test_scores_every_row(docs, none, labels, score):
    got = score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    parts, k = (5, 0) if score is quality_scores else (4, 2)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % parts == k) for r in got)
    assert score(none, labels).count() == 0
    assert {r["score"] for r in score(docs, labels.limit(0)).collect()} == {0.5}
    one_class = {round(r["score"], 6) for r in score(docs, labels.where("quality = 1 and toxic = 0")).collect()}
    assert len(one_class) == 1


def test_learns_toxicity(spark):
    import random

    r = random.Random(1)
    words = ["word" + str(i) for i in range(300)]
    rows = []
    for i in range(400):
        t = [r.choice(words) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            t[r.randrange(60)] = "blockheaded"
            t[r.randrange(60)] = "nitwitted"
        rows.append((i, " ".join(t), int(bad)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, b) for i, _, b in rows], "doc_id long, quality int, toxic int")
    truth = {i: b for i, _, b in rows}
    held = [x for x in toxicity_scores(docs, labels).collect() if x["held_out"]]
    assert sum(x["predicted"] == truth[x["doc_id"]] for x in held) / len(held) > 0.97
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {truth[x["doc_id"]] for x in kept.collect()} == {0}


def test_dual_coordinate_descent_meets_its_conditions():
    rng = np.random.default_rng(0)
    docs = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(60)]
    y = np.array([int(3 in set(d) or rng.random() < 0.2) for d in docs])
    v = nbsvm.log_count_ratios(docs, y, 12)
    w, b = nbsvm.dual_coordinate_descent(docs, v, y, 1.0, 400, 1e-6)
    def primal(w, b):
        s = np.where(y > 0, 1, -1)
        c = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        return 0.5 * (w @ w + b * b) + sum(ci * max(0, 1 - si * (w[d] @ v[d] + b)) for d, si, ci in zip(docs, s, c, strict=True))
    best = primal(w, b)
    for _ in range(50):
        assert best <= primal(w + rng.normal(0, 0.02, 12), b + rng.normal(0, 0.02)) + 1e-4


def test_rules_against_brute_force(docs, none):
    def brute(t):
        w = WORD.findall(t or "")
        tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        at = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(at)

    got = quality_rules(docs, keep=("doc_id", "text")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert brute(r["text"]) == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and (not r["kept"] or not r["base_failed"])
    assert quality_rules(none).count() == 0 and keep_good(docs, RULES[:1]).columns == docs.columns
    loose = tuple(x for x in RULES if x.name != "stop_word_share")
    assert keep_good(docs, loose).count() == quality_rules(docs, loose).where("kept").count()


def test_language_model(docs, none):
    got = gru_lm.score_documents(docs).collect()
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    tokens = lambda t: WORD.findall((t or "").translate(low)) + [None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    rows = docs.select("doc_id", "text").collect()
    c = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6), out(i)) for i, t in rows)
    assert want == Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), r["held_out"]) for r in got)
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert gru_lm.score_documents(none).count() == 0


def test_state_crosses_windows_and_probabilities_add_up():
    h = np.arange(1, 40, dtype=np.uint64)
    v = gru_lm.Vocabulary(h, np.arange(40, 1, -1), h[:20], 900, 39)
    m = gru_lm.new_model(v)
    rng = np.random.default_rng(0)
    m["u"] += rng.normal(0, 0.3, m["u"].shape).astype(np.float32)
    m["wx"] += rng.normal(0, 1, m["wx"].shape).astype(np.float32)
    m["wc"] += rng.normal(0, 1, m["wc"].shape).astype(np.float32)
    ids, rows = rng.integers(0, 21, 200).astype(np.int16), np.array([0, 90, 91, 200])
    a = gru_lm.score_ids(m, v, ids, rows, window=200)
    b = gru_lm.score_ids(m, v, ids, rows, window=7)
    c = np.concatenate([gru_lm.score_ids(m, v, ids[s:e], np.array([0, e - s])) for s, e in zip(rows[:-1], rows[1:], strict=True)])
    assert a == pytest.approx(b, abs=1e-4) and a == pytest.approx(c, abs=1e-4)
    state = rng.normal(0, 1, (1, gru_lm.HIDDEN)).astype(np.float32)
    p = [float(np.exp(gru_lm.log_probs(m, v, state, np.array([k], np.int16))[0][0])) for k in range(21)]
    assert sum(p) == pytest.approx(1, abs=1e-4)


def test_gradients():
    h = np.arange(1, 12, dtype=np.uint64)
    v = gru_lm.Vocabulary(h, np.arange(12, 1, -1), h[:8], 100, 11)
    m = gru_lm.new_model(v)
    ids, rows = np.array([0, 3, 8, 2, 1, 5, 0, 4], np.int16), np.array([0, 8])
    def loss(m):
        return -gru_lm.score_ids(m, v, ids, rows)[0] * gru_lm.LN10
    before = loss(m)
    for _ in range(30):
        m = gru_lm.train(m, v, ids, rows, 0.02)
    assert loss(m) < before - 1


def test_trains_on_every_training_document(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(gru_lm, "fit", lambda texts, v: seen.append(texts.count()) or gru_lm.new_model(v))
    df = spark.range(1200).selectExpr("id as doc_id", "concat('word w', id) as text")
    gru_lm.score_documents(df)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(1200))]


def test_trains_to_the_end_of_the_longest_document(monkeypatch):
    h = np.arange(1, 12, dtype=np.uint64)
    v = gru_lm.Vocabulary(h, np.arange(12, 1, -1), h[:8], 100, 11)
    lengths = np.array([700] + [9] * 60)
    rows = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.random.default_rng(0).integers(0, 9, rows[-1]).astype(np.int16)
    used, log_probs = [], gru_lm.log_probs
    monkeypatch.setattr(gru_lm, "log_probs", lambda m, v, h, target, grad=None: used.append(target) or log_probs(m, v, h, target, grad))
    gru_lm.train(gru_lm.new_model(v), v, ids, rows, 0.02)
    assert Counter(np.concatenate(used).tolist()) == Counter(ids.tolist())


def test_vocabulary_grows_and_bands_add_up(spark, monkeypatch):
    got = []
    monkeypatch.setattr(gru_lm, "fit", lambda texts, v: got.append(v) or gru_lm.new_model(v))
    df = spark.range(1000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 99), k -> concat('w', (id * 100 + k) % 40000))) as text")
    gru_lm.score_documents(df)
    v = got[0]
    assert v.k == round(gru_lm.HEAD_ROOT * math.sqrt(v.distinct)) > 512
    counts = np.concatenate([np.arange(60, 20, -1), np.repeat([20, 9, 8, 3, 1], 12)])
    h = np.arange(1, len(counts) + 1, dtype=np.uint64)
    v = gru_lm.Vocabulary(h, counts, h[:15], int(counts.sum()) + 30, len(h) + 6, gru_lm.BANDS)  # six words of thirty tokens are not near
    assert set(v.number.tolist()) == set(range(v.start))
    state = np.random.default_rng(0).normal(0, 1, (1, gru_lm.HIDDEN)).astype(np.float32)
    p = [float(np.exp(gru_lm.log_probs(gru_lm.new_model(v), v, state, v.number[[i]])[0][0])) * 10 ** v.log_share[i] for i in range(len(h))]
    last = float(np.exp(gru_lm.log_probs(gru_lm.new_model(v), v, state, np.array([v.start - 1]))[0][0]))
    assert sum(p) + last * (30 + 0.5 * 7) / v.other_mass == pytest.approx(1, abs=1e-4)


def small_model(seed=0):
    """A model with nothing near zero, in double precision, and its vocabulary."""
    h = np.arange(1, 40, dtype=np.uint64)
    v = gru_lm.Vocabulary(h, np.arange(41, 2, -1), h[:20], 900, 39, gru_lm.BANDS)
    rng = np.random.default_rng(seed)
    return {k: x.astype(np.float64) + rng.normal(0, 0.3, x.shape) for k, x in gru_lm.new_model(v).items()}, v


def naive_log10(m, v, ids):
    """One document, one token at a time, from the definition."""
    sigmoid = lambda x: 1 / (1 + np.exp(-2 * x))  # noqa: E731  (1 + tanh x) / 2
    softmax = lambda x: np.exp(x) / np.exp(x).sum()
    h, x, total = np.zeros(gru_lm.HIDDEN), v.start, 0.0
    for y in ids:
        a = [m["wx"][g, x] + m["b"][g] for g in range(3)]
        z, r = (sigmoid(a[g] + h @ m["u"][g]) for g in (0, 1))
        n = np.tanh(a[2] + r * (h @ m["u"][2]))
        h = z * h + (1 - z) * n
        c = v.of[y] if y < v.k else v.classes + y - v.k
        p = softmax(h @ m["wc"] + m["bc"])[c]
        if y < v.k:
            first, last = v.first[c], v.first[c + 1]
            p *= softmax(m["ww"][first:last] @ h + m["bw"][first:last])[y - first]
        total, x = total + np.log10(p), y
    return total


def test_scores_are_those_of_a_naive_forward_pass():
    m, v = small_model()
    rng = np.random.default_rng(1)
    rows = np.array([0, 70, 71, 75, 140])
    ids = rng.integers(0, v.start, rows[-1]).astype(np.int32)
    m32 = {k: x.astype(np.float32) for k, x in m.items()}
    got = gru_lm.score_ids(m32, v, ids, rows, width=3, window=8)
    assert got == pytest.approx([naive_log10(m, v, ids[a:b]) for a, b in zip(rows, rows[1:], strict=False)], rel=1e-4)


def test_gradients_are_those_of_finite_differences():
    m, v = small_model(2)
    rng = np.random.default_rng(3)
    ids, rows = rng.integers(0, v.start, 60).astype(np.int32), np.array([0, 20, 27, 60])
    side = gru_lm.Lanes(ids, rows, 2, v.start, 25)
    _, valid, target, before, carry = next(side.windows(40))
    h = rng.normal(0, 0.5, (valid.shape[1], gru_lm.HIDDEN)).astype(np.float32)
    m32 = {k: x.astype(np.float32) for k, x in m.items()}
    mean, grad, used, _ = gru_lm.gradients(m32, v, target, before, valid, carry, h)
    # a gradient's length along random directions, and along single parameters
    def loss(m):
        out, _, _ = gru_lm._states(m, before, carry, h)
        return -float(gru_lm.log_probs(m, v, out[valid], target[valid])[0].astype(np.float64).mean())

    assert loss(m32) == pytest.approx(-mean, rel=1e-5)
    for k in m:
        full = np.zeros_like(m32[k])
        full[(slice(None), used) if k == "wx" else slice(None)] = grad[k]
        assert np.abs(full).max() > 1e-5
        way = full / np.sqrt((full * full).sum())
        e = 0.05
        up, down = ({**m32, k: m32[k] + np.float32(s * e) * way} for s in (1, -1))
        assert (loss(up) - loss(down)) / (2 * e) == pytest.approx(np.sqrt((full * full).sum()), rel=0.03), k


def brute_ngrams(t, orders):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    return {t[i : i + k] for k in orders for i in range(len(t) - k + 1)}


def test_character_ngrams_are_of_characters(monkeypatch):
    """As many different features as different n-grams of characters, in parts or whole."""
    rng = np.random.default_rng(0)
    texts = ["", "Aé", "naïve Café 3€ 😀 ends", "".join(rng.choice(list("abÉé€😀 \n"), 400))]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    raw = np.frombuffer(b"".join(data), np.uint8)
    rows, feats = nbsvm.char_ngrams(raw, offsets, (2, 4), bits=32)
    for i, t in enumerate(texts):
        assert len(set(feats[rows == i].tolist())) == len(brute_ngrams(t, (2, 4)))
    whole = {x for _, pairs in nbsvm._distinct(nbsvm.char_ngrams, raw, offsets) for x in pairs.tolist()}
    monkeypatch.setattr(nbsvm, "STEP", 64)
    parts = {(a << 32) + x for (a, _), pairs in nbsvm._distinct(nbsvm.char_ngrams, raw, offsets) for x in pairs.tolist()}
    assert parts == whole


def test_many_short_texts_take_little_memory():
    import tracemalloc

    k = 6000
    slots = np.full(1 << nbsvm.BITS, -1, np.int16)
    slots[:k] = np.arange(k)
    m = nbsvm.Model(nbsvm.char_ngrams, slots, np.ones(k), 0.25, 1.0, 0.0)
    raw = np.frombuffer(b"0123456789" * 10_000, np.uint8)
    tracemalloc.start()
    got = m.decision(raw, np.arange(0, len(raw) + 1, 10))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(got.tolist())) == 1 and peak < 60e6


@pytest.mark.parametrize("score, column", [(quality_scores, "quality"), (toxicity_scores, "toxic")])
def test_held_out_accuracy_of_planted_classes(spark, score, column):
    """Class 1 marked by form (quality) or by wording (toxicity), in a fold that never trains."""
    import random

    r = random.Random(4)
    rows = []
    for i in range(500):
        y = i % 3 == 0
        words = [r.choice("river stone cloud walks under green silent houses".split()) for _ in range(50)]
        if y and column == "toxic":
            words[r.randrange(50)] = "blockheaded"
        if y != (column == "quality") and column == "quality":
            words = [w.upper() + "!!" if k % 3 == 0 else w for k, w in enumerate(words)]
        rows.append((i, " ".join(words), int(y)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    truth = {i: y for i, _, y in rows}
    held = [x for x in score(docs, labels).collect() if x["held_out"]]
    assert len(held) > 50 and sum(x["predicted"] == truth[x["doc_id"]] for x in held) >= 0.97 * len(held)
