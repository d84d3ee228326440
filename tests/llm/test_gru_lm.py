import math
import zlib
from collections import Counter

import numpy as np

from helpers import HARD, docs_of, rows, words
from tallyforge.llm import gru_lm as g


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def base(texts):
    tokens = [words(lower(t)) + ["\0end"] for t in texts]
    held = [zlib.crc32(str(k).encode()) % 5 == 1 for k in range(len(texts))]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for t, h in zip(tokens, held)]


def test_base_and_held_out_gain(spark):
    texts = HARD + [r["text"] for r in sorted(rows("/root/testdata/sf0.01", "documents"), key=lambda r: r["doc_id"])]
    df, _ = g.lm_score(docs_of(spark, texts))
    got = {r["doc_id"]: r for r in df.collect()}
    want = base(texts)
    assert len(got) == len(texts)
    for k, w in enumerate(want):
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert abs(r["base_score"] - w[4]) < 1e-6 * max(1, abs(w[4])) and r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    n = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] for r in held) / n > sum(r["base_score"] for r in held) / n + 0.3


def test_gradients():
    cls = np.concatenate([np.arange(g.TAILS), g.TAILS + np.arange(12) // 4])
    prior = np.full(len(cls), 1 / len(cls))
    model = g.Model(cls, prior, hidden=3)
    r = np.random.default_rng(0)
    model.us[:] = r.normal(size=model.us.shape)
    model.uc[:] = r.normal(size=model.uc.shape)
    model.use(model.flat.astype(np.float64))
    docs = [r.integers(0, len(cls), k) for k in (5, 9, 3, 1)]

    def loss(grad=None):
        total = 0.0
        for _, x, fresh, y, live in g._windows(docs, 2):
            h = np.zeros((x.shape[1], 3))
            hs, tape = model.forward(x, fresh, h)
            keep = live.ravel()
            flat = hs.reshape(-1, 3)
            lp, d = model.outputs(flat[keep], y.ravel()[keep], grad)
            if grad is not None:
                dh = np.zeros_like(flat)
                dh[keep] = d
                model.backward(x, tape, dh.reshape(hs.shape), grad)
            total -= lp.sum()
            break
        return total

    grad = np.zeros_like(model.flat)
    loss(grad)
    for k in r.integers(0, len(grad), 120):
        old = model.flat[k]
        model.flat[k] = old + 1e-5
        up = loss()
        model.flat[k] = old - 1e-5
        down = loss()
        model.flat[k] = old
        assert abs((up - down) / 2e-5 - grad[k]) < 1e-3 * max(1, abs(grad[k]))


def test_distribution_is_proper_and_state_is_carried():
    voc = g.Vocabulary(100, 10, [(5, 30), (9, 20)], np.bincount(g.tail_class([30, 20, 3, 2, 1, 1]), minlength=g.TAILS), np.bincount(g.tail_class([30, 20, 3, 2, 1, 1]), weights=[30, 20, 3, 2, 1, 1], minlength=g.TAILS).astype(int))
    model = g.Model(voc.classes(), voc.prior())
    hs = np.random.default_rng(1).normal(size=(1, model.h)).astype(np.float32)
    total = sum(np.exp(model.outputs(hs, np.array([s]), None)[0][0]) for s in range(voc.size))
    assert abs(total - 1) < 1e-5
    r = np.random.default_rng(2)
    docs = [r.integers(0, voc.size, k) for k in (100, 40, 3, 77)]
    whole = g.score(model, docs)
    assert np.allclose(whole, [g.score(model, [d])[0] for d in docs], atol=1e-3)


def test_empty(spark):
    assert g.lm_score(docs_of(spark, ["a"]).where("false"))[0].count() == 0


def test_frequent_words_are_head_words_whatever_their_number(spark):
    texts = [" ".join(f"w{k}" for k in range(2500))] * 90 + ["rare word here"] * 3
    table = docs_of(spark, texts).selectExpr("doc_id", "text", "false as held_out", "cast(doc_id % 3 as int) as bucket")
    _, voc = g.counted(table, 3, g.HEAD)
    assert len(voc.head) == 2501 and voc.head.min() == 90  # and the end
    sizes = np.bincount(voc.classes())[g.TAILS :]
    assert sizes.max() == 50 and len(sizes) == 51


def test_scores_do_not_depend_on_partitions(spark):
    texts = HARD + [r["text"] for r in rows("/root/testdata/sf0.001", "documents")]
    df = docs_of(spark, texts).selectExpr("*", "1 as bucket", "2 as symbols", "3 as held_out", "4 as `a.b`")
    one, two = ({r["doc_id"]: r["score"] for r in g.lm_score(df.repartition(k))[0].collect()} for k in (1, 7))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-3 * max(1, abs(one[k])) for k in one)


def brute_score(model, voc, docs):
    """Scores by the plain recurrence, one word after the other, over symbols (with the tail share left out)."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    n, out = model.h, []
    for d in docs:
        h, total, before = np.zeros(n), 0.0, None
        for s in d:
            a = np.zeros(3 * n) if before is None else model.w_in[before].astype(float)
            u = h @ model.rec
            z, r = sig(a[:n] + u[:n]), sig(a[n : 2 * n] + u[n : 2 * n])
            c = np.tanh(a[2 * n :] + r * (u[2 * n :] + model.b))
            h = (1 - z) * c + z * h
            k = model.cls[s]
            logit = h @ model.uc + model.bc
            total += logit[k] - np.log(np.exp(logit).sum())
            lo, hi = model.first[k], model.first[k + 1]
            own = h @ model.us[lo:hi].T + model.bs[lo:hi]
            total += own[s - lo] - np.log(np.exp(own).sum()) if k >= g.TAILS else 0.0
            before = s
        out.append(total)
    return out


def test_score_matches_the_plain_recurrence():
    voc = g.Vocabulary(300, 30, [(k, 40 - k) for k in range(12)], np.full(g.TAILS, 3), np.full(g.TAILS, 400))
    model = g.Model(voc.classes(), voc.prior())
    r = np.random.default_rng(5)
    model.us[:] = r.normal(0, 0.5, model.us.shape)
    docs = [r.integers(0, voc.size, k) for k in (1, 2, 60, 130, 7)]
    assert np.allclose(g.score(model, docs), brute_score(model, voc, docs), rtol=1e-4)


def test_words_beyond_those_with_a_symbol_of_their_own_share_symbols(spark, monkeypatch):
    texts = [" ".join(f"w{k}" for k in range(600))] * 90 + [f"often{k % 7} rare{k}" for k in range(700)]
    table = docs_of(spark, texts).selectExpr("doc_id", "text", "false as held_out", "cast(doc_id % 3 as int) as bucket")
    monkeypatch.setattr(g, "OWN", 50)
    _, voc = g.counted(table, 3, 20)
    counts = Counter(w for t in texts for w in [*words(t), "\0end"])
    assert len(voc.head) == 50 and sorted(voc.head) == sorted(sorted(counts.values())[-50:])  # 8 are more frequent
    often = sum(c >= g.LEAST for c in counts.values()) - 50
    assert voc.slots[0].sum() == often and voc.slots[1].sum() == sum(c for c in counts.values() if c >= g.LEAST) - voc.head.sum()
    assert voc.types.sum() + often + 50 == len(counts) and voc.mass.sum() + voc.slots[1].sum() + voc.head.sum() == voc.n
    assert voc.size == g.TAILS + 50 + g.SHARED == len(voc.classes()) == len(voc.prior())
    # A word is its symbol times its share of it, so the shares of all words of a symbol are 1.
    hashes = np.arange(1 << 14, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sym = voc.symbols(hashes, np.full(len(hashes), g.LEAST))
    assert (sym >= g.TAILS + 50).all() and (sym < voc.size).all() and (voc.symbols(hashes, np.full(len(hashes), 63)) < g.TAILS).all()
    assert np.allclose(10 ** voc.shares()[g.TAILS + 50 :], np.maximum(voc.slots[1] + 0.5 * voc.slots[0], 0.5))
    df, model = g.lm_score(docs_of(spark, texts), head=20)
    assert len(model.cls) == voc.size and all(r["score"] < 0 for r in df.collect()) and df.count() == len(texts)
