import random

import numpy as np
import pyarrow as pa
import pytest

from helpers import HARD, docs_of, rows, words
from tallyforge.llm import jaccard_join as j


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(texts, n=4):
    sets = []
    for t in texts:
        w = words(lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 85 * max(len(x), len(y)):
                k = len(x & y)
                if 100 * k >= 85 * (len(x) + len(y) - k):
                    p, q = root(a), root(b)
                    up[max(p, q)] = min(p, q)
    return [len(s) for s in sets], [root(k) for k in range(len(sets))]


def near(r, w, k):
    w = list(w)
    for _ in range(k):
        i = r.randrange(len(w))
        w[i : i + r.randrange(2)] = [f"n{r.random()}"][: r.randrange(2)]
    return w


def made(seed):
    r = random.Random(seed)
    texts = list(HARD)
    common = [f"c{k}" for k in range(40)]
    for g in range(14):
        base = [f"{g}w{r.randrange(300)}" for _ in range(r.choice([5, 9, 12, 20, 60, 150, 400]))]
        for _ in range(r.randrange(1, 9)):
            texts.append(" ".join(near(r, base, r.choice([0, 0, 1, 1, 2, 4, 8]))))
    for k in range(20):
        texts.append(" ".join(common + [f"x{k}y{i}" for i in range(r.randrange(5, 60))]))
        texts.append(" ".join(common[: r.randrange(8, 40)]).upper())
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    texts = made(seed)
    got = {r["doc_id"]: r for r in j.join(docs_of(spark, texts))[0].collect()}
    n, c = brute(texts)
    assert [got[k]["n_shingles"] for k in range(len(texts))] == n
    assert [got[k]["component_id"] for k in range(len(texts))] == c


def test_documents(spark):
    x = sorted(rows("/root/testdata/sf0.01", "documents"), key=lambda r: r["doc_id"])[:400]
    got = {r["doc_id"]: r["component_id"] for r in j.join(docs_of(spark, [r["text"] for r in x]))[0].collect()}
    assert [got[k] for k in range(len(x))] == brute([r["text"] for r in x])[1]


def test_pigeonhole_holds_for_every_allocation():
    r = random.Random(4)
    cost = np.random.default_rng(1).integers(0, 50, j.SKETCH)
    for band in (j.Band(5, 0, 0), j.Band(9, 0, 2), j.Band(3, 2, 0), j.Band(4, 3, 1)):
        for _ in range(150):
            u = band.m + band.double - 1 - 2 * band.skip
            base = [r.getrandbits(64) for _ in range(30)]
            k = r.randrange(u + 1)
            a, b = base[k // 2 :], base[: len(base) - (k - k // 2)]
            x = [np.array(sorted(s), np.uint64) for s in (a, b)]
            scheme = j.Scheme.__new__(j.Scheme)
            scheme.edges, scheme.bands = [1, 10_000], [band]
            key, row = j.signatures(np.concatenate(x), np.array([0, len(a), len(a) + len(b)]), scheme, cost)
            assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_empty(spark):
    assert j.join(docs_of(spark, ["a"]).where("false"))[0].count() == 0


def test_sets_of_null_ids_link(spark):
    a = [f"w{k}" for k in range(100)]
    b = a[:94] + [f"x{k}" for k in range(6)]
    c = [f"y{k}" for k in range(6)] + b[6:]
    d = [f"z{k}" for k in range(100)]
    data = [(1, a), (None, b), (3, c), (None, d), (None, [*d[:-1], "end"]), (3, d[:50])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in data], "doc_id long, text string")
    got, links = j.join(df)
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got.collect()) == [(0, 0), (0, 0), (0, 1), (1, 1), (3, 1), (3, 3)]
    assert links.count() == 3


def test_only_short_texts(spark):
    texts = ["a b c d e", "a b c d e", "b a", "", None, "x y z w v u", "a b c d"] * 3
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.join(docs_of(spark, texts))[0].collect()}
    n, c = brute(texts)
    assert [got[k] for k in range(len(texts))] == list(zip(n, c))


def test_bitmaps_never_tell_more_than_the_difference():
    g = np.random.default_rng(3)
    for n in (1, 60, 64, 65, 300, 5000):
        x = np.sort(g.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.sort(np.concatenate([x[n // 10 :], g.integers(0, 1 << 63, n // 7 + 1).astype(np.uint64)]))
        a, b = j.bitmaps(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        size = min(len(a), len(b))
        far = int(np.bitwise_count(j.folded(a, size) ^ j.folded(b, size)).sum())
        assert far <= len(np.setxor1d(x, y)) and len(a) * 8 >= 2 * n
        assert np.array_equal(j.folded(b, size), np.frombuffer(j.bitmaps(y, np.array([0, len(y)]))[0], "<u8").reshape(-1, size // 8)[0]) or len(b) > size


def test_chunked_buckets_and_repeated_rows_match_brute_force(spark, monkeypatch):
    """Chains of near copies, in chunks of three nodes; other columns; very long texts."""
    monkeypatch.setattr(j, "CHUNK", 3)
    r = random.Random(9)
    texts = []
    for g in range(4):
        base = [f"{g}v{k}" for k in range(r.choice([40, 90]))]
        for _ in range(45):
            base = near(r, base, 1) if r.random() < 0.5 else base
            texts.append(" ".join(near(r, base, r.choice([0, 1, 2, 3]))))
    long = [f"L{k}" for k in range(60_000)]
    texts += [" ".join(long), " ".join(long[3000:]), " ".join(long[9000:] + long[:50])] + texts[:20]
    df = docs_of(spark, texts).selectExpr("*", "1 as node", "2 as bits", "3 as list", "4 as `a.b`")
    got = {x["doc_id"]: x["component_id"] for x in j.join(df)[0].collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)[1]


def test_rows_of_a_shard_do_not_multiply_with_a_group(spark):
    """A group of 2000 nodes, each in most of 40 buckets: pairs are packed by their leading node, none is lost."""
    r = np.random.default_rng(5)
    node = np.arange(1, 2001) * 7919 - 4_000_000
    key, own = (np.concatenate(x) for x in zip(*((np.full(len(i), k, "<u4"), i) for k, i in ((k, np.flatnonzero(r.random(2000) < 0.9)) for k in range(40))), strict=True))
    shard = pa.table({"shard": [0], "keys": [key.tobytes()], "own": [own.astype("<u2").tobytes()], "nodes": [node.astype("<i8").tobytes()]})
    want = {}
    for k in range(40):
        lead, *others = np.sort(node[own[key == k]]).tolist()
        for b in others:
            want[lead, b] = want.get((lead, b), 0) + 1
    got = j._buckets(shard, 8)
    assert got.num_rows < 2000
    pairs = [(x["a"], x["b"], x["times"]) for x in got.to_pylist() if x["b"] is not None]
    packed = spark.createDataFrame(got.to_pandas()).where("often is not null").select("a", "piece", "nodes", "often")
    pairs += [tuple(x) for x in packed.selectExpr("cast(a as long) a", "piece", "nodes", "often").groupBy("a", "piece").applyInArrow(j._merged, "a long, b long, times long").collect()]
    assert len({(a, b) for a, b, _ in pairs}) == len(pairs) and {(a, b): n for a, b, n in pairs} == want


def test_a_group_of_near_copies_matches_brute_force(spark):
    r = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(near(r, base, r.choice([0, 1, 2, 3, 4]))) for _ in range(260)]
    got = {x["doc_id"]: x["component_id"] for x in j.join(docs_of(spark, texts))[0].collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)[1]
