from collections import defaultdict

import numpy as np

from helpers import docs_of, rows, words
from tallyforge.llm import mixing


def brute_targets(size, weights=(5, 2, 1), most=3):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        left = total - sum(most * size[s] for s in full)
        weight = sum(w[s] for s in order if s not in full)
        t = {s: most * size[s] if s in full else left * w[s] / weight for s in order}
        over = {s for s in order if s not in full and t[s] > most * size[s] * (1 + 1e-12)}
        if not over:
            return t
        full |= over


def check(texts, sources, got):
    size = defaultdict(int)
    for t, s in zip(texts, sources):
        size[s] += len(words(t))
    want, taken, largest = brute_targets(size), defaultdict(int), defaultdict(int)
    assert len(got) == len(texts)
    for r in got:
        n = len(words(texts[r["doc_id"]]))
        s = sources[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["taken"] == r["copies"] * n <= 3 * n
        taken[s] += r["taken"]
        largest[s] = max(largest[s], n)
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6, s


def test_sources_near_targets(spark):
    g = np.random.default_rng(5)
    sources = [None if x == 0 else f"s{x}" for x in np.minimum(g.geometric(0.4, 700) - 1, 6)]
    texts = [None if x == 7 else "w " * int(x) for x in g.integers(0, 90, 700)]
    df = docs_of(spark, texts, sources)
    a = mixing.mix(df, group=16).collect()
    check(texts, sources, a)
    b = mixing.mix(df.repartition(5), group=16).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in a) == sorted((r["doc_id"], r["taken"]) for r in b)


def test_on_documents(spark, sf):
    x = rows(sf, "documents")
    texts, sources = {r["doc_id"]: r["text"] for r in x}, {r["doc_id"]: r["source"] for r in x}
    ids = sorted(texts)
    check([texts[i] for i in ids], [sources[i] for i in ids], mixing.mix(docs_of(spark, [texts[i] for i in ids], [sources[i] for i in ids])).collect())


def test_pivotal_keeps_mass_and_expectation():
    p, w = np.array([0.3, 0.7, 0.5, 0.2, 0.9]), np.array([3, 5, 2, 7, 4])
    mean = np.zeros(5)
    for s in range(4000):
        got = mixing.pivotal(p, w, np.random.default_rng(s))
        assert abs((got * w).sum() - (p * w).sum()) < 1e-9 and ((got > 0) & (got < 1)).sum() <= 1
        mean += got / 4000
    assert np.abs(mean - p).max() < 0.03


def test_empty_and_all_null(spark):
    df = docs_of(spark, ["a"])
    assert mixing.mix(df.where("false")).count() == 0
    got = mixing.mix(docs_of(spark, [None, ""], [None, "a"])).collect()
    assert [r["taken"] for r in got] == [0, 0]


def test_null_and_repeated_ids_ties_and_other_columns(spark):
    data = [(1, "a b c", "x")] * 3000 + [(None, "d e", "x")] * 40 + [(2, "w " * 5000, "y"), (2, "v", None), (None, None, None)] + [(3, "t t", "z")] * 900
    df = spark.createDataFrame(data, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as _nth", "3 as bucket", "4 as `p.q`", "5 as target")
    got = mixing.mix(df, group=64).collect()
    assert len(got) == len(data)
    size = defaultdict(int)
    for _, t, s in data:
        size[s] += len(words(t))
    want, taken, largest = brute_targets(size), defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in size)
    again = mixing.mix(df.repartition(7), group=64).collect()
    key = lambda r: (r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_targets_are_exact_where_several_rounds_fill_sources(spark):
    sources = ["a"] * 1 + ["b"] * 3 + ["c"] * 60 + ["d"] * 4 + ["e"] * 400
    texts = ["w " * (k % 5 + 1) for k in range(len(sources))]
    check(texts, sources, mixing.mix(docs_of(spark, texts, sources)).collect())
