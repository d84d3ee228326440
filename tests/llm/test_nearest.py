import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tallyforge.llm import nearest


def exact(ids, m, every=20, k=20):
    out = {}
    for i, q in zip(ids, m):
        if i % every == 0:
            s = m @ q
            ok = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in ok]
    return out


def test_recall_and_scores(spark):
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, m = t["vec_id"].to_numpy(), np.stack(t["embedding"].to_numpy()).astype(float)
    want = exact(ids, m)
    got = {}
    for r in nearest.search(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    at, hits = {int(i): k for k, i in enumerate(ids)}, 0
    for q, w in want.items():
        g = sorted(got[q])
        assert [x[0] for x in g] == list(range(1, 21))
        for _, i, s in g:
            assert abs(m[at[i]] @ m[at[q]] - s) < 1e-12
        assert all((a[2], -a[1]) > (b[2], -b[1]) for a, b in zip(g, g[1:]))
        hits += len({x[1] for x in g} & {x[0] for x in w})
    assert hits >= 0.95 * 20 * len(want)


def test_bad_vectors_norms_and_ties(spark):
    g = np.random.default_rng(2)
    data = [(k, (g.normal(size=8) * g.uniform(0.2, 4)).tolist(), "x") for k in range(300)]
    data += [(300 + k, [1.0] * 8, "x") for k in range(60)]
    bad = [(900, None, ""), (901, [0.0] * 8, ""), (902, [float("nan")] * 8, ""), (903, [1.0] * 7 + [None], ""), (904, [float("inf")] + [1.0] * 7, ""), (905, [1.0] * 3, ""), (None, [1.0] * 8, "")]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>, rank string")
    got = nearest.search(df, F.col("vec_id") % 20 == 0, tables=40, probes=16, chunk=16).collect()
    want = exact(np.array([d[0] for d in data]), np.array([d[1] for d in data]))
    hits = 0
    for q, w in want.items():
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        hits += len(set(mine) & {x[0] for x in w})
        if q >= 300:
            assert mine[0] == min(i for i in range(300, 360) if i != q) or w[0][0] < 300
    assert hits >= 0.97 * 20 * len(want) and not {r["vec_id"] for r in got} & set(range(900, 906))
    assert nearest.search(df.where("false"), F.lit(True)).count() == 0


def test_small_tables_give_all_candidates(spark):
    for n in (5, 15, 21, 25, 60, 200):
        m = np.random.default_rng(n).normal(size=(n, 64))
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<double>")
        got = {}
        for r in sorted(nearest.search(df, F.lit(True)).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        want = exact(np.arange(n), m, every=1)
        assert all(len(w) == min(20, n - 1) for w in want.values())
        assert all(got[q] == [i for i, _ in want[q]] for q in want if n < 22) and {len(x) for x in got.values()} == {min(20, n - 1)} and len(got) == n


def test_repeated_rows_are_candidates_and_queries_of_their_own(spark):
    data = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "1 as uid", "2 as id", "3 as v", "4 as `a.b`")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest.search(df, F.col("vec_id") == 0).collect())
    one = [(0, 1.0), (1, 1.0), (1, 1.0), (0, 0.0)]
    two = [(1, 0.1), (1, 0.1), (0, 0.0), (0, 0.0)]
    assert got == sorted((0, k + 1, i, s) for x in (one, one, two) for k, (i, s) in enumerate(x))


def test_recall_of_the_registered_settings_on_every_scale(spark):
    for sf in ("sf0.001", "sf0.01"):
        t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
        want = exact(t["vec_id"].to_numpy(), np.stack(t["embedding"].to_numpy()).astype(float))
        got = {}
        for r in nearest.search(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"), F.col("vec_id") % 20 == 0).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert all(len(got[q]) == len(w) for q, w in want.items())
        assert sum(len(got[q] & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))
