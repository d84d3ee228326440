"""HyperMinHash against all pairs of sets, and its parts against plain forms."""

import random

import numpy as np
import pytest
from helpers import DOC_SCHEMA, HARD, docs_of, words

from tallyforge.llm import hyperminhash as H


def grams(text, n=5):
    w = ["".join(c.lower() if c.isascii() else c for c in x) for x in words(text)]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, t100=85):
    """doc_id, n_shingles, component_id, kept by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= t100 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((k, len(s), least.get(root(i)) if s else k, k == (least.get(root(i)) if s else k)) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOC_SCHEMA)
    out, _ = H.dedup(df, **kw)
    return sorted(map(tuple, out.drop("node").collect()), key=str)


def sentence(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def edited(rng, w, k):
    w = list(w)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
    return w


def test_random_near_copies(spark):
    rng = random.Random(1)
    texts = []
    for size in (4, 8, 20, 60, 150, 400, 1500):
        for _ in range(8):
            base = sentence(rng, size)
            texts += [base] + [edited(rng, base, k) for k in range(0, max(2, size // 40))]
    rng.shuffle(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    assert got(spark, rows) == brute(rows)


def test_chain_and_groups_of_copies(spark):
    """Documents that link only by way of others, and copies by the hundred."""
    rng = random.Random(2)
    chain = [sentence(rng, 200)]
    for _ in range(30):
        chain.append(edited(rng, chain[-1], 2))
    base = sentence(rng, 120)
    rows = [(k, " ".join(t)) for k, t in enumerate(chain + [base] * 200 + [edited(rng, base, 1) for _ in range(200)])]
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_passage_that_all_share(spark):
    """A long shared passage fills bands of unlike documents."""
    rng = random.Random(3)
    common = sentence(rng, 150)
    rows = [(k, " ".join(common + sentence(rng, 40))) for k in range(60)] + [(100 + k, " ".join(common + edited(rng, ["q"] * 40, k % 3))) for k in range(12)]
    assert got(spark, rows) == brute(rows)


def test_hard_texts_nulls_and_repeated_ids(spark):
    rows = [(k, t) for k, t in enumerate(HARD)] + [(None, "same text here"), (3, "a b c d e f g h i j"), (None, None), (5, "y " * 200000)]
    assert got(spark, rows) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    assert H.dedup(spark.createDataFrame([], DOC_SCHEMA))[0].collect() == []
    df = docs_of(spark, ["a b c d e f", "a b c d e f"]).selectExpr("*", "1 AS node", "'z' AS regs", "2 AS n")
    assert [r["component_id"] for r in H.dedup(df)[0].orderBy("doc_id").collect()] == [0, 0]


def test_registers_are_least_hashes_compressed():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    first = np.array([0, 3, 3, 700, 5000])
    m = H.registers(h, first)
    assert not m[1].any() and (m[0] != 0).sum() <= 3
    x = H._text.mix(h ^ np.uint64(0x2545F4914F6CDD1D))
    for row, (a, z) in enumerate(zip(first[:-1], first[1:], strict=True)):
        for bucket in range(H.BUCKETS):
            own = [int(v) >> 8 for v in x[a:z] if int(v) % H.BUCKETS == bucket]
            if own:
                bits = f"{min(own):056b}"
                one = bits.index("1")
                assert m[row, bucket] == ((one + 1) << 10) + int((bits[one + 1 :] + "0" * 10)[:10], 2)
            else:
                assert m[row, bucket] == 0


@pytest.mark.parametrize("j", [0.0, 0.3, 0.7, 0.9])
def test_estimate_is_unbiased(j):
    """Unlike sets get about 0 (without the correction 0.0002 for each of some thousand pairs), others about their Jaccard."""
    rng = np.random.default_rng(5)
    n, seen = 3000, []
    for _ in range(60):
        both = rng.integers(0, 1 << 63, int(n * j)).astype(np.uint64)
        own = rng.integers(0, 1 << 63, 2 * (n - len(both))).astype(np.uint64).reshape(2, -1)
        x, y = (H.registers(np.concatenate([both, o]), np.array([0, n]))[0] for o in own)
        true = len(both) / (2 * n - len(both))
        est, used = H.estimate(x, y, np.array(n), np.array(n))
        seen.append(float(est) - true)
        assert abs(seen[-1]) < 6 * (true * (1 - true) / used) ** 0.5 + 0.02
    assert abs(np.mean(seen)) < 0.012


def test_bands_meet_at_the_threshold():
    """Pairs of Jaccard 0.85 to 0.87 of many sizes meet in a band, and their estimates pass."""
    rng = np.random.default_rng(6)
    for n in [7, 13, 14, 20, 40, 100, 300, 1000, 5000] * 30:
        u = rng.integers(0, 1 << 63, n).astype(np.uint64)
        d = int(n * 0.15)
        x, y = (H.registers(s, np.array([0, len(s)])) for s in (u[: n - d // 2], u[d - d // 2 :]))
        kx, ky = (set(H.bands(m)[0].tolist()) for m in (x, y))
        assert kx & ky, n
        assert H.may_link(x[0], y[0], np.array(n - d // 2), np.array(n - d + d // 2), 0.85)[0], n


def test_registered_query_is_the_whole_table(spark, sf):
    from helpers import rows

    from tallyforge.llm.queries import QUERIES

    out = sorted(map(tuple, QUERIES["op11_hyperminhash"](spark, sf).collect()), key=str)
    assert out == brute([(r["doc_id"], r["text"]) for r in rows(sf, "documents")])
