import random

import numpy as np
import pytest

from helpers import DOC_SCHEMA, HARD, docs_of, rows, words
from tallyforge.llm import substring_dedup as s
from tallyforge.llm.fm_index import FMIndex


def brute(items, n):
    first = {}
    for d, t in items:
        w = words(t)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in items:
        w, gone = words(t), set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def test_backward_search_matches_brute_force():
    r = np.random.default_rng(1)
    for depth in (1, 3, 5, 13):
        text = r.integers(0, 4, 300)
        fm = FMIndex(text, depth)
        ends = np.arange(1, 301)
        lo, hi, size = fm.search(text, ends)
        for e, a, z, n in zip(ends, lo, hi, size):
            want = next((k for k in range(min(depth, e), 0, -1) if (text[e - k : e] > 0).all()), 0)
            while want and not (text[e - want : e] > 0).all():
                want -= 1
            run = 0
            while run < min(depth, e) and text[e - 1 - run] > 0:
                run += 1
            assert n == run
            if n:
                p = text[e - n : e]
                assert sorted(fm.order[a:z]) == [i for i in range(301 - n) if (text[i : i + n] == p).all()]


@pytest.mark.parametrize("n", [5, 13])
def test_matches_brute_force(spark, n):
    r = random.Random(n)
    bits = [[f"w{r.randrange(40)}" for _ in range(r.randrange(3, 60))] for _ in range(25)]
    texts = HARD + [" ".join(x for _ in range(r.randrange(1, 7)) for x in r.choice(bits)) for _ in range(120)]
    texts += texts[30:40]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in s.dedup(docs_of(spark, texts), n).collect())
    assert got == brute(list(enumerate(texts)), n)


def test_documents_spans_and_ids(spark, sf):
    x = [(r["doc_id"], r["text"]) for r in rows(sf, "documents")]
    df = spark.createDataFrame([(d, t, "", "", 0) for d, t in reversed(x)], DOC_SCHEMA)
    got = s.dedup(df).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == brute(x, 13)
    assert all(sum(p["words"] for p in r["spans"]) == r["n_removed"] for r in got)
    long = " ".join(f"x{k}" for k in range(30))
    same = spark.createDataFrame([(5, long, "", "", 0), (5, long + " y", "", "", 0), (None, long + " z", "", "", 0)], DOC_SCHEMA)
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in s.dedup(same).collect()) == [(0, 0), (5, 30), (5, 30)]
    assert s.dedup(same.where("false")).count() == 0
