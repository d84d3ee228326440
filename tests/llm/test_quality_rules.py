import random
from collections import Counter

import numpy as np

from helpers import HARD, docs_of, rows, words
from tallyforge.llm import quality_rules as q


def brute(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    lines = [x for x in text.split("\n") if words(x)]
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit.update(range(i, i + 5))
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(hit), "n_lines": len(lines), "n_distinct": len(set(w))}


def test_statistics_match_brute_force(spark, sf):
    r = random.Random(1)
    texts = HARD + [" ".join(r.choice("ab c d\n e,".split(" ")) for _ in range(r.randrange(60))) for _ in range(60)]
    texts += [x["text"] for x in rows(sf, "documents")]
    got = {x["doc_id"]: x.asDict() for x in q.text_statistics(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert {c: got[k][c] for c in brute(t)} == brute(t), (k, t)


def test_learns_a_conjunction_and_leaves_others_alone():
    g = np.random.default_rng(3)
    x = {f: g.random(3000) for f in ("a", "b", "c")}
    bad = (x["a"] > 0.8) & (x["b"] < 0.5)
    rules = q.learn(x, bad)
    hit = np.zeros(3000, bool)
    for rule in rules.rules:
        hit |= rule.holds(x)
    assert (hit & ~bad).mean() < 0.01 and (hit & bad).sum() > 0.9 * bad.sum()


def test_held_out_accuracy(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    rules = q.fit(docs, labels.where("doc_id % 2 = 0"))
    got = q.apply_rules(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "base_failed", "quality").collect()
    good = [r for r in got if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in got if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.2 * len(bad)


def test_empty_tables(spark):
    docs = docs_of(spark, ["a"]).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = q.fit(docs, labels)
    assert rules.rules == [] and q.apply_rules(docs, rules).count() == 0
    assert q.apply_rules(docs_of(spark, ["w " * 20, "a b c d e f g h i j k l m"]), rules).where("kept").count() == 1


def test_keep_judges_by_its_own_counts_and_fit_collects_one_row_an_id(spark):
    good = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([(1, good, 3, 0, "a")], "doc_id long, text string, n_words long, _n_words long, n_symbols string")
    kept = q.keep(docs, q.DecisionList())
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, good, 3, 0, "a")]
    many = spark.range(500).selectExpr("7L AS doc_id", f"'{good}' AS text")
    assert q.fit(many, spark.createDataFrame([(7, 0)], "doc_id long, quality long")).rules == []
