import random

import pytest

from helpers import DOC_SCHEMA, HARD, docs_of, words
from tallyforge.llm import line_dedup


def brute(texts, n, min_words=None):
    seen, out = set(), []
    runs = []
    for d, t in enumerate(texts):
        raw = (t or "").split("\n")
        at = [i for i, x in enumerate(raw) if x.strip(" \t\n\r\x0b\f")]
        runs.append((raw, at))
    for raw, at in runs:
        gone = set()
        for size in [n] if min_words is None else [n, 1]:
            for k in range(len(at) - size + 1):
                w = tuple(raw[at[k + j]] for j in range(size))
                if size == n or len(words(w[0])) >= min_words:
                    if w in seen:
                        gone.update(at[k : k + size])
                    seen.add(w)
        out.append((len(at), len(gone), "\n".join(x for i, x in enumerate(raw) if i not in gone)))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_matches_brute_force(spark, n):
    r = random.Random(n)
    texts = HARD + ["\n".join(r.choice(["a", "b", "c ", " ", "", "dd", f"u{r.random()}"]) for _ in range(r.randrange(30))) for _ in range(60)]
    texts += texts[20:24]
    got = {x["doc_id"]: x for x in line_dedup.dedup(docs_of(spark, texts), n).collect()}
    for k, (lines, gone, text) in enumerate(brute(texts, n)):
        assert (got[k]["n_lines"], got[k]["n_removed"], got[k]["text"] or "") == (lines, gone, text), (k, texts[k])
    assert got[0]["text"] is None


def test_repeated_rows_null_ids_and_clashing_names(spark):
    data = [(1, "a\nb\nc", "en", "s", 0)] * 2 + [(2, "x\na\nb", "en", "s", 0), (None, "a\nb", "en", "s", 0), (2, "other", None, None, None)]
    df = spark.createDataFrame(data, DOC_SCHEMA).selectExpr("*", "1 as rank", "2 as k", "3 as n_lines", "4 as `a.b`")
    got = sorted((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in line_dedup.dedup(df).collect())
    assert got == [(0, "a\nb", 0), (1, "c", 2), (1, "c", 2), (2, "other", 0), (2, "x", 2)]
    assert line_dedup.dedup(df.where("false")).count() == 0


def test_single_lines_of_many_words(spark):
    passage, short = " ".join(f"w{k}" for k in range(51)), " ".join(f"w{k}" for k in range(50))
    texts = [f"a\n{passage}\nb\n{short}", passage, f"c\n{passage}\nd", f"{short}\ne\n{passage}", f"x\ny\n{short}", "f\nx\ny"]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup(docs_of(spark, texts), min_words=line_dedup.PASSAGE_WORDS).collect()}
    assert [got[k] for k in range(6)] == [(texts[0], 0), ("", 1), ("c\nd", 1), (f"{short}\ne", 1), (texts[4], 0), ("f", 2)]


@pytest.mark.parametrize("n", [2, 3])
def test_runs_are_maximal_and_copies_of_their_source(spark, n):
    r = random.Random(n + 10)
    texts = ["\n".join(r.choice("abcdefgh") for _ in range(r.randrange(40))) for _ in range(40)]
    texts += [texts[3], "x\ny\n" + texts[3] + "\nz", "\n".join(f"l{k}" for k in range(3000)), "q\n" + "\n".join(f"l{k}" for k in range(3000))]
    lines = [t.split("\n") if t else [] for t in texts]
    by_doc = {}
    for x in line_dedup.runs(docs_of(spark, texts), n).collect():
        mine, its = lines[x["id"]][x["start"] : x["start"] + x["length"]], lines[x["from_id"]][x["from_start"] : x["from_start"] + x["length"]]
        assert mine == its and x["length"] >= n and (x["from_id"], x["from_start"]) < (x["id"], x["start"])
        by_doc.setdefault(x["id"], []).append((x["start"], x["length"], x["from_id"]))
    gone = [g for _, g, _ in brute(texts, n)]
    assert [len({k for s, m, _ in by_doc.get(d, []) for k in range(s, s + m)}) for d in range(len(texts))] == gone
    assert (0, len(lines[3]), 3) in by_doc[40] or len(lines[3]) < n or len(by_doc[3]) > 0
    assert by_doc[43] == [(1, 3000, 42)]


def test_clashing_names_and_one_common_line(spark):
    data = [(k, "same\nsame\n" * 30 + f"own {k}", "en", "s", 0) for k in range(200)]
    df = spark.createDataFrame(data, DOC_SCHEMA).selectExpr("*", "1 as _raw", "2 as _copies", "3 as id", "4 as h", "5 as row", "6 as copies", "7 as places", "8 as own_h", "9 as `a.b`")
    got = {r["doc_id"]: r for r in line_dedup.dedup(df).collect()}
    want = brute([d[1] for d in data], 2)
    assert [(got[k]["n_lines"], got[k]["n_removed"], got[k]["text"]) for k in range(200)] == want
    assert {(r["_raw"], r["_copies"], r["id"], r["h"], r["row"], r["copies"], r["places"], r["own_h"], r["a.b"]) for r in got.values()} == {(1, 2, 3, 4, 5, 6, 7, 8, 9)}
    assert got[3].asDict().keys() == set(df.columns) | {"n_lines", "n_removed"}


def test_query_passages_match_brute_force(spark):
    r = random.Random(7)
    long = [" ".join(f"{g}w{k}" for k in range(r.choice([50, 51, 80]))) for g in range(6)]
    texts = HARD + ["\n".join(r.choice([*long, "a", "b", "c", f"u{r.random()}"]) for _ in range(r.randrange(9))) for _ in range(60)]
    got = {x["doc_id"]: x for x in line_dedup.dedup(docs_of(spark, texts), 2, 51).collect()}
    assert [(got[k]["n_lines"], got[k]["n_removed"], got[k]["text"] or "") for k in range(len(texts))] == brute(texts, 2, 51)
