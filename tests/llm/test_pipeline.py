from collections import Counter

import pytest

import corpus_pipeline as p
from helpers import words
from tallyforge.llm import quality_rules
from test_jaccard_join import lower
from test_line_dedup import brute as line_brute
from test_packing import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for _, f in p.STAGES:
        docs = p.written(f(spark, docs, SF), "t")
        out.append(docs)
    return out


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])


def test_columns_and_names(stages):
    assert [df.columns for df in stages[:-1]] == [p.COLUMNS] * 5


def test_quality_keeps_what_the_operator_keeps(spark, stages):
    rules = quality_rules.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r["doc_id"] for r in quality_rules.apply_rules(stages[0], rules).where("kept").collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == kept


def test_lines(stages):
    before, after = rows(stages[1]), {r["doc_id"]: r for r in rows(stages[2])}
    want = line_brute([r["text"] for r in before], 2, 51)
    assert set(after) == {r["doc_id"] for r, (n, gone, _) in zip(before, want) if not gone or gone < n}
    for r, (_, _, text) in zip(before, want):
        if r["doc_id"] in after:
            assert after[r["doc_id"]]["text"] == text and after[r["doc_id"]]["n_chars"] == len(text)


def test_one_of_each_group(stages):
    before, after = rows(stages[2]), [r["doc_id"] for r in rows(stages[3])]
    sets = []
    for r in before:
        w = words(lower(r["text"]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    assert after == [before[k]["doc_id"] for k in sorted(set(label))]


def test_mix_and_pack(stages):
    before, mixed = rows(stages[3]), rows(stages[4])
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 3 and {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in before}
    n = Counter(r["doc_id"] for r in mixed)
    pieces = rows(stages[5])
    assert sum(r["length"] for r in pieces) == sum(n[r["doc_id"]] * r["doc_tokens"] for r in {x["doc_id"]: x for x in pieces}.values())
    assert set(n) == {r["doc_id"] for r in pieces}


def test_repeated_and_null_ids_go_by_row(spark):
    a = " ".join(f"w{k}" for k in range(60))
    b = " ".join(f"v{k}" for k in range(60))
    data = [(1, a, "x"), (1, a, "x"), (1, b, "x"), (2, b + " end", "y"), (None, a + " more", None), (None, None, "y"), (None, "", "y")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in data], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in p.near_duplicates(spark, docs, SF).collect())
    assert kept == [(0, ""), (0, ""), (1, b), (1, a)]
    mixed = p.mix(spark, docs, SF)
    n = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    assert max(n.values()) <= 6 and set(n) <= {(i, t) for i, t, _ in data}


@pytest.mark.parametrize("keep", ["false", "doc_id is null"])
def test_empty_input_goes_through_all_stages(spark, keep):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(keep)
    for _, f in p.STAGES:
        docs = p.written(f(spark, docs, SF), "t")
        assert docs.count() == 0


def test_documents_that_only_repeat_leave_the_later_stages_little(spark):
    t = "one two three\nfour five six\n" + " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in p.STAGES[1:]:
        docs = p.written(f(spark, docs, SF), "t")
        if name == "line dedup":
            assert [r["doc_id"] for r in docs.collect()] == [0]
    assert docs.count() == 1
