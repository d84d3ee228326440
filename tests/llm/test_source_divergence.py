"""The audit against a plain count with exact integers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tallyforge.llm import source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, least=30, ranks=50):
    """lang, source, part, item, value, rank of docs (text, lang, source)."""
    per, langs, sources = Counter(), defaultdict(Counter), defaultdict(Counter)
    found = []
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        terms = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        found.append((lang, source, terms))
        sources[lang, source].update()
        per.update((lang, t) for t in set(terms))
    kept = defaultdict(set)
    for (lang, t), n in per.items():
        if n >= least:
            kept[lang].add(t)
    for lang, source, terms in found:
        terms = [t for t in terms if t in kept[lang]]
        langs[lang].update(terms)
        sources[lang, source].update(terms)
    p = lambda c, t, v: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * v)
    out = []
    for (lang, source), c in sources.items():
        v = len(kept[lang])
        pairs = [(o, sum(abs(p(c, t, v) - p(oc, t, v)) for t in kept[lang])) for (ol, o), oc in sources.items() if ol == lang and o != source]
        terms = [(t, p(c, t, v) - p(langs[lang], t, v)) for t in c if p(c, t, v) > p(langs[lang], t, v)]
        for part, rows, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
            rows.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(rows[:most])]
    return sorted(out)


def got(spark, docs, **kw):
    df = spark.createDataFrame([(k, *d, 0) for k, d in enumerate(docs)], SCHEMA)
    return sorted(map(tuple, source_divergence.audit(df, **kw).collect()))


def corpus(rng, n):
    vocab = [f"{a}{b}" for a in ("la", "É", "zu", "x", "中文", "Straße") for b in ("", "n", "ner", "é", "𝔘")]
    text = lambda: "".join(rng.choice(vocab) + rng.choice([" ", "  ", ", ", "1", "\n", "-", "\x00", "　"]) for _ in range(rng.randrange(40)))
    return [(rng.choice([None, "", text(), text(), text()]), rng.choice([None, "", "en", "en", "de"]), rng.choice([None, "", "s1", "s2", "ß", "z"])) for _ in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 60, "group_bytes": 500}])
def test_random_corpus(spark, sizes):
    docs = corpus(random.Random(1), 400)
    assert got(spark, docs, least_docs=5, ranks=7, **sizes) == brute(docs, 5, 7)


def test_many_sources_and_blocks(spark, monkeypatch):
    """Several blocks of terms and of sources."""
    monkeypatch.setattr(source_divergence, "SOURCE_BLOCK", 3)
    monkeypatch.setattr(source_divergence, "TERM_BLOCK", 7)
    rng = random.Random(2)
    docs = [(" ".join(f"w{chr(97 + rng.randrange(26))}" for _ in range(30)), "en", f"s{rng.randrange(11)}") for _ in range(150)]
    assert got(spark, docs, least_docs=3) == brute(docs, 3)


def test_no_kept_terms_ties_and_repeats(spark):
    docs = [("a b", "en", "x"), ("a b", "en", "x"), ("a", "en", "y"), ("a", "en", "z"), (None, "fr", "x"), ("", "fr", None), ("12 34", "de", "q")]
    assert got(spark, docs, least_docs=2) == brute(docs, 2)
    assert got(spark, docs) == brute(docs)
    assert ("de", "q") not in {r[:2] for r in got(spark, docs)}  # its only pairs would be with itself


def test_long_text_and_extra_columns(spark):
    docs = [("word " * 300000 + "other", "en", "a"), ("word", "en", "b")]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "text string, lang string, source string, term int, shards string")
    assert sorted(map(tuple, source_divergence.audit(df, least_docs=1).collect())) == brute(docs, 1)


def test_empty_table(spark):
    assert got(spark, [("x", "en", "s")])[:0] == source_divergence.audit(spark.createDataFrame([], SCHEMA)).collect()


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, v = 3 * 10**12 + 7, 10**13 + 1, 10**6 + 3
    row = spark.range(1).selectExpr(f"{n}L AS n", f"{total}L AS t", f"{v}L AS v")
    from pyspark.sql import functions as F

    assert row.select(source_divergence.share(F.col("n"), F.col("t"), F.col("v"))).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_registered_query_is_the_whole_table(spark, sf):
    from helpers import rows

    from tallyforge.llm.queries import QUERIES

    assert sorted(map(tuple, QUERIES["op13_source_divergence"](spark, sf).collect())) == brute([(r["text"], r["lang"], r["source"]) for r in rows(sf, "documents")])
