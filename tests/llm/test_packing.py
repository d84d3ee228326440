import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from helpers import HARD, docs_of, rows
from tallyforge.llm import packing


def check(texts, pieces, window=2048):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for k, x in enumerate(texts)}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(own) == p["length"] and zlib.crc32(own.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        by_doc[p["doc_id"]].append((p["start"], p["length"]))
        by_seq[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(ids)
    for k, v in by_doc.items():
        at = 0
        for s, n in sorted(v):
            assert s == at and n > 0
            at += n
        assert at == len(ids[k])
    for v in by_seq.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= window
    return by_seq


def test_round_trip(spark, sf):
    texts = HARD + [x["text"] for x in rows(sf, "documents")]
    pieces = packing.pack(docs_of(spark, texts))
    by_seq = check(texts, pieces.collect())
    short = [k for k, v in by_seq.items() if sum(n for _, n in v) < 2048]
    assert len(short) <= 1
    assert packing.padding(pieces).where("padding > 0").count() <= 1


def test_least_squares_uses_combinations(spark):
    hist = np.zeros(2049, np.int64)
    hist[[1000, 1048, 500, 548]] = [300, 200, 100, 100]
    combos, x = packing.plan(hist)
    left = hist.copy()
    for c, n in zip(combos, x):
        assert sum(c) == 2048
        for l in c:
            left[l] -= n
    assert (left >= 0).all() and left.sum() <= 40


def test_empty(spark):
    assert packing.pack(docs_of(spark, ["a"]).where("false")).count() == 0


def test_special_tokens_null_and_repeated_ids_and_other_columns(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|>y " * 900, "<|endoftext", "plain text", None]
    check(texts, packing.pack(docs_of(spark, texts).selectExpr("*", "1 as uid", "2 as rem", "3 as start", "4 as `a.b`")).collect())
    got = packing.pack(docs_of(spark, texts[:1])).collect()
    assert got[0]["doc_tokens"] == 5
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "a b c"), (7, "w " * 5000)], "doc_id long, text string")
    pieces = packing.pack(same).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] is None) == 2 * sum({p["doc_tokens"] for p in pieces if p["doc_id"] is None})
    assert sum(p["length"] for p in pieces if p["doc_id"] == 7) == sum({p["doc_tokens"] for p in pieces if p["doc_id"] == 7})
