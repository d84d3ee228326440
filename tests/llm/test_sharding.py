from collections import defaultdict

from helpers import DOC_SCHEMA, docs_of
from tallyforge.llm import sharding


def test_shards_fit_and_are_minimal(spark):
    texts = ["é" * (k % 50) for k in range(400)] + [None, ""]
    got = sharding.shard(docs_of(spark, texts), limit=700).collect()
    assert len(got) == len(texts)
    size = defaultdict(int)
    for r in got:
        assert r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) and r["depth"] == len(r["shard"]) and not r["oversized"]
        size[r["shard"]] += r["n_bytes"]
    assert all(v <= 700 for v in size.values()) and len(size) > 10
    assert all(size[r["shard"]] == r["shard_bytes"] for r in got)
    for a in size:  # prefix-free, and no pair of buddies would fit together
        assert not any(a != b and b.startswith(a) for b in size)
        buddy = a[:-1] + ("1" if a[-1] == "0" else "0")
        under = sum(v for b, v in size.items() if b.startswith(buddy))
        assert size[a] + under > 700


def test_hot_key_splits_and_equal_rows_are_flagged(spark):
    hot = spark.createDataFrame([(1, f"text {k}", "en", "s", 0) for k in range(300)], DOC_SCHEMA)
    got = sharding.shard(hot, limit=400).collect()
    assert len(got) == 300 and not any(r["oversized"] for r in got)
    same = spark.createDataFrame([(1, "x" * 100, "en", "s", 0)] * 50 + [(None, None, None, None, None)], DOC_SCHEMA)
    got = sharding.shard(same, limit=400).collect()
    assert len(got) == 51 and sum(r["oversized"] for r in got) == 50


def test_empty(spark):
    assert sharding.shard(docs_of(spark, ["a"]).where("false")).count() == 0
