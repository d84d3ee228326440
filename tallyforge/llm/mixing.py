"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target of words: its weight's share of all words, at most max_repeat times its own
size, the excess shared again by weight. A document of a source is wanted target / size times; the whole
part is certain, and the fractional parts are rounded together: two documents at a time, mass (in words)
moves from one to the other at random, so that one of them becomes whole, the expectation of each stays
and the words of the source stay exact. Groups of some thousand documents leave one fractional document
each; these residuals meet again in the next level of a reduction tree until one is left for a source,
which is rounded by itself. So a source misses its target by less than one document.

All draws come from hashes of source, group and seed: reruns agree. Null source is a source of its own,
after all others; a null id is an id like others. Null and empty texts have size 0: they are taken once for
each whole copy and never count; where all texts are empty, all targets are 0 and each document is taken once.
Whole texts are counted, however long. Repeated rows and ids are documents of their own; rows equal in id,
source and size tie, and which of them is taken more often has no meaning. Other columns, whatever their names,
are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _text
from tallyforge.llm._spark import global_index, small_batches, written

GROUP = 4096
FAN_IN = 64


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words of the whole text) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(_text.word_counts(b.column(2)).astype(np.int64))], names=["doc_id", "source", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(run, "doc_id long, source string, size long")


def numbered(sized: DataFrame, block: int = 1024) -> DataFrame:
    """Rows of sized with _nth: rows equal in id, source and size are told apart by number, so that they are
    dealt over groups as others are. They are counted before the shuffle and written out again in blocks."""
    n = sized.groupBy("doc_id", "source", "size").count()
    at = n.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("count") - 1, F.lit(block))))
    return at.withColumn("_nth", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (block - 1), F.col("count") - 1)))).drop("_from", "count")


def ranked_sources(sized: DataFrame) -> DataFrame:
    """source, source_size, n_docs and rank (from 0, by code point, null last). The rank is counted
    within ranges of sources, so no task sees all of them."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    return global_index(per, [F.col("source").asc_nulls_last()], "rank")


def targets(sources: DataFrame, weights: tuple[float, ...], max_repeat: float) -> DataFrame:
    """Adds target: sources whose share passes their limit stop there, and the rest is shared again."""
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = written(sources.withColumn("_weight", w).withColumn("_limit", F.col("source_size") * float(max_repeat)), "targets")
    total = float(s.agg(F.sum("source_size")).first()[0] or 0)
    rate = 0.0
    while total > 0:  # each round that goes on fills one more source at least
        full = F.col("_limit") < F.col("_weight") * F.lit(rate)
        used, weight = s.agg(F.sum(F.when(full, F.col("_limit")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_weight")))).first()
        new = (total - used) / weight if weight else rate
        if new <= rate + 1e-12 * total:
            break
        rate = new
    return s.withColumn("target", F.least(F.col("_limit"), F.col("_weight") * F.lit(rate))).drop("_weight", "_limit")


def pivotal(p: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds p in order, moving mass between two entries at a time, with sum(p * w) kept: at most one
    entry of the result is not whole."""
    p, w = p.astype(float).tolist(), w.tolist()
    draws, a = rng.random(len(p)).tolist(), -1
    for b in range(len(p)):
        if p[b] <= 1e-12 or p[b] >= 1 - 1e-12:
            p[b] = float(p[b] > 0.5)
            continue
        if a < 0:
            a = b
            continue
        r = w[b] / w[a]
        up, down = min(1 - p[a], p[b] * r), min(p[a], (1 - p[b]) * r)
        if draws[b] * (up + down) < down:
            p[a] += up
            p[b] -= up / r
        else:
            p[a] -= down
            p[b] += down / r
        for k in (a, b):
            if p[k] <= 1e-12 or p[k] >= 1 - 1e-12:
                p[k] = float(p[k] > 0.5)
        open_ = [k for k in (a, b) if 0 < p[k] < 1]
        a = open_[-1] if open_ else -1
    return np.array(p)


_LEVEL = "doc_id long, source string, size long, source_size long, target double, copies long, p double, bucket long, final boolean"


def _round(df: DataFrame, level: int, seed: int, last: bool) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        size, p, ids = t.column("size").to_numpy(), t.column("p").to_numpy(), t.column("doc_id").fill_null(-1).to_numpy()
        name = f"{t.column('source')[0].as_py()!r}|{level}|{t.column('bucket')[0].as_py()}|{seed}"
        rng = np.random.default_rng(zlib.crc32(name.encode()))
        order = np.lexsort((ids, _text.mix(ids.astype(np.uint64)), -size))
        got = np.empty(len(p))
        got[order] = pivotal(p[order], size[order], rng)
        open_ = (got > 0) & (got < 1)
        if last:
            got[open_] = rng.random(int(open_.sum())) < got[open_]
            open_[:] = False
        copies = t.column("copies").to_numpy() + np.where(open_, 0, got).astype(np.int64)
        new = {"copies": pa.array(copies), "p": pa.array(np.where(open_, got, 0.0)), "bucket": pa.array(t.column("bucket").to_numpy() // FAN_IN), "final": pa.array(~open_)}
        return pa.table([new.get(c, t.column(c) if c in t.column_names else None) for c in (x.split()[0] for x in _LEVEL.split(", "))], names=[x.split()[0] for x in _LEVEL.split(", ")])

    return df.groupBy("source", "bucket").applyInArrow(run, _LEVEL)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeat: float = 3, seed: int = 0, group: int = GROUP) -> DataFrame:
    """doc_id, source, size, source_size, target (of the source), copies, taken (copies * size)."""
    sized = written(sizes(docs), "sizes")
    src = written(targets(ranked_sources(sized), weights, max_repeat), "mix")
    most = src.agg(F.max("n_docs"), F.count("*")).first()
    other = src.select(F.col("source").alias("_source"), "source_size", "target", "n_docs")
    if (most[1] or 0) <= 100_000:
        other = F.broadcast(other)
    rows = numbered(sized).join(other, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    want = F.when(F.abs(want - F.round(want)) < 1e-9, F.round(want)).otherwise(want)
    rows = rows.withColumn("copies", F.floor(want)).withColumn("p", want - F.floor(want))
    buckets = F.ceil(F.col("n_docs") / group)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "_nth", F.lit(seed)), buckets)).drop("n_docs", "_nth").withColumn("final", (F.col("size") == 0) | (F.col("p") == 0))
    keep = [x.split()[0] for x in _LEVEL.split(", ")]
    done, open_, level, left = [rows.where("final").select(*keep)], rows.where("not final").select(*keep), 0, -(-(most[0] or 1) // group)
    while True:
        got = written(_round(open_, level, seed, left <= 1), f"pivotal{level}")
        done.append(got.where("final"))
        if left <= 1:
            break
        open_, level, left = got.where("not final"), level + 1, -(-left // FAN_IN)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
