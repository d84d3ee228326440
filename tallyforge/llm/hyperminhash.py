"""HyperMinHash near-duplicates: compressed registers, banding, corrected estimates, exact verification.

A document is the set of its distinct n-word shingles; rows with the same set are one node. Each set has BUCKETS
registers of 16 bits: of the shingle hashes that fall into a bucket the least, kept as its number of leading zeros (6
bits) and the MANTISSA bits after the first one, so a register is smaller than a hash and still tells minima apart;
0 is a bucket without shingles. For banding, empty registers borrow from others by densification, as a band of a short
text would else hold a single shingle; ROWS registers are a band, and nodes that agree in one are candidates. Two sets of Jaccard J agree in none of the BANDS bands with a chance of about (1 - J^ROWS)^BANDS:
3e-9 at 0.85, less above. Candidates must then reach t, less MARGIN standard errors, by the share of equal registers
less the agreements that the short registers have by chance. What is left is verified on the full sets.

A band's bucket first gives only pairs with the node of it that meets most others in all bands, so copies by the thousand
make a star and no clique. Then, where nodes of one bucket still lie in several components, those outside its largest component are compared with all
others of the bucket, in chunks dealt over tasks; only links that join components are returned. Nothing is capped.

Null and empty texts have no shingles and link with nothing. Texts of fewer than n words are one shingle. Rows with
equal id are rows of their own; a null id is no component's smallest unless all are null. Whole texts are taken, however
long; ties do not matter, as components do not depend on the order of tests. Other columns, whatever their names, are
not carried; an empty table gives an empty result. 64-bit hashes stand for shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _text
from tallyforge.llm._spark import remove, small_batches, written
from tallyforge.llm.components import components
from tallyforge.llm.jaccard_join import _blobs, _mixed, _verified, bitmaps, distinct_grams, linked, most_apart, node_of, oracle_sql

BUCKETS, MANTISSA = 256, 10
BANDS, ROWS, TRIES = 42, 6, 128
#: Bits of a hash beyond those that choose its bucket.
BITS = 64 - (BUCKETS - 1).bit_length()
MARGIN = 6.0


def registers(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of BUCKETS registers for each set of hashes h[first[i]:first[i + 1]]."""
    n = np.diff(first)
    x = _text.mix(h ^ np.uint64(0x2545F4914F6CDD1D))
    at = np.repeat(np.arange(len(n)), n) * BUCKETS + (x & np.uint64(BUCKETS - 1)).astype(np.int64)
    least = np.full(len(n) * BUCKETS, np.iinfo(np.uint64).max)
    np.minimum.at(least, at, x >> np.uint64(64 - BITS))
    held = least < np.uint64(1 << BITS)
    low = np.where(held, least, 0)
    # The place of the first one, exactly: float conversion may round up to the next power of two.
    top = np.frexp(low.astype(np.float64))[1].astype(np.int64)
    top -= (low < (np.uint64(1) << np.maximum(top - 1, 0).astype(np.uint64))) & (top > 0)
    zeros = np.minimum(BITS - top, 62)
    after = np.where(top > MANTISSA, low >> np.maximum(top - 1 - MANTISSA, 0).astype(np.uint64), low << np.maximum(MANTISSA + 1 - top, 0).astype(np.uint64))
    packed = ((zeros + 1) << MANTISSA) | (after.astype(np.int64) & ((1 << MANTISSA) - 1))
    return np.where(held, packed, 0).astype(np.uint16).reshape(len(n), BUCKETS)


def filled(m: np.ndarray) -> np.ndarray:
    """Registers in which each empty one has the value of the first of TRIES buckets, drawn for its place, that is not
    empty (optimal densification: filled registers of two sets agree with chance J, too), else the row's largest."""
    out = m.copy()
    rows = np.flatnonzero((m == 0).any(1) & m.any(1))
    for k in range(TRIES):
        if not len(rows):
            break
        at = (_text.mix(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(BUCKETS * (k + 1))) % np.uint64(BUCKETS)).astype(np.int64)
        part = out[rows]
        part = np.where(part == 0, m[rows][:, at], part)
        out[rows] = part
        rows = rows[(part == 0).any(1)]
    return np.where(out == 0, m.max(1, keepdims=True), out)


def bands(m: np.ndarray) -> np.ndarray:
    """BANDS keys of each row of registers that are not all empty."""
    part = filled(m)[:, : BANDS * ROWS].reshape(len(m), BANDS, ROWS).astype(np.uint64)
    key = np.zeros((len(m), BANDS), np.uint64)
    for k in range(ROWS):
        key = _text.mix(key ^ (part[:, :, k] + np.uint64(k << 32)))
    return _text.mix(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def by_chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected equal registers of two sets of n and m shingles without a common one (Yu and Weber, HyperMinHash:
    about 0.1699 of all buckets for each value of the mantissa, less as the sizes differ)."""
    r = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    return 0.169919487159739093975 * BUCKETS / (1 << MANTISSA) * 4 * r / (1 + r) ** 2


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard, number of registers it rests on) of pairs of rows of registers, corrected for agreement by chance."""
    used = ((x | y) != 0).sum(-1)
    equal = ((x == y) & (x != 0)).sum(-1)
    chance = np.minimum(by_chance(n, m), used / 2)  # of the registers that no common shingle decides
    return np.clip((equal - chance) / np.maximum(used - chance, 1), 0, 1), used


def may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(whether sizes and estimate allow a Jaccard of t, the estimate)."""
    got, used = estimate(x, y, n, m)
    slack = MARGIN * np.sqrt(t * (1 - t) / np.maximum(used, 1))
    # With few registers in use, one shingle may hide another in a bucket: the estimate is no ground to drop a pair.
    return (np.minimum(n, m) * 10000 >= np.maximum(n, m) * round(t * 10000)) & ((got >= t - slack) | (used < 64)), got


def _sketched(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, node and, for sets that are not empty, regs of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in _text.chunks(b.column(1), lower=True):
                h, first = distinct_grams(w, n)
                size, regs = np.diff(first), registers(h, first)
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(size), pa.array(node_of(h, first)), pa.array([r.tobytes() if k else None for r, k in zip(regs, size, strict=True)], pa.binary())], names=["doc_id", "n_shingles", "node", "regs"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, regs binary")


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), BUCKETS)


def _keys(kinds: DataFrame) -> DataFrame:
    """key, node: every band of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                key = bands(_matrix(b.column(1)))
                yield pa.record_batch([pa.array(key.ravel()), b.column(0).take(pa.array(np.repeat(np.arange(len(b)), BANDS)))], names=["key", "node"])

    return kinds.select("node", "regs").mapInArrow(run, "key long, node long")


def _near(pairs: DataFrame, kinds: DataFrame, t: float) -> DataFrame:
    """a, b, est of the pairs whose sizes and registers allow a link."""
    one = kinds.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("x"))
    two = kinds.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("y"))
    both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * 10000 >= F.greatest("na", "nb") * round(t * 10000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                ok, est = may_link(_matrix(b.column("x")), _matrix(b.column("y")), b.column("na").to_numpy(), b.column("nb").to_numpy(), t)
                ok = pa.array(ok)
                yield pa.record_batch([b.column("a").filter(ok), b.column("b").filter(ok), pa.array(est).filter(ok)], names=["a", "b", "est"])

    return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long, est double")


def _passing(g: pa.Table, t: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, j, est): for each other i of a chunk, the places j of nodes of other components that it may link with."""
    label, other, n = (g.column(c).to_numpy() for c in ("label", "other", "n"))
    m, whole = _matrix(g.column("regs")), np.flatnonzero(~other)
    for i in np.flatnonzero(other):
        j = whole[label[whole] != label[i]]
        j = j[np.minimum(n[j], n[i]) * 10000 >= np.maximum(n[j], n[i]) * round(t * 10000)]
        ok, est = may_link(m[j], m[i], n[j], n[i], t)
        if ok.any():
            yield int(i), j[ok], est[ok]


def _nearest(mixed: DataFrame, kinds: DataFrame, t: float) -> DataFrame:
    """list, ca, co, node, label, other of the nodes that may link in their chunk, and for each other its nearest
    there (near)."""

    def run(g: pa.Table) -> pa.Table:
        g = g.combine_chunks()
        node, other = g.column("node").to_numpy(), g.column("other").to_numpy()
        near, hit = np.zeros(len(node), np.int64), np.zeros(len(node), bool)
        for i, j, est in _passing(g, t):
            near[i], hit[i], hit[j] = node[j[est.argmax()]], True, True
        g = g.select(["list", "ca", "co", "node", "label", "other"]).append_column("near", pa.array(near, mask=~(other & hit)))
        return g.filter(pa.array(hit))

    rows = mixed.join(kinds.select("node", "n", "regs"), "node")
    return rows.groupBy("list", "ca", "co").applyInArrow(run, "list long, ca int, co int, node long, label long, other boolean, near long")


def _decided(rows: DataFrame, labels: DataFrame, kinds: DataFrame, blobs: DataFrame, t: float) -> DataFrame:
    """Links (a, b) that join components, of the nodes that may link in a chunk: exact, on whole sets."""

    def run(g: pa.Table) -> pa.Table:
        g = g.combine_chunks()
        node, label, n = (g.column(c).to_numpy() for c in ("node", "label", "n"))
        grams = [np.frombuffer(x.as_buffer(), "<u8") for x in g.column("grams")]
        first = np.concatenate([[0], np.cumsum([len(x) for x in grams])])
        # Parity bitmaps, whose distance never exceeds the difference of two sets, come before whole sets.
        bits = [np.frombuffer(x, "<u8") for x in bitmaps(np.concatenate(grams), first)]
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = x = up.get(up[x], up[x])
            return x

        a, b = [], []
        for i, j, est in _passing(g, t):
            for k in j[np.argsort(-est, kind="stable")]:
                x, y = root(int(label[i])), root(int(label[k]))
                if x == y or len(bits[i]) == len(bits[k]) and np.bitwise_count(bits[i] ^ bits[k]).sum() > most_apart(t, n[i] + n[k]):
                    continue
                if linked(grams[i], grams[k], t):
                    up[max(x, y)] = min(x, y)
                    a.append(min(node[i], node[k]))
                    b.append(max(node[i], node[k]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    now = rows.drop("label", "near").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = now.groupBy("list", "ca", "co").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").drop("lo", "hi")
    full = now.join(apart, ["list", "ca", "co"]).join(kinds.select("node", "n", "regs"), "node").join(blobs.select("node", "grams"), "node")
    return full.groupBy("list", "ca", "co").applyInArrow(run, "a long, b long").distinct()


def dedup(docs: DataFrame, t: float = 0.85, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows, links). rows: doc_id, n_shingles, node (0: no shingles), component_id, kept; links: pairs of nodes that
    were verified, which with equal sets in one node connect just what a Jaccard of t or more connects."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(_sketched(docs, n), "sketches")
    kinds = written(rows.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")), "nodes")
    keys = _keys(kinds)
    full = written(keys.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("node")).alias("list")).where("k > 1"), "bands")
    members = written(keys.join(full.select("key", "k"), "key"), "members")
    # The text from which copies were made meets most of them, and most bands: it leads, so that one star holds them.
    weight = members.groupBy("node").agg(F.sum("k").alias("weight"))
    leads = members.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("lead"))
    stars = members.join(leads, "key").where("node <> lead").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
    stars = written(_near(stars, kinds, t), "stars")

    def sets_of(nodes: DataFrame) -> DataFrame:
        return written(_blobs(docs, kinds.join(nodes.distinct(), "node", "left_semi").select("node", "rep"), n), "grams")

    def labelled(links: DataFrame) -> DataFrame:
        return written(components(links), "labels")

    blobs = sets_of(stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))))
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a"))
    links = written(_verified(best, blobs, t), "links")
    labels = labelled(links)
    other = stars.join(best, ["a", "b"], "left_anti").select("a", "b")
    for c in ("a", "b"):
        other = other.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")), c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", c))
    links = links.unionByName(written(_verified(other.where("la <> lb"), blobs, t), "links"))
    labels = labelled(links)

    # Bands with the same nodes are one list (same exclusive or, number and least of the nodes' hashes).
    once = full.where("k > 2").groupBy("list", "k", "least").agg(F.min("key").alias("key")).select("key")
    lists = members.where("k > 2").join(once, "key", "left_semi").select(F.col("key").alias("list"), "node")
    near = written(_nearest(_mixed(lists, labels, kinds), kinds, t), "near")
    sets = sets_of(near.select("node"))
    pairs = near.where("near is not null").select(F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b")).distinct()
    links = links.unionByName(written(_verified(pairs.join(stars, ["a", "b"], "left_anti"), sets, t), "links"))
    labels = labelled(links)
    rest = written(_decided(near, labels, kinds, sets, t), "links")
    if not rest.isEmpty():
        links = links.unionByName(rest)
        labels = labelled(links)
    for table in (full, members, stars, blobs, near, sets):  # the result reads none of them
        remove(table)
    named = kinds.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select("node", "component_id")
    out = rows.join(named, "node", "left").withColumn("component_id", F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "node", "component_id", F.expr("doc_id <=> component_id").alias("kept")), links


ORACLE_SQL = f"SELECT *, doc_id = component_id AS kept FROM ({oracle_sql(85, 5)})"
