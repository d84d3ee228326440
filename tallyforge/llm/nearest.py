"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are put on the unit sphere (scaled by the largest norm, the missing length in one more axis, so
that the order by inner product is the order by angle), padded to a power of two and turned by three
rounds of random signs and fast Hadamard transforms; a hash is the signed axis of the largest coordinate.
Each of several tables uses its own turn. A query looks into the buckets of its largest coordinates in
every table (multiprobe), and what it finds is ranked again by exact inner products of the original
vectors in double precision. Queries that find fewer than k so look into all cells: they get k vectors, or all
candidates if there are fewer.

Every vector is indexed; nothing is fitted but the largest norm. A first pass counts cells (at most tables * 2 *
dim numbers go to the driver); a second one deals vectors and queries over tasks. Cells larger than `chunk` are
dealt over several slots, and so are their queries, so copies of one vector meet no single task. With one axis
a table, a cell holds about n / (2 dim) vectors: `tables` and `probes` set recall against work, and the defaults
keep recall at 0.95 or more where the nearest have inner products of 0.35 only.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take
no part. Rows with a null id are left out. Repeated rows and ids are candidates and queries of their own: a query
finds all rows but its own. Ties go to the smaller id. Other columns, whatever their names, are not carried; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tallyforge.llm import _text
from tallyforge.llm._spark import parallelism, remove, written

TABLES, PROBES, CHUNK, PART_BYTES = 16, 8, 4096, 16 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast transform along the last axis, whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def signs(tables: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, dim))


def turned(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    for k in range(3):
        x = hadamard(x * s[k])
    return x


def on_sphere(x: np.ndarray, largest: float, query: bool, dim: int) -> np.ndarray:
    out = np.zeros((len(x), dim))
    norm = np.sqrt((x * x).sum(1))
    out[:, : x.shape[1]] = x / (norm[:, None] if query else largest)
    if not query and dim > x.shape[1]:
        out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm / largest) ** 2))
    return out


def axes(r: np.ndarray, probes: int) -> np.ndarray:
    """The signed axes of the largest coordinates, best first; axis j is j, or j + dim if negative."""
    return np.argsort(-np.concatenate([r, -r], 1), axis=1, kind="stable")[:, :probes]


_CLEAN = "uid long, id long, q boolean, d int, norm double, v binary"
_OUT = "query_id long, rank int, vec_id long, score double"


def cleaned(vectors: DataFrame, is_query: Column, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """(_CLEAN rows of vectors that take part, numpy kind of their components in v)."""
    single = isinstance(vectors.select(vec_col).schema[0].dataType, ArrayType) and isinstance(vectors.select(vec_col).schema[0].dataType.elementType, FloatType)
    kind = "<f4" if single else "<f8"
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = x.where("id is not null and v is not null").where(~bad & F.exists("v", lambda c: c != 0)).withColumn("uid", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, d = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(kind), pc.list_value_length(b.column(3)).to_numpy()
            at = np.concatenate([[0], np.cumsum(d)])
            norm = np.add.reduceat(flat.astype(float) ** 2, at[:-1]) if len(b) else np.zeros(0)
            blobs = pa.array([flat[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(d.astype(np.int32)), pa.array(norm), blobs], names=["uid", "id", "q", "d", "norm", "v"])

    return written(x.select("uid", "id", "q", "v").mapInArrow(run, _CLEAN), "vectors"), kind


def search(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: int = PROBES, chunk: int = CHUNK, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row that is_query holds for."""
    spark = vectors.sparkSession
    x, kind = cleaned(vectors, is_query, id_col, vec_col)
    lengths = x.groupBy("d").agg(F.count("*").alias("n"), F.max("norm").alias("top"), F.min("norm").alias("low"), F.sum(F.col("q").cast("long")).alias("asked")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], _OUT)
    d, largest = lengths["d"], float(np.sqrt(lengths["top"]))
    flat = lengths["low"] > lengths["top"] * (1 - 1e-5)
    dim = 1 << (d - 1 if flat else d).bit_length()
    turn = signs(tables, dim, seed)
    x = x.where(F.col("d") == d)

    def matrix(blobs: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(blobs), kind).astype(float).reshape(len(blobs), d)

    def cells(m: np.ndarray, query: bool, tables: int, n: int) -> Iterator[np.ndarray]:
        """Of each table, the n cells of each vector."""
        at = on_sphere(m, largest, query, dim)
        for t in range(tables):
            yield axes(turned(at, turn[t]), n) + t * 2 * dim

    def rank(uid: np.ndarray, ids: np.ndarray, m: np.ndarray, own: int, q: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of what may be among the k best, each summed alike, so that copies tie."""
        ok = np.flatnonzero(uid != own)
        if len(ok) > k:
            cut = -np.partition(-near[ok], k - 1)[k - 1]
            ok = ok[near[ok] >= cut - 1e-9 * max(1.0, abs(cut))]
        s = np.einsum("ij,j->i", m[ok], q, optimize=False)
        best = np.lexsort((uid[ok], ids[ok], -s))[:k]
        return ok[best], s[best]

    def slots(t: pa.Table) -> dict[int, np.ndarray]:
        slot = t.column("slot").to_numpy()
        order = np.argsort(slot, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(slot[order]) != 0)[: len(order)])
        return {int(slot[o[0]]): o for o in np.split(order, cut[1:])} if len(order) else {}

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        here = slots(a)
        (auid, aid, av), (buid, bid, bv) = ((t.column("uid").to_numpy(), t.column("id").to_numpy(), t.column("v").to_pylist()) for t in (a, b))
        for slot, mine in slots(b).items():
            if slot not in here:
                continue
            its = here[slot]
            uid, ids, m, q = auid[its], aid[its], matrix([av[i] for i in its]), matrix([bv[i] for i in mine])
            for lo in range(0, len(q), 256):
                near = q[lo : lo + 256] @ m.T
                for j in range(len(near)):
                    own = mine[lo + j]
                    at, s = rank(uid, ids, m, buid[own], q[lo + j], near[j])
                    out.append((int(buid[own]), int(bid[own]), uid[at].tolist(), ids[at].tolist(), s.tolist()))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["quid", "query_id", "uids", "ids", "scores"])

    def merge(t: pa.Table) -> pa.Table:
        n = pc.list_value_length(t.column("uids")).to_numpy()
        q, name = np.repeat(t.column("quid").to_numpy(), n), np.repeat(t.column("query_id").to_numpy(), n)
        u, i, s = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("uids", "ids", "scores"))
        order = np.lexsort((u, i, -s, q))
        fresh = order[np.append(True, (np.diff(q[order]) != 0) | (np.diff(u[order]) != 0))[: len(q)]]
        q, name, i, s = q[fresh], name[fresh], i[fresh], s[fresh]
        starts = np.flatnonzero(np.append(True, np.diff(q) != 0)[: len(q)])
        r = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        top = r < k
        return pa.table([pa.array(q[top]), pa.array(name[top]), pa.array((r[top] + 1).astype(np.int32)), pa.array(i[top]), pa.array(s[top])], names=["quid", "query_id", "rank", "vec_id", "score"])

    def probed(asked: DataFrame, tables: int, probes: int) -> DataFrame:
        """The k best of what the queries' cells hold."""
        size = tables * 2 * dim

        def count(query: bool) -> np.ndarray:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                n = np.zeros(size, np.int64)
                for b in batches:
                    if len(b):
                        for c in cells(matrix(b.column(0).to_pylist()), query, tables, probes if query else 1):
                            n += np.bincount(c.ravel(), minlength=size)
                some = np.flatnonzero(n)
                yield pa.record_batch([pa.array(some), pa.array(n[some])], names=["cell", "n"])

            out = np.zeros(size, np.int64)
            for r in (asked if query else x).select("v").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
                out[r["cell"]] = r["n"]
            return out

        n_index, n_asked = count(False), count(True)
        # Chunks of each cell's vectors and queries; cells that lack either have none.
        chunks = {False: -(-n_index // chunk) * (n_asked > 0), True: -(-n_asked // chunk) * (n_index > 0)}
        sent = int((n_index * chunks[True] + n_asked * chunks[False]).sum())
        n_parts = max(parallelism(spark), -(-sent * (d * int(kind[2]) + 32) // PART_BYTES))

        def dealt(df: DataFrame, query: bool) -> DataFrame:
            own, others = chunks[query], chunks[not query]

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if not len(b):
                        continue
                    at = _text.mix(b.column(0).to_numpy().astype(np.uint64))
                    for c in cells(matrix(b.column(2).to_pylist()), query, tables, probes if query else 1):
                        row, cell = np.repeat(np.arange(len(b)), c.shape[1]), c.ravel()
                        for r in range(int(others[cell].max(initial=0))):
                            i = np.flatnonzero(others[cell] > r)
                            mine = (at[row[i]] % own[cell[i]].astype(np.uint64)).astype(np.int64)
                            pair = (mine << 32) + r if query else (np.int64(r) << 32) + mine
                            slot = _text.mix(cell[i].astype(np.uint64) + _text.mix(pair.astype(np.uint64)))
                            take = pa.array(row[i])
                            yield pa.record_batch([pa.array((slot % np.uint64(n_parts)).astype(np.int32)), pa.array(slot.view(np.int64)), *(b.column(j).take(take) for j in range(3))], names=["part", "slot", "uid", "id", "v"])

            return df.select("uid", "id", "v").mapInArrow(run, "part int, slot long, uid long, id long, v binary").repartition(n_parts, "part").groupBy("part")

        found = dealt(x, False).cogroup(dealt(asked, True)).applyInArrow(meet, "quid long, query_id long, uids array<long>, ids array<long>, scores array<double>")
        return found.groupBy(F.pmod(F.xxhash64("quid"), F.lit(4 * parallelism(spark))).alias("part")).applyInArrow(lambda t: merge(t), f"quid long, {_OUT}")

    asked = x.where("q")
    best = written(probed(asked, tables, probes), "found")
    # Queries that found fewer than k look into all cells of one table, which hold every vector once.
    short = written(asked.join(best.where(F.col("rank") == k).select(F.col("quid").alias("uid")), "uid", "left_anti"), "short")
    if not short.isEmpty():
        rest = written(probed(short, 1, 2 * dim), "found")
        best = best.join(short.select(F.col("uid").alias("quid")), "quid", "left_anti").unionByName(rest)
    remove(x)
    return best.drop("quid")
