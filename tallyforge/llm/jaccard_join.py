"""N-gram Jaccard join: universe partition, pigeonhole and exact verification.

Documents are sets of hashed word n-grams; rows with the same set are one node. Two sets with Jaccard of
at least t differ in at most U = (1 - t) / (1 + t) * (|A| + |B|) n-grams and lie in the same or in
neighbouring size bands. A band cuts the hash universe into segments; if the segments' weights sum to
U + 1 + 2 e, sets that differ in at most U agree (or, in segments of weight 2, differ by one n-gram at
most) in segments of weight 1 + 2 e. So each set may skip its e most costly segments, and one agreement
is still seen by both. Signatures are the sums of a segment's n-grams, and for weight 2 also the sums of
its one-deletion neighbourhood. Cost decides twice: a band's number of segments, of weight-2 segments and
of skips from its number of sets and their length; a set's skipped segments from a sketch of how many sets
hold each n-gram (all sets are counted).

Sets that share a signature are candidates, and two filters come before any set is sent: sizes, and parity
bitmaps of 2 to 4 bits an n-gram, whose distance never exceeds the difference of the sets. A bucket first
emits only pairs with its least node; those that pass are verified exactly on the whole sets, the nearest one
of each node first, the others only if they may still join two components. Last, buckets whose nodes lie in
several components compare the nodes outside the bucket's largest component with all others: buckets are
dealt over tasks in chunks of nodes, each node tells its nearest one there, and what these tests leave apart
is decided on the whole sets inside the tasks, which return only links that join components. Links of
different sets are all found or implied by others; nothing is capped. 64-bit hashes stand for n-grams.

Null and empty texts have no n-grams and link with nothing. Texts of fewer than n words are one n-gram.
Rows with equal id are rows of their own; a null id is no component's smallest unless all are null. Whole texts
are taken, however long; ties do not matter, as components do not depend on the order of tests. Other columns,
whatever their names, are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _text
from tallyforge.llm._spark import parts_for, remove, small_batches, written
from tallyforge.llm.components import components

SKETCH = 1 << 18
SLICES = 64
CHUNK, CHUNK_GRAMS = 512, 1 << 22
#: From this many star pairs of one node in a shard on, they leave it packed.
PACK = 32


def distinct_grams(w: _text.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each row in turn, first place of each row and the end)."""
    rows = len(w.first) - 1
    h, at = w.grams(n)
    doc = w.doc[at]
    short = np.flatnonzero((np.diff(w.first) < n) & (np.diff(w.first) > 0))
    if len(short):
        h = np.concatenate([h, _text._rolling(w.hash, w.first[short], w.first[short + 1])])
        doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    return h, np.searchsorted(doc, np.arange(rows + 1))


def node_of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit name of each set; 0 is the empty set."""
    n = np.diff(first)
    c, d = np.zeros(len(h) + 1, np.uint64), np.zeros(len(h) + 1, np.uint64)
    np.cumsum(_text.mix(h), out=c[1:])
    np.cumsum(_text.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=d[1:])
    got = _text.mix((c[first[1:]] - c[first[:-1]]) ^ _text.mix((d[first[1:]] - d[first[:-1]]) + n.astype(np.uint64)))
    return np.where(n > 0, got, 0).view(np.int64)


@dataclass
class Band:
    """Segments m, of which the first `double` have weight 2, and the number of skips e."""

    m: int
    double: int
    skip: int


class Scheme:
    """Bands of sizes for threshold t: sets that may link are in the same or in neighbouring bands."""

    def __init__(self, t: float, counts: dict[int, int], key_cost: float = 1.0, pair_cost: float = 3.0, chance: float = 0.02, common: float = 0.0):
        self.t, self.chance, self.common = t, chance, common
        self.edges = [1]
        top = max(counts, default=1)
        while self.edges[-1] <= top:
            self.edges.append(math.floor(self.edges[-1] / t + 1e-9) + 1)
        sizes = np.array(sorted(counts), np.int64)
        band = np.searchsorted(self.edges, sizes, "right") - 1
        held = np.bincount(band, weights=[counts[int(s)] for s in sizes], minlength=len(self.edges)) if len(sizes) else np.zeros(len(self.edges))
        self.bands = [self._best(k, held[k] + (held[k - 1] if k else 0), key_cost, pair_cost) for k in range(len(self.edges) - 1)]

    def most_different(self, k: int) -> int:
        hi = self.edges[k + 1] - 1
        return math.floor((1 - self.t) / (1 + self.t) * 2 * hi + 1e-9)

    def _best(self, k: int, sets: float, key_cost: float, pair_cost: float) -> Band | None:
        u, size = self.most_different(k), (self.edges[k] + self.edges[k + 1] - 1) / 2
        if u == 0:
            return None  # only equal sets can link, and they are one node
        best = (math.inf, None)
        for double in sorted({0, 1, (u + 1) // 2, (u + 2) // 2}):
            for e in sorted({round(u * x) + more for x in (0, 0.05, 0.1, 0.2) for more in (0, 1, 2, 3, 5, 8)}):
                m = u + 1 - double + 2 * e
                if m < 1 or double > m or e > m - double:
                    continue
                lam = size / m
                keys = (m - e) + double * lam
                # Segments without a rare n-gram agree by themselves (a set keeps those beyond its skips), and
                # so do segments of weight 2 with at most one: they make large buckets of unlike sets.
                rare = lam * (1 - self.common)
                bare = excess((m - double) * math.exp(-rare), e) / max(1, m - double)
                large = (m - double) * bare * bare + double * (math.exp(-rare) * (1 + rare)) ** 2
                same = sum(math.exp(-lam) * lam**j / math.factorial(j) * self.chance**j for j in range(1, 12))
                alike = (m - double) * same + double * lam * self.chance ** max(1, lam - 1)
                cost = sets * keys * key_cost + sets * sets / 2 * pair_cost * (alike + 100 * large)
                if cost < best[0]:
                    best = (cost, Band(m, double, e))
        return best[1]

    def band_of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, "right") - 1


def excess(mean: float, e: int) -> float:
    """The expected number beyond e of events that come by this mean (Poisson)."""
    top = int(mean + 12 * math.sqrt(mean) + 20)
    return sum((k - e) * math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(e + 1, max(top, e + 20))) if mean > 0 else 0.0


def common_share(sketch: np.ndarray, sets: int, often: float = 0.005) -> float:
    """The share of n-grams that more than `often` of all sets hold, by the sketch."""
    c = sketch - sketch.mean()
    return float(np.clip(c[c > max(2.0, often * sets)].sum() / max(1.0, sketch.sum()), 0, 0.5))


def shared_chance(sketch: np.ndarray, sets: int) -> float:
    """The chance that a set holds an n-gram drawn from another, less what the sketch adds by collisions."""
    c = sketch.astype(float)
    mean = (c * c).sum() / max(1.0, c.sum()) - c.mean()
    return float(min(0.5, max(1e-4, mean / max(1, sets))))


def signatures(h: np.ndarray, first: np.ndarray, scheme: Scheme, sketch: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row of each key) in the scheme of each row's own band and of the next larger one."""
    n = np.diff(first)
    band = scheme.band_of(np.maximum(n, 1))
    keys, owner = [], []
    cost = sketch[(h & np.uint64(SKETCH - 1)).astype(np.int64)] if sketch is not None else np.ones(len(h), np.int64)
    spot, value = _text.mix(h ^ np.uint64(0x5851F42D4C957F2D)), _text.mix(h)
    low, high = (value & np.uint64(0xFFFFFFFF)).astype(float), (value >> np.uint64(32)).astype(float)
    for up in (0, 1):
        own = np.minimum(band + up, len(scheme.bands) - 1) if len(scheme.bands) else band
        known = [scheme.bands[k] if (band[i] + up) < len(scheme.bands) and n[i] else None for i, k in enumerate(own)]
        m = np.array([b.m if b else 0 for b in known], np.int64)
        double = np.array([b.double if b else 0 for b in known], np.int64)
        skip = np.array([b.skip if b else 0 for b in known], np.int64)
        if not m.sum():
            continue
        base = np.concatenate([[0], np.cumsum(m)])
        row = np.repeat(np.arange(len(n)), n)
        on = m[row] > 0
        where = np.flatnonzero(on)
        r = row[where]
        seg = (spot[where] % m[r].astype(np.uint64)).astype(np.int64)
        at = base[r] + seg
        total = int(base[-1])
        count = np.bincount(at, minlength=total)
        sums = np.bincount(at, weights=low[where], minlength=total).astype(np.uint64) + (np.bincount(at, weights=high[where], minlength=total).astype(np.uint64) << np.uint64(32))
        dear = np.full(total, np.iinfo(np.int64).max)
        np.minimum.at(dear, at, cost[where])
        seg_row = np.repeat(np.arange(len(n)), m)
        seg_no = np.arange(total) - base[seg_row]
        tag = _text.mix(((band[seg_row] + up).astype(np.uint64) << np.uint64(32)) + seg_no.astype(np.uint64))
        name = lambda s, c, k: _text.mix(s + _text.mix(c.astype(np.uint64)) ^ tag[k])
        # Skip the e most costly segments of weight 1: held by most sets, empty ones above all.
        single = seg_no >= double[seg_row]
        order = np.lexsort((-dear, ~single, seg_row))
        place = np.empty(total, np.int64)
        place[order] = np.arange(total) - base[seg_row[order]]
        keep = np.flatnonzero(~single | (place >= skip[seg_row]))
        keys.append(name(sums[keep], count[keep], keep))
        owner.append(seg_row[keep])
        gone = np.flatnonzero(seg < double[r])
        if len(gone):
            k = at[gone]
            keys.append(name(sums[k] - value[where[gone]], count[k] - 1, k))
            owner.append(r[gone])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owner)


def bitmaps(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Of each set, the parity of its n-grams in a bitmap of the least power of two from twice their number on."""
    n = np.diff(first)
    bits = 1 << np.ceil(np.log2(np.maximum(2 * n, 128))).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(n)), n)
    at = base[row] + ((h >> np.uint64(20)).astype(np.int64) & (bits[row] - 1))
    odd = np.packbits((np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8))
    return [odd[a:z].tobytes() for a, z in zip(base[:-1] // 8, base[1:] // 8, strict=True)]


def folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap of `size` bytes (at most its own) of the same set, as 64-bit words."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, "<u8").reshape(-1, size // 8), axis=0)


def most_apart(t: float, n: np.ndarray) -> np.ndarray:
    """The largest difference of two sets of n n-grams together that link."""
    return np.floor((1 - t) / (1 + t) * n + 1e-9)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, node, bits of every row; and each task's sketch in SLICES rows (slice, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "node", "bits", "slice", "counts"]
        got = np.zeros(SKETCH, np.int64)
        for b in batches:
            for lo, hi, w in _text.chunks(b.column(1), lower=True):
                h, first = distinct_grams(w, n)
                got += np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(node_of(h, first)), pa.array(bitmaps(h, first), pa.binary()), pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())], names=names)
        parts = got.reshape(SLICES, -1).astype("<u4")
        empty = pa.nulls(SLICES, pa.int64())
        yield pa.record_batch([empty, empty, empty, pa.nulls(SLICES, pa.binary()), pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, bits binary, slice int, counts binary")


def _sketch(slices: DataFrame) -> np.ndarray:
    """How many rows hold an n-gram with the same low bits, over all rows; SKETCH numbers."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<u4").astype(np.int64) for x in t.column("counts").to_pylist())
        return pa.table([t.column("slice").slice(0, 1), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["slice", "counts"])

    rows = slices.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()
    out = np.zeros((SLICES, SKETCH // SLICES), np.int64)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["counts"], "<i8")
    return out.ravel()


def _signed(docs: DataFrame, n: int, scheme: Scheme, sketch: np.ndarray, shards: int) -> DataFrame:
    """(shard, keys, own, nodes): packed signatures, 32 bits of each key and the place of its node in a
    list; false agreements of the short keys are only more candidates. A task sends a node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, _, w in _text.chunks(b.column(1), lower=True):
                h, first = distinct_grams(w, n)
                node = node_of(h, first)
                new = []
                for i, x in enumerate(node.tolist()):
                    if x and x not in seen:
                        seen.add(x)
                        new.append(i)
                if not new:
                    continue
                pick = np.concatenate([np.arange(first[i], first[i + 1]) for i in new])
                own = np.concatenate([[0], np.cumsum(np.diff(first)[new])])
                key, row = signatures(h[pick], own, scheme, sketch)
                nodes, out = node[new], []
                for s, i in _text.split_by(((key >> np.uint64(40)) % np.uint64(shards)).astype(np.int64), shards):
                    here, at = np.unique(row[i], return_inverse=True)
                    kind = "<u2" if len(here) <= 1 << 16 else "<u4"
                    out.append((s, (key[i] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), at.astype(kind).tobytes(), nodes[here].astype("<i8").tobytes()))
                if not out:  # sets of bands in which only equal sets link
                    continue
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "keys", "own", "nodes"])

    return docs.mapInArrow(run, "shard int, keys binary, own binary, nodes binary")


def _buckets(t: pa.Table, parts: int = 1) -> pa.Table:
    """Of a shard: star pairs (a, b, times), and buckets of three nodes or more, each once, in pieces of CHUNK
    nodes (list, piece, nodes). A node that leads PACK pairs or more tells them in one row for each part of the hash
    space (a, piece, nodes b, often: their times), so rows do not multiply with the signatures of a large group."""
    key = np.concatenate([np.frombuffer(x, "<u4") for x in t.column("keys").to_pylist()])
    lists = [np.frombuffer(x, "<i8") for x in t.column("nodes").to_pylist()]
    node = np.concatenate([x[np.frombuffer(o, "<u2" if len(x) <= 1 << 16 else "<u4")] for x, o in zip(lists, t.column("own").to_pylist(), strict=True)])
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[fresh], node[fresh]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(start, len(key)))
    lead = np.repeat(node[start], n)
    other = np.ones(len(key), bool)
    other[start] = False
    a, b = lead[other], node[other]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    times = np.diff(np.append(at, len(a)))
    name = _text.mix(np.add.reduceat(_text.mix(node), start) + n.astype(np.uint64)).view(np.int64)
    _, once = np.unique(name, return_index=True)
    pieces = [(int(name[k]), p, node[start[k] + p * CHUNK : start[k] + min(n[k], (p + 1) * CHUNK)].astype("<i8").tobytes()) for k in once[n[once] > 2] for p in range(-(-int(n[k]) // CHUNK))]
    a, b = a[at], b[at]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else at
    many = np.repeat(np.diff(np.append(first, len(a))), np.diff(np.append(first, len(a)))) >= PACK
    part = (_text.mix(b[many].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((b[many], part, a[many]))
    pa_, pb, pt, part = a[many][order], b[many][order].astype("<i8"), times[many][order].astype("<i8"), part[order]
    cut = np.flatnonzero(np.append(True, (pa_[1:] != pa_[:-1]) | (part[1:] != part[:-1]))) if len(pa_) else np.zeros(0, np.int64)
    ends = np.append(cut, len(pa_))[1:]
    few = (~many).nonzero()[0]
    none, more, packs = [None] * len(few), [None] * len(pieces), [None] * len(cut)
    return pa.table(
        [
            pa.array(a[few].tolist() + more + pa_[cut].tolist(), pa.int64()), pa.array(b[few].tolist() + more + packs, pa.int64()), pa.array(times[few].tolist() + more + packs, pa.int64()),
            pa.array(none + [x[0] for x in pieces] + packs, pa.int64()), pa.array(none + [x[1] for x in pieces] + part[cut].tolist(), pa.int32()),
            pa.array(none + [x[2] for x in pieces] + [pb[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()), pa.array(none + more + [pt[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()),
        ],
        names=["a", "b", "times", "list", "piece", "nodes", "often"],
    )


def _merged(t: pa.Table) -> pa.Table:
    """a, b, times of the packed pairs of one leading node and part, each pair once."""
    b, often = (np.concatenate([np.frombuffer(x, "<i8") for x in t.column(c).to_pylist()]) for c in ("nodes", "often"))
    b, at = np.unique(b, return_inverse=True)
    times = np.bincount(at, weights=often).astype(np.int64)
    return pa.table([pa.array(np.full(len(b), t.column("a")[0].as_py(), np.int64)), pa.array(b), pa.array(times)], names=["a", "b", "times"])


def _near(pairs: DataFrame, bits: DataFrame, t: float) -> DataFrame:
    """a, b, times and far (the distance of their bitmaps) of the pairs that sizes and bitmaps let pass."""
    up, down = round(t * 10000), 10000
    one = bits.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    two = bits.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * down >= F.greatest("na", "nb") * up)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = np.zeros(len(b), np.int64)
            for k, (x, y) in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)):
                size = min(len(x), len(y))
                far[k] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()
            ok = pa.array(far <= most_apart(t, b.column("n").to_numpy()))
            yield pa.record_batch([*(b.column(c).filter(ok) for c in ("a", "b", "times")), pa.array(far).filter(ok)], names=["a", "b", "times", "far"])

    return both.select("a", "b", "times", (F.col("na") + F.col("nb")).alias("n"), "x", "y").mapInArrow(run, "a long, b long, times long, far long")


def _blobs(docs: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """node, n, grams of one row of each node in reps (node, rep: a row's id or null)."""
    ids = reps.select(F.col("rep").alias("_rep")).distinct()
    one = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, w in _text.chunks(b.column(1), lower=True):
                h, first = distinct_grams(w, n)
                grams = pa.array([h[a:z].astype("<u8").tobytes() for a, z in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.record_batch([pa.array(node_of(h, first)), pa.array(np.diff(first)), grams], names=["node", "n", "grams"])

    got = one.select("doc_id", "text").mapInArrow(run, "node long, n long, grams binary")
    return got.join(reps.select("node"), "node", "left_semi").dropDuplicates(["node"])


def linked(x: np.ndarray, y: np.ndarray, t: float) -> bool:
    """Whether two sets have a Jaccard of t or more."""
    both = np.concatenate([x, y])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 10000 * same >= round(t * 10000) * (len(both) - same)


def _verified(pairs: DataFrame, blobs: DataFrame, t: float) -> DataFrame:
    """Pairs (a, b) whose sets have at least Jaccard t: exact."""
    up, down = round(t * 10000), 10000
    left = blobs.select(F.col("node").alias("a"), F.col("grams").alias("x"), F.col("n").alias("na"))
    right = blobs.select(F.col("node").alias("b"), F.col("grams").alias("y"), F.col("n").alias("nb"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").where(F.least("na", "nb") * down >= F.greatest("na", "nb") * up)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                ok.append(linked(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), t))
            ok = pa.array(ok, pa.bool_())
            yield pa.record_batch([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _mixed(lists: DataFrame, labels: DataFrame, kinds: DataFrame) -> DataFrame:
    """list, ca, co, node, label, other: buckets whose nodes lie in several components, dealt in chunks. A node
    outside its bucket's largest component (other) meets every chunk ca of the bucket in its own chunk co of others."""
    at = lists.join(labels, "node", "left").join(kinds.select("node", "n"), "node").select("list", "node", "n", F.coalesce("label", "node").alias("label"))
    per = at.groupBy("list", "label").agg(F.count("*").alias("k"), F.sum("n").alias("grams"))
    per = per.groupBy("list").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("k", "label")).alias("top"), F.max("k").alias("top_k"), F.sum("k").alias("k"), F.sum("grams").alias("grams"))
    per = per.where("labels > 1").select("list", "top", F.greatest(F.ceil(F.col("k") / CHUNK), F.ceil(F.col("grams") / CHUNK_GRAMS)).alias("parts"), F.greatest(F.ceil((F.col("k") - F.col("top_k")) / CHUNK), F.ceil((F.col("k") - F.col("top_k")) / F.col("k") * F.col("grams") / CHUNK_GRAMS)).alias("others"))
    rows = at.join(per, "list")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    whole = rows.withColumn("ca", mine("parts")).withColumn("co", each("others")).withColumn("other", F.lit(False))
    other = rows.where("label <> top").withColumn("co", mine("others")).withColumn("ca", each("parts")).withColumn("other", F.lit(True))
    columns = ["list", "ca", "co", "node", "label", "other"]
    return whole.select(*columns).unionByName(other.select(*columns))


def _passing(n: np.ndarray, label: np.ndarray, other: np.ndarray, bits: list[bytes], t: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, j, far): for each other i, the places j in the chunk of nodes of other components that it may link with."""
    size = min(map(len, bits))
    m = np.stack([folded(x, size) for x in bits])
    whole = np.flatnonzero(~other)
    for i in np.flatnonzero(other):
        j = whole[label[whole] != label[i]]
        j = j[np.minimum(n[j], n[i]) * 10000 >= np.maximum(n[j], n[i]) * round(t * 10000)]
        far = np.bitwise_count(m[j] ^ m[i]).sum(1).astype(np.int64)
        ok = far <= most_apart(t, n[j] + n[i])
        if ok.any():
            yield int(i), j[ok], far[ok]


def _nearest(mixed: DataFrame, kinds: DataFrame, t: float) -> DataFrame:
    """list, ca, co, node, label, other of the nodes that may link in their chunk, and for each other its nearest
    there (near)."""

    def run(g: pa.Table) -> pa.Table:
        node, label, other, n = (g.column(c).to_numpy() for c in ("node", "label", "other", "n"))
        near, hit = np.zeros(len(node), np.int64), np.zeros(len(node), bool)
        for i, j, far in _passing(n, label, other, g.column("bits").to_pylist(), t):
            near[i], hit[i], hit[j] = node[j[far.argmin()]], True, True
        g = g.select(["list", "ca", "co", "node", "label", "other"]).append_column("near", pa.array(near, mask=~(other & hit)))
        return g.filter(pa.array(hit))

    rows = mixed.join(kinds.select("node", "n", "bits"), "node")
    return rows.groupBy("list", "ca", "co").applyInArrow(run, "list long, ca int, co int, node long, label long, other boolean, near long")


def _decided(rows: DataFrame, labels: DataFrame, blobs: DataFrame, t: float) -> DataFrame:
    """Links (a, b) that join components, of the nodes that may link in a chunk: exact, on whole sets."""

    def run(g: pa.Table) -> pa.Table:
        node, label, other, n = (g.column(c).to_numpy() for c in ("node", "label", "other", "n"))
        grams = [np.frombuffer(x, "<u8") for x in g.column("grams").to_pylist()]
        first = np.concatenate([[0], np.cumsum([len(x) for x in grams])])
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = x = up.get(up[x], up[x])
            return x

        a, b = [], []
        for i, j, far in _passing(n, label, other, bitmaps(np.concatenate(grams), first), t):
            for k in j[np.argsort(far, kind="stable")]:
                x, y = root(int(label[i])), root(int(label[k]))
                if x != y and linked(grams[i], grams[k], t):
                    up[max(x, y)] = min(x, y)
                    a.append(min(node[i], node[k]))
                    b.append(max(node[i], node[k]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    now = rows.drop("label", "near").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = now.groupBy("list", "ca", "co").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").drop("lo", "hi")
    return now.join(apart, ["list", "ca", "co"]).join(blobs, "node").groupBy("list", "ca", "co").applyInArrow(run, "a long, b long").distinct()


def join(docs: DataFrame, t: float = 0.85, n: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rows, links). rows: doc_id, n_shingles, node (0: no n-grams), component_id. links: pairs of nodes
    verified; with equal sets in one node they connect just what Jaccard >= t connects."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = written(_sets(docs, n), "sets")
    sketch = _sketch(made.where("counts is not null").select("slice", "counts"))
    rows = made.where("counts is null").select("doc_id", "n_shingles", "node", "bits")
    kinds = written(rows.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits")), "nodes")
    # Sizes of sets: bounded by the longest text, not by the number of rows.
    counts = {r["n"]: r["count"] for r in kinds.groupBy("n").count().collect()}
    sets = sum(counts.values())
    scheme = Scheme(t, counts, chance=shared_chance(sketch, sets), common=common_share(sketch, sets))
    shards = parts_for(spark, 5 * sum(k * v for k, v in counts.items()))
    signed = _signed(docs, n, scheme, sketch, shards).repartition(shards, "shard")
    parts = max(1, shards // 8)
    found = written(signed.groupBy("shard").applyInArrow(lambda g: _buckets(g, parts), "a long, b long, times long, list long, piece int, nodes binary, often binary"), "buckets")
    packed = found.where("often is not null").select("a", "piece", "nodes", "often").groupBy("a", "piece").applyInArrow(_merged, "a long, b long, times long")
    pairs = found.where("b is not null").select("a", "b", "times").unionByName(packed)
    stars = written(_near(pairs.groupBy("a", "b").agg(F.sum("times").alias("times")), kinds, t), "stars")

    def sets_of(nodes: DataFrame) -> DataFrame:
        return written(_blobs(docs, kinds.join(nodes.distinct(), "node", "left_semi").select("node", "rep"), n), "grams")

    def labelled(links: DataFrame) -> DataFrame:
        return written(components(links), "labels")

    ends = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node")))
    blobs = sets_of(ends)
    best = stars.groupBy("b").agg(F.max_by("a", F.struct(-F.col("far"), "times", "a")).alias("a"))
    links = written(_verified(best, blobs, t), "links")
    labels = labelled(links)
    other = stars.join(best, ["a", "b"], "left_anti").select("a", "b")
    for c in ("a", "b"):
        other = other.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")), c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", c))
    links = links.unionByName(written(_verified(other.where("la <> lb"), blobs, t), "links"))
    labels = labelled(links)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = [np.frombuffer(x, "<i8") for x in b.column(1).to_pylist()]
            for lo in range(0, len(nodes), 64):
                part = nodes[lo : lo + 64]
                yield pa.record_batch([b.column(0).take(pa.array(np.repeat(np.arange(lo, lo + len(part)), [len(x) for x in part]))), pa.array(np.concatenate(part))], names=["list", "node"])

    lists = found.where("list is not null").select("list", "piece", "nodes").dropDuplicates(["list", "piece"]).drop("piece").mapInArrow(opened, "list long, node long")
    near = written(_nearest(_mixed(lists, labels, kinds), kinds, t), "near")
    sets = sets_of(near.select("node"))
    pairs = near.where("near is not null").select(F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b")).distinct()
    links = links.unionByName(written(_verified(pairs.join(stars, ["a", "b"], "left_anti"), sets, t), "links"))
    labels = labelled(links)
    rest = written(_decided(near, labels, sets, t), "links")
    if not rest.isEmpty():
        links = links.unionByName(rest)
        labels = labelled(links)
    for table in (found, stars, blobs, near, sets):  # the result reads none of them
        remove(table)
    named = kinds.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select("node", "component_id")
    out = rows.join(named, "node", "left").withColumn("component_id", F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "node", "component_id"), links


def oracle_sql(t100: int = 85, n: int = 4) -> str:
    """Components in DuckDB: distinct sets, pairs that share an n-gram, then the closure of their links."""
    lead = ", ".join(f"list_extract(w, (i + {k})::BIGINT)" for k in range(n))
    return f"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: concat_ws(' ', {lead}))) END AS g FROM t),
k AS (SELECT min(doc_id) AS rep, list_sort(g) AS g FROM s WHERE len(g) > 0 GROUP BY list_sort(g)),
e AS (SELECT rep, unnest(g) AS x, len(g) AS n FROM k),
c AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {t100} * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * shared >= {t100} * (na + nb - shared)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT rep, rep FROM k),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
m AS (SELECT a AS rep, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN k ON len(s.g) > 0 AND k.g = list_sort(s.g) LEFT JOIN m ON m.rep = k.rep
"""
