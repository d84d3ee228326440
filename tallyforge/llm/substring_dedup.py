"""Substring dedup: an FM-index per shard, searched backwards for matching statistics.

A word is removed if a window of `width` words covers it that also starts in a document with a smaller id.
Windows go to shards by content: the least hash among their 4-word pieces names the shard, so equal windows
meet in one shard, and neighbouring windows mostly go together as one passage. Before that, fingerprints
of windows (32 bits besides the shard) find which occur at all more than once; others need no index. That
filter only leaves out what is unique: which windows repeat, and where first, the FM-index decides. A
shard indexes each distinct passage once, with its smallest id, searches all of them backwards, and takes
the smallest id in the interval of every window whose match is full.

Documents are dealt to buckets by hash; shards answer a bucket's distinct passages in order, so what is
sent follows the bucket's distinct content, however many copies a passage has. Null and empty texts have no
words. Null ids come before all others; rows of equal id do not remove each other's words. Other columns
are not carried; an empty table gives an empty result. Words are known by 48 bits of their hash within a shard.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _text
from tallyforge.llm._spark import parts_for, release, small_batches, text_bytes, written
from tallyforge.llm.fm_index import FMIndex

WIDTH = 13
PIECE = 4
#: Text that one Python call holds as words, and text whose windows one shard judges.
BUCKET_BYTES, SHARD_BYTES = 5 << 20, 24 << 20
_NULL = np.iinfo(np.int64).min


class _Bucket:
    """Words of a bucket's rows, and hashes of their windows."""

    def __init__(self, t: pa.Table, width: int):
        hashes, rows, windows, places, pieces, done, base = [], [], [], [], [], 0, 0
        for b in t.select(["text"]).to_batches():
            for lo, _, w in _text.chunks(b.column(0)):
                hashes.append(w.hash)
                rows.append(w.doc + (base + lo))
                g, at = w.grams(width)
                windows.append(g)
                places.append(at + done)
                piece, at = w.grams(PIECE)
                own = np.full(len(w.hash), np.iinfo(np.uint64).max, np.uint64)
                own[at] = piece
                pieces.append(own)
                done += len(w.hash)
            base += len(b)
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.width = width
        rows = [r.astype(np.int32) for r in rows]
        self.hash, self.row = cat(hashes, np.uint64), cat(rows, np.int64)
        self.window, self.at = cat(windows, np.uint64), cat(places, np.int64)
        self.piece = cat(pieces, np.uint64)
        self.kinds, self.kind_of, self.often = np.unique(self.window, return_inverse=True, return_counts=True)

    def shard(self, shards: int) -> np.ndarray:
        """The shard of each window: by the least of its pieces."""
        least, n = self.piece.copy(), 1
        need = self.width - PIECE + 1
        while n < need:
            step = min(n, need - n)
            least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
            n += step
        return (_text.mix(least[self.at]) % np.uint64(shards)).astype(np.int64)

    def passages(self, repeated: np.ndarray, ids: np.ndarray, shards: int) -> None:
        """Runs of neighbouring repeated windows of one shard; each content once, with its smallest id."""
        on = np.flatnonzero(repeated[self.kind_of])
        shard, at = self.shard(shards)[on], self.at[on]
        row = self.row[at]
        first = np.ones(len(on), bool)
        first[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])
        start = np.flatnonzero(first)
        self.run_n = np.diff(np.append(start, len(on)))
        self.run_at, self.run_shard, self.run_row = at[start], shard[start], row[start]
        content = _text._rolling(self.hash, self.run_at, self.run_at + self.run_n + self.width - 1)
        _, self.one, self.same = np.unique(content, return_index=True, return_inverse=True)
        self.smallest = np.full(len(self.one), np.iinfo(np.int64).max)
        np.minimum.at(self.smallest, self.same, ids[self.run_row])
        self.of_shard = _text.split_by(self.run_shard[self.one], shards)


def _ids(t: pa.Table) -> np.ndarray:
    return t.column("doc_id").combine_chunks().fill_null(_NULL).to_numpy()


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., for n[0] numbers, and so on."""
    total = int(n.sum())
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(total) if total else np.zeros(0, np.int64)


def _spot(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


_REPLY = "bucket int, kind int, shard int, reply binary"


def _repeated(rows: DataFrame, shards: int, width: int) -> DataFrame:
    """Replies of kind 0: a bit for each distinct window of a bucket, in order: it may occur again."""

    def ask(t: pa.Table) -> pa.Table:
        b = _Bucket(t, width)
        out = _text.split_by(_spot(b.kinds, shards), shards)
        bucket = t.column("bucket")[0].as_py()
        return pa.table([pa.array([s for s, _ in out], pa.int32()), pa.array([bucket] * len(out), pa.int32()), pa.array([(b.kinds[i] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() for _, i in out], pa.binary()), pa.array([np.packbits(b.often[i] > 1).tobytes() for _, i in out], pa.binary())], names=["shard", "bucket", "prints", "often"])

    def answer(t: pa.Table) -> pa.Table:
        prints = [np.frombuffer(x, "<u4") for x in t.column("prints").to_pylist()]
        often = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(t.column("often").to_pylist(), prints, strict=True)])
        every = np.concatenate(prints)
        order = np.argsort(every, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(every[order]) != 0))
        n = np.diff(np.append(start, len(every)))
        again = (n > 1) | (np.add.reduceat(often[order].astype(np.int64), start) > 0)
        got = np.empty(len(every), bool)
        got[order] = np.repeat(again, n)
        cut = np.split(got, np.cumsum([len(p) for p in prints])[:-1])
        return pa.table([t.column("bucket"), pa.array([0] * len(prints), pa.int32()), t.column("shard"), pa.array([np.packbits(x).tobytes() for x in cut], pa.binary())], names=["bucket", "kind", "shard", "reply"])

    asked = rows.groupBy("bucket").applyInArrow(ask, "shard int, bucket int, prints binary, often binary")
    return asked.groupBy("shard").applyInArrow(answer, _REPLY)


def _marked(b: _Bucket, got: pa.Table, ids: np.ndarray, shards: int) -> dict[int, bytes]:
    """Applies replies of kind 0 to a bucket; gives those of kind 1 by shard."""
    replies: dict[int, dict[int, bytes]] = {0: {}, 1: {}}
    for kind, shard, reply in zip(*(got.column(c).to_pylist() for c in ("kind", "shard", "reply")), strict=True):
        replies[kind][shard] = reply
    repeated = np.zeros(len(b.kinds), bool)
    for s, i in _text.split_by(_spot(b.kinds, shards), shards):
        repeated[i] = np.unpackbits(np.frombuffer(replies[0][s], np.uint8), count=len(i))
    b.passages(repeated, ids, shards)
    return replies[1]


def _searched(rows: DataFrame, replies: DataFrame, shards: int, width: int) -> DataFrame:
    """Replies of kind 1: the smallest id that has each window of the bucket's distinct passages."""

    def send(t: pa.Table, got: pa.Table) -> pa.Table:
        out = []
        if len(t):
            b, ids = _Bucket(t, width), _ids(t)
            _marked(b, got, ids, shards)
            bucket = t.column("bucket")[0].as_py()
            for s, k in b.of_shard:
                i = b.one[k]
                n = b.run_n[i] + width - 1
                words = (b.hash[_ranges(b.run_at[i], n)] >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                out.append((s, bucket, words.tobytes(), n.astype("<u4").tobytes(), b.smallest[k].astype("<i8").tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["shard", "bucket", "words", "lengths", "ids"])

    def index(t: pa.Table) -> pa.Table:
        words, lengths, ids = [], [], []
        for w, n, d in zip(*(t.column(c).to_pylist() for c in ("words", "lengths", "ids")), strict=True):
            wide = np.zeros((len(w) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(w, np.uint8).reshape(-1, 6)
            words.append(wide.view("<u8").ravel())
            lengths.append(np.frombuffer(n, "<u4").astype(np.int64))
            ids.append(np.frombuffer(d, "<i8"))
        every, n, doc = np.concatenate(words), np.concatenate(lengths), np.concatenate(ids)
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        _, symbol = np.unique(every, return_inverse=True)
        symbol = symbol.astype(np.int64) + 1
        content = _text._rolling(_text.mix(every), start, start + n)
        _, one, same = np.unique(content, return_index=True, return_inverse=True)
        smallest = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(smallest, same, doc)
        # The text of the index: each distinct passage, with a separator after it.
        size = n[one]
        at = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        text = np.zeros(int((size + 1).sum()), np.int64)
        text[_ranges(at, size)] = symbol[_ranges(start[one], size)]
        fm = FMIndex(text, width)
        owner = np.repeat(smallest, size + 1)[fm.order]
        many = size - width + 1
        lo, hi, length = fm.search(text, _ranges(at + width, many))
        least = owner[lo]
        wide = np.flatnonzero((hi - lo > 1) & (length == width))
        if len(wide):
            span, which = np.unique(lo[wide] * (fm.n + 1) + hi[wide], return_inverse=True)
            a, z = span // (fm.n + 1), span % (fm.n + 1)
            parts = np.concatenate([owner, [np.iinfo(np.int64).max]])
            least[wide] = np.minimum.reduceat(parts, np.stack([a, z], 1).ravel())[::2][which]
        base = np.concatenate([[0], np.cumsum(many)[:-1]])
        reply, k = [], 0
        for x in lengths:
            mine = same[k : k + len(x)]
            reply.append(least[_ranges(base[mine], many[mine])].astype("<i8").tobytes())
            k += len(x)
        return pa.table([t.column("bucket"), pa.array([1] * len(reply), pa.int32()), t.column("shard"), pa.array(reply, pa.binary())], names=["bucket", "kind", "shard", "reply"])

    sent = rows.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(lambda a, b: send(a, b), "shard int, bucket int, words binary, lengths binary, ids binary")
    return sent.groupBy("shard").applyInArrow(index, _REPLY)


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, text (the words kept, joined by one space), spans (first word and number of
    words of each removed run) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    size = text_bytes(docs)
    buckets, shards = parts_for(spark, size, BUCKET_BYTES), parts_for(spark, size, SHARD_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"))
    first = written(_repeated(rows, shards, width), "repeated")
    release(spark)
    second = written(_searched(rows, first, shards, width), "searched")
    release(spark)

    def finish(t: pa.Table, got: pa.Table) -> pa.Table:
        b, ids = _Bucket(t, width), _ids(t)
        replies = _marked(b, got, ids, shards)
        least = np.zeros(int(b.run_n[b.one].sum()), np.int64)
        base = np.concatenate([[0], np.cumsum(b.run_n[b.one])[:-1]]).astype(np.int64)
        for s, k in b.of_shard:
            least[_ranges(base[k], b.run_n[b.one[k]])] = np.frombuffer(replies[s], "<i8")
        smallest = least[_ranges(base[b.same], b.run_n)]
        place = _ranges(b.run_at, b.run_n)
        later = place[smallest < np.repeat(ids[b.run_row], b.run_n)]
        edge = np.zeros(len(b.hash) + 1, np.int64)
        np.add.at(edge, later, 1)
        np.subtract.at(edge, later + width, 1)
        gone = np.cumsum(edge[:-1]) > 0
        n = np.bincount(b.row, minlength=len(t))
        removed = np.bincount(b.row[gone], minlength=len(t))
        texts, spans, at = [], [], 0
        for k, x in enumerate(t.column("text").to_pylist()):
            w = (x or "").encode().split()
            if removed[k]:
                mine = gone[at : at + len(w)]
                turn = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                spans.append([{"first": int(p), "words": int(q - p)} for p, q in turn])
                w = compress(w, ~mine)
            else:
                spans.append([])
            texts.append(b" ".join(w).decode())
            at += n[k]
        span = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
        return pa.table([t.column("doc_id"), pa.array(n), pa.array(removed), pa.array(texts, pa.string()), pa.array(spans, span)], names=["doc_id", "n_words", "n_removed", "text", "spans"])

    replies = first.unionByName(second)
    return rows.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(lambda a, b: finish(a, b), "doc_id long, n_words long, n_removed long, text string, spans array<struct<first: long, words: long>>")


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - {WIDTH} + 2)) AS i, w FROM t WHERE len(w) >= {WIDTH}),
k AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {WIDTH} - 1), ' ') AS x FROM g),
m AS (SELECT x, min(doc_id) AS first FROM k GROUP BY x),
l AS (SELECT k.doc_id, k.i FROM k JOIN m ON m.x = k.x AND m.first < k.doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WIDTH})) AS i FROM l),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
a AS (SELECT e.doc_id, count(*) AS n_words, count(c.i) AS n_removed, string_agg(e.word, ' ' ORDER BY e.i) FILTER (WHERE c.i IS NULL) AS kept
      FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.i = e.i GROUP BY e.doc_id)
SELECT t.doc_id, coalesce(a.n_words, 0)::BIGINT AS n_words, coalesce(a.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM t LEFT JOIN a USING (doc_id)
"""
