"""Packing: token sequences of a fixed window by non-negative least squares.

A document is its byte-pair ids and one end id. Full windows of a long document are sequences of their
own. Of the remainders, the histogram of lengths (at most window - 1 numbers, over all documents) goes to
the driver; there, combinations of two or three lengths that fill the window are enumerated, their repeat
counts are solved by non-negative least squares against the histogram and rounded down, and remainders
get their places by rank within their length. What is left is packed greedily, one remainder after the
other, cut where a sequence is full.

Null and empty texts are the end id alone; whole texts are taken, however long. Special tokens written in a text
are their own ids. Repeated rows and ids, and null ids, are packed row by row; equal lengths tie, and which of
them shares a sequence with which has no meaning. Other columns, whatever their names, are not carried; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm._spark import small_batches, written

WINDOW = 2048
END_ID = 1
CACHE = 400_000
#: Next to such spaces, pieces of the pattern may reach over the space.
_ODD = re.compile(r"\s\s|^\s|\s$")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Ids(dict):
    """Ids of texts as little-endian 32-bit bytes, as the tokenizer in path gives them. A single space between two
    other characters always begins a piece of the pattern, so ' word' is encoded once and looked up after that; the
    same vocabulary as ranks, beside path, does that with less work. Texts that hold a special token are encoded by
    the tokenizer itself, and the token is its own id there."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(re.sub(r"\.json$", ".tiktoken", path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.encode = lambda text: np.array(fast(text), "<u4").tobytes()
        self.whole = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        special = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or r"(?!)")

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[word] = got = self.encode(" " + word)
        return got

    def of(self, text: str) -> bytes:
        if self.special.search(text):
            return self.whole(text)
        if _ODD.search(text):
            return self.encode(text)
        first, _, rest = text.partition(" ")
        head = self.encode(first)
        return head + b"".join(map(self.__getitem__, rest.split(" "))) if rest else head


_ids: dict[str, Ids] = {}


def tokenised(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """uid, doc_id, doc_tokens, full (crc32 of each full window), rem_len, rem_crc, rem (16-bit ids)."""
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids.setdefault(path, None) or _ids.__setitem__(path, Ids(path)) or _ids[path]
        for b in batches:
            rows: list[tuple] = []
            for text in b.column(2).to_pylist():
                x = ids.of(text or "") + end
                n = len(x) // 4
                cut = n // window * window * 4
                full = [zlib.crc32(x[k : k + 4 * window]) for k in range(0, cut, 4 * window)]
                rows.append((n, full, n % window, zlib.crc32(x[cut:]), np.frombuffer(x[cut:], "<u4").astype("<u2").tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary()]
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=["uid", "doc_id", "doc_tokens", "full", "rem_len", "rem_crc", "rem"])

    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "uid long, doc_id long, doc_tokens long, full array<long>, rem_len int, rem_crc long, rem binary")


def combinations(hist: np.ndarray, window: int = WINDOW, common: int = 64) -> list[tuple[int, ...]]:
    """Pairs of lengths that fill the window, and triples whose first two are among the most common."""
    have = hist > 0
    out = {(a, window - a) for a in range(window // 2, window) if have[a] and have[window - a]}
    top = [int(x) for x in np.argsort(-hist, kind="stable")[:common] if hist[x]]
    for i, a in enumerate(top):
        for b in top[i:]:
            c = window - a - b
            if c > 0 and have[c]:
                out.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(out)


def solve(hist: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares min |A x - hist| by cyclic coordinate descent: a column of A has the
    multiplicities of a combination."""
    left, x = hist.astype(float).copy(), np.zeros(len(combos))
    cols = [np.unique(c, return_counts=True) for c in combos]
    norm = [float((m * m).sum()) for _, m in cols]
    for _ in range(sweeps):
        moved = 0.0
        for j, (l, m) in enumerate(cols):
            step = max(-x[j], float(left[l] @ m) / norm[j])
            if step:
                x[j] += step
                left[l] -= step * m
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Combinations and whole repeat counts that never use more of a length than there is."""
    combos = combinations(hist, window)
    x = np.floor(solve(hist, combos) + 1e-9).astype(np.int64)
    left = hist.astype(np.int64).copy()
    for j in np.argsort(-x, kind="stable"):
        l, m = np.unique(combos[j], return_counts=True)
        x[j] = max(0, min(x[j], int((left[l] // m).min())))
        left[l] -= x[j] * m
    keep = x > 0
    return [c for c, k in zip(combos, keep, strict=True) if k], x[keep]


def _slots(combos: list[tuple[int, ...]], repeats: np.ndarray, window: int) -> tuple[dict[int, list[np.ndarray]], np.ndarray]:
    """Of each length: first ranks, first sequence numbers and offsets of its slots; and the used counts."""
    used, out, base = np.zeros(window + 1, np.int64), {}, 0
    for c, x in zip(combos, repeats, strict=True):
        at = 0
        for l in c:
            out.setdefault(l, []).append((used[l], base, at))
            used[l] += x
            at += l
        base += int(x)
    return {l: [np.array(v, np.int64) for v in zip(*s, strict=True)] for l, s in out.items()}, used


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECE = [x.split()[0] for x in PIECE.split(", ")]


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """PIECE rows: each id of each document in exactly one piece, sequences without gaps."""
    spark = docs.sparkSession
    table = written(tokenised(docs, vocabulary, window), "tokens")
    hist = np.zeros(window + 1, np.int64)
    for r in table.where("rem_len > 0").groupBy("rem_len").count().collect():  # at most window - 1 rows
        hist[r["rem_len"]] = r["count"]
    combos, repeats = plan(hist, window)
    slots, used = _slots(combos, repeats, window)
    n_combo = int(repeats.sum())

    part = F.shiftright("uid", 33)  # the input partition: its rows are bounded by a split
    per = table.where("rem_len > 0").groupBy("rem_len", part.alias("part")).count()
    before = per.select("rem_len", "part", F.coalesce(F.sum("count").over(Window.partitionBy("rem_len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = table.where("rem_len > 0").select("uid", part.alias("part"), "doc_id", "doc_tokens", "rem_len", "rem_crc")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("rem_len", "part").orderBy("uid")) - 1).join(before, ["rem_len", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before")
    n_used = F.element_at(F.array(*(F.lit(int(x)) for x in used)), F.col("rem_len") + 1)
    rest_uid = written(ranked.withColumn("rest", F.col("rank") >= n_used), "ranks")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            l, rank = b.column("rem_len").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(l), np.int64), np.zeros(len(l), np.int64)
            for one in np.unique(l):
                on = np.flatnonzero(l == one)
                first, base, at = slots[int(one)]
                k = np.searchsorted(first, rank[on], "right") - 1
                seq[on], off[on] = base[k] + rank[on] - first[k], at[k]
            tokens = b.column("doc_tokens").to_numpy()
            yield pa.record_batch([b.column("doc_id"), pa.array(tokens - l), pa.array(l.astype(np.int64)), b.column("rem_crc"), b.column("doc_tokens"), pa.array(seq), pa.array(off)], names=_PIECE)

    placed = rest_uid.where("not rest").mapInArrow(place, PIECE)

    # Prefix sums by input partition: one row for each partition is windowed without a key.
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    n_full = table.groupBy(part.alias("part")).agg(F.sum(F.size("full")).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0)))
    full = table.where(F.size("full") > 0).select("uid", part.alias("part"), "doc_id", "doc_tokens", "full")
    mine = Window.partitionBy("part").orderBy("uid")
    full = full.withColumn("seq", F.sum(F.size("full")).over(mine) - F.size("full")).join(n_full.select("part", "before"), "part")
    full = full.select("doc_id", "doc_tokens", (F.col("seq") + F.col("before") + n_combo).alias("seq"), F.posexplode("full").alias("k", "crc"))
    full = full.select("doc_id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("seq") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    total = table.agg(F.sum(F.size("full"))).first()[0] or 0

    rest = rest_uid.where("rest").select("uid", "part", "rem_len")
    n_rest = rest.groupBy("part").agg(F.sum("rem_len").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0)))
    rest = rest.withColumn("at", F.sum("rem_len").over(mine) - F.col("rem_len")).join(n_rest.select("part", "before"), "part").select("uid", (F.col("at") + F.col("before")).alias("at"))
    first = n_combo + total

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, tokens, at, rem in zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "at", "rem")), strict=True):
                ids = np.frombuffer(rem, "<u2").astype("<u4")
                k = 0
                while k < len(ids):
                    n = min(len(ids) - k, window - (at + k) % window)
                    rows.append((doc, tokens - len(ids) + k, n, zlib.crc32(ids[k : k + n].tobytes()), tokens, first + (at + k) // window, (at + k) % window))
                    k += n
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in cols], names=_PIECE)

    cuts = table.select("uid", "doc_id", "doc_tokens", "rem").join(rest, "uid").select("doc_id", "doc_tokens", "at", "rem").mapInArrow(cut, PIECE)
    return placed.unionByName(full).unionByName(cuts)


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """sequence_id, used, padding: sequences are padded to the window unless a power of two is filled."""
    got = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    power = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    return got.withColumn("padding", F.when(power, F.lit(0)).otherwise(window - F.col("used")))
