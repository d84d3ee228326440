"""LM scoring: a gated recurrent language model with class-factored output, in numpy.

Words are counted over all training documents (in shards of the hash space; a task sends each word once).
The model's symbols are the end and all words of at least LEAST occurrences (the `head` most frequent ones in any
case), in classes whose number and sizes balance the cost of a token, and tail classes: the rare words by the octave
of their count, unseen words in a class of their own. The OWN most frequent words have a symbol each; the others of
at least LEAST occurrences share SHARED symbols by their hash, so no list of them is kept, and neither the model nor
what the driver holds grows with the vocabulary. A word's probability is that of its class given the state, times that
of its symbol within the class given the state, times, for shared symbols and tail classes, its smoothed share of
them. So the model is a proper distribution over the words seen in training and one unseen outcome, like the base.
A tail word is trained as if its own occurrence were left out of its count, which is what held-out words meet.

Training is truncated backpropagation through windows, over every training document: copies of the model learn
side by side from shares of the documents, dealt by hash and read in a fixed order, and are averaged by tokens
after each round. A copy learns from TOKENS_A_WEIGHT tokens for each of its weights at least, so what copies send
is a fixed share of the corpus, and neither their number nor the result depends on how the input lies in files.
Scoring runs whole documents; the state is carried across windows and set back only where a document begins.

Null texts count as empty: the end alone; texts are scored whole, however long. Rows are scored each by itself,
repeated or not; the id null hashes as ''. Words of equal counts are ordered by their hashes. Other columns, whatever
their names, are not carried; an empty table gives an empty result. 64-bit hashes stand for words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _text
from tallyforge.llm._spark import parts_for, release, small_batches, text_bytes, written

HEAD, LEAST, HIDDEN, LANES, STEPS, ROUNDS = 2000, 64, 24, 512, 48, 2
TAILS = 44
OWN, SHARED = 12288, 4096
TOKENS_A_WEIGHT = 2
SLICES = 16
ROWS, BLOCK = 1024, 1 << 15
END_HASH = np.uint64(0xE0F0E0F0E0F0E0F1)


def tail_class(c: np.ndarray) -> np.ndarray:
    """0, 1, 2, 3 for these counts, then 4 + octave from 4."""
    c = np.asarray(c, np.int64)
    return np.where(c < 4, c, 2 + np.log2(np.maximum(c, 4)).astype(np.int64))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(SHARED)).astype(np.int64)


def _by_slot(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Types and mass of each slot for these words and counts."""
    k = _slot(h)
    return np.stack([np.bincount(k, minlength=SHARED), np.bincount(k, weights=c, minlength=SHARED).astype(np.int64)])


def _merged(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """One row of rows (w, c, shared): of the words the `most` frequent ones, of the slots the sums."""
    w, c, shared = np.zeros(0, "<i8"), np.zeros(0, "<i8"), np.zeros(2 * SHARED, "<i8")
    for b in batches:
        for x, y, z in zip(*(b.column(k).to_pylist() for k in ("w", "c", "shared")), strict=True):
            w, c = np.append(w, np.frombuffer(x, "<i8")), np.append(c, np.frombuffer(y, "<i8"))
            best = np.lexsort((w, -c))[:most]
            w, c = w[best], c[best]
            shared += np.frombuffer(z, "<i8")
    yield pa.record_batch([pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (w, c, shared)], names=["w", "c", "shared"])


class Vocabulary:
    """What scoring needs of the counts: totals, head words and the masses of tail classes and shared symbols.

    shared: types and mass of all words of at least LEAST occurrences by slot; head words are taken out."""

    def __init__(self, n: int, v: int, head: list[tuple[int, int]], types: np.ndarray, mass: np.ndarray, shared: np.ndarray | None = None):
        self.n, self.v = n, v
        w, self.head = np.array(head, np.int64).reshape(-1, 2).T.copy()
        self.hash = w.view(np.uint64)
        self.order = np.argsort(self.hash)
        self.sorted = self.hash[self.order]
        self.types, self.mass = types.copy(), mass.copy()
        if len(head):
            k = tail_class(self.head)
            np.subtract.at(self.types, k, 1)
            np.subtract.at(self.mass, k, self.head)
        self.slots = np.zeros((2, 0), np.int64)
        if shared is not None:
            often = self.head >= LEAST
            rest = shared - _by_slot(self.hash[often], self.head[often])
            if rest[0].any():
                k = int(tail_class(np.array([LEAST]))[0])  # from here on all words are in slots
                self.slots, self.types[k:], self.mass[k:] = rest, 0, 0
        self.size = TAILS + len(head) + self.slots.shape[1]
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"

    def symbols(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Tail classes first, then head words, then slots."""
        out = tail_class(c)
        if self.slots.size:
            often = c >= LEAST
            out[often] = TAILS + len(self.head) + _slot(h[often])
        if len(self.sorted):
            k = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            hit = self.sorted[k] == h
            out[hit] = TAILS + self.order[k[hit]]
        return out

    def classes(self) -> np.ndarray:
        """Class of each symbol: a tail class is its own; the end and head words by frequency, then slots, with equal
        sums of the roots of their counts. So classes of frequent words are small, which costs least by token."""
        count = np.concatenate([self.head, self.slots[1]])
        root = np.sqrt(count.astype(float))
        n = max(1, math.ceil(root.sum() / math.sqrt(max(1, count.sum()))))
        cls = np.unique((np.cumsum(root) - root) // (max(1.0, root.sum()) / n), return_inverse=True)[1]
        return np.concatenate([np.arange(TAILS), TAILS + cls]).astype(np.int64)

    def prior(self) -> np.ndarray:
        """Expected share of each symbol, tail words with their own occurrence left out of their counts."""
        left = np.zeros(TAILS)
        left[:3], left[4:] = self.mass[1:4], self.mass[4:]
        p = np.concatenate([left, self.head, self.slots[1]]) + 0.5
        return p / p.sum()

    def shares(self) -> np.ndarray:
        """Of each symbol, log10 of what its words' smoothed counts are a share of (0 for head words)."""
        own = np.zeros(len(self.head))
        return np.concatenate([np.log10(np.maximum(self.mass + 0.5 * self.types, 0.5)), own, np.log10(np.maximum(self.slots[1] + 0.5 * self.slots[0], 0.5))])


def _calm(u: np.ndarray, b: np.ndarray) -> bool:
    """Whether no logit of a state (all in -1..1) can be too large or too small for exp in single precision."""
    return math.sqrt(u.shape[1] * np.einsum("ij,ij->i", u, u).max(initial=0)) + np.abs(b).max(initial=0) < 60


def _picked(h: np.ndarray, u: np.ndarray, b: np.ndarray, k: np.ndarray, calm: bool, learn: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of column k of each row in softmax(h @ u + b); with learn, its gradient by the logits."""
    q = h @ u
    q += b
    if not calm:
        q -= q.max(1, keepdims=True)
    rows = np.arange(len(k))
    lp = q[rows, k]
    np.exp(q, out=q)
    total = q @ np.ones(q.shape[1], q.dtype)
    lp -= np.log(total)
    if learn:
        q *= (1 / total)[:, None]
        q[rows, k] -= 1
    return lp, q


class Model:
    """Parameters in one flat vector; w_in: input gates of each symbol; rec: recurrent; out_c, out_s: class and
    within-class output weights and biases. With flat, these are its parameters, not copied."""

    def __init__(self, classes: np.ndarray, prior: np.ndarray, hidden: int = HIDDEN, seed: int = 3, flat: np.ndarray | None = None):
        self.cls, self.h, self.n_sym, self.n_cls = classes, hidden, len(classes), int(classes.max()) + 1
        self.first = np.searchsorted(classes, np.arange(self.n_cls + 1))
        shapes = {"w_in": (self.n_sym, 3 * hidden), "rec": (hidden, 3 * hidden), "b": (hidden,), "uc": (hidden, self.n_cls), "bc": (self.n_cls,), "us": (self.n_sym, hidden), "bs": (self.n_sym,)}
        g = np.random.default_rng(seed)
        self.flat = flat if flat is not None else np.zeros(sum(int(np.prod(s)) for s in shapes.values()), np.float32)
        self.at, k = {}, 0
        for name, s in shapes.items():
            n = int(np.prod(s))
            self.at[name] = (k, k + n, s)
            k += n
        self.use(self.flat)
        if flat is not None:
            return
        self.w_in[:] = g.normal(0, 0.3, self.w_in.shape)
        self.rec[:] = g.normal(0, 1 / np.sqrt(hidden), self.rec.shape)
        mass = np.bincount(classes, weights=prior, minlength=self.n_cls)
        self.bc[:] = np.log(mass)
        self.bs[:] = np.log(prior / mass[classes])
        self.flat = self.flat.copy()
        self.use(self.flat)

    def use(self, flat: np.ndarray) -> None:
        self.flat = flat
        for name, (a, z, s) in self.at.items():
            setattr(self, name, flat[a:z].reshape(s))

    def forward(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """x: input symbols (T, B), fresh: documents begin (state and input are zero)."""
        n, kind = self.h, self.flat.dtype
        on, any_fresh = (~fresh)[:, :, None].astype(kind), fresh.any(1)
        a = self.w_in[x] * on
        prev, zr, m, c, hs = (np.empty((*x.shape, k * n), kind) for k in (1, 2, 1, 1, 1))
        for t in range(len(x)):
            if any_fresh[t]:
                h = h * on[t]
            prev[t] = h
            u = h @ self.rec
            g = zr[t]
            np.add(a[t, :, : 2 * n], u[:, : 2 * n], out=g)
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.add(u[:, 2 * n :], self.b, out=m[t])
            np.multiply(g[:, n:], m[t], out=c[t])
            c[t] += a[t, :, 2 * n :]
            np.tanh(c[t], out=c[t])
            h = c[t] + g[:, :n] * (h - c[t])
            hs[t] = h
        return hs, (prev, zr, m, c, on, any_fresh)

    def outputs(self, hs: np.ndarray, y: np.ndarray, grad: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each symbol y (N) after states hs (N, H); with grad, adds d(-sum log p)."""
        order = np.argsort(self.cls[y], kind="stable")
        hs, y = hs[order], y[order]
        own, learn = self.cls[y], grad is not None
        lp, dh = np.empty(len(y), hs.dtype), np.empty_like(hs) if learn else None
        if learn:
            g = {k: grad[a:z].reshape(s) for k, (a, z, s) in self.at.items()}
        calm = _calm(self.uc.T, self.bc), _calm(self.us, self.bs)
        for lo in range(0, len(y), ROWS):
            i = slice(lo, lo + ROWS)
            lp[i], d = _picked(hs[i], self.uc, self.bc, own[i], calm[0], learn)
            if learn:
                g["uc"] += hs[i].T @ d
                g["bc"] += d.sum(0)
                dh[i] = d @ self.uc.T
        cut = np.searchsorted(own, np.arange(self.n_cls + 1))
        for c in np.flatnonzero(cut[TAILS + 1 :] > cut[TAILS:-1]) + TAILS:
            a, z = self.first[c], self.first[c + 1]
            for lo in range(cut[c], cut[c + 1], ROWS):
                i = slice(lo, min(lo + ROWS, cut[c + 1]))
                p, d = _picked(hs[i], self.us[a:z].T, self.bs[a:z], y[i] - a, calm[1], learn)
                lp[i] += p
                if learn:
                    g["us"][a:z] += d.T @ hs[i]
                    g["bs"][a:z] += d.sum(0)
                    dh[i] += d @ self.us[a:z]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return lp[back], dh[back] if learn else None

    def backward(self, x: np.ndarray, tape: tuple, dhs: np.ndarray, grad: np.ndarray) -> None:
        n, (prev, zr, m, c, on, any_fresh) = self.h, tape
        g = {k: grad[a:z].reshape(s) for k, (a, z, s) in self.at.items()}
        z, r = zr[:, :, :n], zr[:, :, n:]
        of_c, of_z, of_r = (1 - z) * (1 - c * c), (prev - c) * z * (1 - z), m * r * (1 - r)
        du, dc = np.empty((*x.shape, 3 * n), dhs.dtype), np.empty_like(dhs)
        carry, back = np.zeros_like(dhs[0]), np.ascontiguousarray(self.rec.T)
        for t in range(len(x) - 1, -1, -1):
            dh = dhs[t] + carry
            np.multiply(dh, of_c[t], out=dc[t])
            d = du[t]
            np.multiply(dh, of_z[t], out=d[:, :n])
            np.multiply(dc[t], of_r[t], out=d[:, n : 2 * n])
            np.multiply(dc[t], r[t], out=d[:, 2 * n :])
            carry = dh * z[t] + d @ back
            if any_fresh[t]:
                carry *= on[t]
        flat = du.reshape(-1, 3 * n)
        g["rec"] += prev.reshape(-1, n).T @ flat
        g["b"] += flat[:, 2 * n :].sum(0)
        du[:, :, 2 * n :] = dc
        du *= on
        order = np.argsort(x.ravel(), kind="stable")
        s = x.ravel()[order]
        start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        g["w_in"][s[start]] += np.add.reduceat(flat[order], start, axis=0)


def lanes(symbols: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents dealt over lanes of about one length: the document number and place at (time, lane), -1 where
    a lane has ended."""
    n = np.array([len(s) for s in symbols])
    width = max(1, min(width, len(n), int(n.sum() // max(1, n.max())) or 1))
    full, mine = np.zeros(width, np.int64), [[] for _ in range(width)]
    for d in np.argsort(-n, kind="stable"):
        k = int(np.argmin(full)) if width <= 64 else int(np.argpartition(full, 0)[0])
        mine[k].append(d)
        full[k] += n[d]
    doc = np.full((int(full.max()) if len(n) else 0, width), -1, np.int32)
    at = np.zeros_like(doc)
    for k, ds in enumerate(mine):
        if ds:
            doc[: full[k], k] = np.repeat(ds, n[ds])
            at[: full[k], k] = np.concatenate([np.arange(n[d]) for d in ds])
    return doc, at


def _windows(symbols: list[np.ndarray], width: int) -> Iterator[tuple]:
    """(doc, x, fresh, y, live) of each window, in order."""
    doc, at = lanes(symbols, width)
    flat = np.concatenate(symbols).astype(np.int32)
    base = np.concatenate([[0], np.cumsum([len(s) for s in symbols])])
    for t in range(0, len(doc), STEPS):
        d, a = doc[t : t + STEPS], at[t : t + STEPS]
        live = d >= 0
        place = base[np.maximum(d, 0)] + a
        y = flat[place]
        fresh = (a == 0) | ~live
        x = np.where(fresh, 0, flat[np.maximum(place - 1, 0)])
        yield d, x, fresh, y, live


def _adam(g: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, scale: float, step: float, over: float) -> None:
    """One step of Adam, in place and in blocks that fit the cache; g is set back to zero."""
    held = np.empty(min(len(g), BLOCK), g.dtype)
    for lo in range(0, len(g), BLOCK):
        d, m, v, x = (y[lo : lo + BLOCK] for y in (g, a, b, w))
        t = held[: len(d)]
        d *= scale
        m *= 0.9
        m += np.multiply(d, 0.1, out=t)
        np.multiply(d, d, out=t)
        t *= 0.01
        v *= 0.99
        v += t
        np.sqrt(v, out=t)
        t *= 1 / math.sqrt(over)
        t += 1e-8
        np.divide(m, t, out=t)
        t *= step
        x -= t
        d.fill(0)


def train(model: Model, symbols: list[np.ndarray], state: tuple, width: int = LANES, rate: float = 0.01) -> None:
    """One pass of truncated backpropagation (Adam; of the input gates only the rows of symbols in the window move);
    state: its two moments and the number of steps."""
    m, v, k = state
    h, grad = None, np.zeros_like(model.flat)
    z, shape = model.at["w_in"][1:]
    inputs = [a[:z].reshape(shape) for a in (grad, m, v, model.flat)]
    others = [a[z:] for a in (grad, m, v, model.flat)]
    for _, x, fresh, y, live in _windows(symbols, width):
        if h is None:
            h = np.zeros((x.shape[1], model.h), np.float32)
        hs, tape = model.forward(x, fresh, h)
        keep = live.ravel()
        flat = hs.reshape(-1, model.h)
        dh = np.zeros_like(flat)
        _, dh[keep] = model.outputs(flat[keep], y.ravel()[keep], grad)
        model.backward(x, tape, dh.reshape(hs.shape), grad)
        used = np.unique(x)
        rows = [a[used] for a in inputs]
        scale = 1 / max(1, int(keep.sum()))
        norm = scale * math.sqrt(float(np.vdot(rows[0], rows[0])) + float(others[0] @ others[0]))
        if norm > 1:
            scale /= norm
        k[0] += 1
        step, over = rate / (1 + k[0] / 400) / (1 - 0.9 ** k[0]), 1 - 0.99 ** k[0]
        _adam(*others, scale, step, over)
        _adam(*(a.reshape(-1) for a in rows), scale, step, over)
        for a, b in zip(inputs, rows, strict=True):
            a[used] = b
        h = hs[-1]


def score(model: Model, symbols: list[np.ndarray], width: int = LANES) -> np.ndarray:
    """Natural log probability of each whole document's symbols."""
    out, h = np.zeros(len(symbols)), None
    for d, x, fresh, y, live in _windows(symbols, width):
        if h is None:
            h = np.zeros((x.shape[1], model.h), np.float32)
        hs, _ = model.forward(x, fresh, h)
        keep = live.ravel()
        lp, _ = model.outputs(hs.reshape(-1, model.h)[keep], y.ravel()[keep], None)
        out += np.bincount(d.ravel()[keep], weights=lp, minlength=len(out))
        h = hs[-1]
    return out


def _distinct(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's rows: (distinct hashes, place among them of each token, row of each token, tokens a row)."""
    hashes, rows, done = [], [], 0
    for batch in t.select(["text"]).to_batches():
        for lo, hi, w in _text.chunks(batch.column(0), lower=True):
            hashes += [w.hash]
            rows.append(w.doc + done + lo)
        done += len(batch)
    h = np.concatenate([*hashes, np.full(len(t), END_HASH)]) if len(t) else np.zeros(0, np.uint64)
    r = np.concatenate([*rows, np.arange(len(t))]) if len(t) else np.zeros(0, np.int64)
    order = np.argsort(r, kind="stable")  # the end comes after the words
    h, r = h[order], r[order]
    kinds, at = np.unique(h, return_inverse=True)
    return kinds, at, r, np.bincount(r, minlength=len(t))


def _ids(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def counted(docs: DataFrame, shards: int, head: int) -> tuple[DataFrame, Vocabulary]:
    """(replies, vocabulary). replies: bucket, shard, counts: training counts of the bucket's distinct words of that
    shard, in the order of their hashes."""
    most = max(OWN, head)

    def ask(t: pa.Table) -> pa.Table:
        kinds, at, r, _ = _distinct(t)
        learn = ~t.column("held_out").to_numpy()[r]
        c = np.bincount(at[learn], minlength=len(kinds))
        out = _text.split_by(_ids(kinds, shards), shards)
        bucket = t.column("bucket")[0].as_py()
        return pa.table([pa.array([s for s, _ in out], pa.int32()), pa.array([bucket] * len(out), pa.int32()), pa.array([kinds[i].astype("<u8").tobytes() for _, i in out], pa.binary()), pa.array([c[i].astype("<u4").tobytes() for _, i in out], pa.binary())], names=["shard", "bucket", "words", "counts"])

    def answer(t: pa.Table) -> pa.Table:
        words = [np.frombuffer(x, "<u8") for x in t.column("words").to_pylist()]
        kinds, at = np.unique(np.concatenate(words), return_inverse=True)
        c = np.bincount(at, weights=np.concatenate([np.frombuffer(x, "<u4") for x in t.column("counts").to_pylist()]), minlength=len(kinds)).astype(np.int64)
        cut = np.split(c[at], np.cumsum([len(w) for w in words])[:-1])
        k = tail_class(c)
        types, mass = np.bincount(k, weights=c > 0, minlength=TAILS), np.bincount(k, weights=c, minlength=TAILS)
        top = np.lexsort((kinds.view(np.int64), -c))[: min(most, max(head, int((c >= LEAST).sum())))]
        top = top[c[top] > 0]
        often = c >= LEAST
        packed = [x.astype("<i8").tobytes() for x in (kinds[top].view(np.int64), c[top], _by_slot(kinds[often], c[often]).ravel())]
        n = len(words)
        kind = "<u4" if c.max(initial=0) < 1 << 32 else "<u8"
        return pa.table(
            [
                pa.array(t.column("bucket").to_pylist() + [None], pa.int32()), pa.array(t.column("shard").to_pylist() + [None], pa.int32()), pa.array([x.astype(kind).tobytes() for x in cut] + [None], pa.binary()),
                pa.array([None] * n + [int(c.sum())], pa.int64()), pa.array([None] * n + [int((c > 0).sum())], pa.int64()), pa.array([None] * n + [types.astype(np.int64).tolist()], pa.list_(pa.int64())), pa.array([None] * n + [mass.astype(np.int64).tolist()], pa.list_(pa.int64())),
                *(pa.array([None] * n + [x], pa.binary()) for x in packed),
            ],
            names=["bucket", "shard", "counts", "n", "v", "types", "mass", "w", "c", "shared"],
        )

    asked = docs.groupBy("bucket").applyInArrow(ask, "shard int, bucket int, words binary, counts binary")
    got = written(asked.groupBy("shard").applyInArrow(answer, "bucket int, shard int, counts binary, n long, v long, types array<long>, mass array<long>, w binary, c binary, shared binary"), "counts")
    facts = got.where("n is not null")
    sums = facts.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), *(F.sum(F.col("types")[k]).alias(f"t{k}") for k in range(TAILS)), *(F.sum(F.col("mass")[k]).alias(f"m{k}") for k in range(TAILS))).first()
    z = lambda x: np.array([sums[f"{x}{k}"] or 0 for k in range(TAILS)], np.int64)
    # Merged in each task, then in a few: the driver gets as many rows whatever the corpus.
    merge, kinds = (lambda batches: _merged(batches, most)), "w binary, c binary, shared binary"
    few = facts.select("w", "c", "shared").mapInArrow(merge, kinds).repartition(SLICES).mapInArrow(merge, kinds).toArrow()
    [last] = _merged(iter(few.to_batches()), most)
    w, c, shared = (np.frombuffer(x[0].as_py(), "<i8") for x in last.columns)
    best = slice(max(head, int((c >= LEAST).sum())))
    return got.where("bucket is not null").select("bucket", "shard", "counts"), Vocabulary(sums["n"] or 0, sums["v"] or 0, np.stack([w[best], c[best]], 1), z("t"), z("m"), shared.reshape(2, SHARED))


_ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, tail_score double, symbols binary, shifted binary"


def encoded(docs: DataFrame, replies: DataFrame, voc: Vocabulary, shards: int) -> DataFrame:
    """_ENCODED rows: the base's score, the tail's share of the score, and the symbols of each document."""
    below = np.log10(voc.n + 0.5 * (voc.v + 1))
    share, first_slot = voc.shares(), TAILS + len(voc.head)

    def run(t: pa.Table, got: pa.Table) -> pa.Table:
        kinds, at, r, n = _distinct(t)
        c = np.zeros(len(kinds), np.int64)
        parts = dict(zip(got.column("shard").to_pylist(), got.column("counts").to_pylist(), strict=True))
        for s, i in _text.split_by(_ids(kinds, shards), shards):
            c[i] = np.frombuffer(parts[s], "<u4" if len(parts[s]) == 4 * len(i) else "<u8")
        sym = voc.symbols(kinds, c)
        tail = np.where(((sym < TAILS) | (sym >= first_slot)) & (c > 0), np.log10(c + 0.5) - share[sym], 0.0)
        moved = (sym < TAILS) & (c > 0) & (tail_class(np.maximum(c - 1, 0)) < sym)
        base = np.log10(c + 0.5) - below
        m = len(t)
        ends = np.cumsum(n)
        tokens, shift = sym[at].astype(voc.kind), moved[at]
        return pa.table(
            [
                t.column("doc_id"), t.column("held_out"), pa.array(n.astype(np.int64)), pa.array(np.bincount(r, weights=c[at] > 0, minlength=m).astype(np.int64)), pa.array(np.bincount(r, weights=base[at], minlength=m)), pa.array(np.bincount(r, weights=tail[at], minlength=m)),
                pa.array([tokens[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)], pa.binary()), pa.array([b"" if h else np.packbits(shift[e - k : e]).tobytes() for e, k, h in zip(ends, n, t.column("held_out").to_pylist(), strict=True)], pa.binary()),
            ],
            names=[x.split()[0] for x in _ENCODED.split(", ")],
        )

    return docs.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(lambda a, b: run(a, b), _ENCODED)


def _blocks(batches: Iterator[pa.RecordBatch], kind: str, tokens: int = 1 << 22) -> Iterator[pa.Table]:
    """Runs of batches of about so many tokens: the more, the more documents run side by side."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.column("symbols").nbytes // np.dtype(kind).itemsize
        if n >= tokens:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def fitted(table: DataFrame, voc: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Each round trains on the training documents of its part, all of them after the last round."""
    classes, prior, kind = voc.classes(), voc.prior(), voc.kind
    model = Model(classes, prior)
    mine = table.where(~F.col("held_out")).withColumn("round", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(rounds)))
    tokens = mine.agg(F.sum("n_tokens")).first()[0] or 0
    copies = max(1, round(tokens / (TOKENS_A_WEIGHT * len(model.flat))))
    mine = mine.withColumn("copy", F.pmod(F.xxhash64("doc_id", "n_tokens", "base_score", F.lit(1)), F.lit(copies)).cast("int"))
    for k in range(rounds):
        start = model.flat.copy()

        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            own = Model(classes, prior, flat=start.copy())
            state, seen = (np.zeros_like(start), np.zeros_like(start), [0]), 0
            for t in _blocks(batches, kind):
                docs = []
                for s, m in zip(t.column("symbols").to_pylist(), t.column("shifted").to_pylist(), strict=True):
                    s = np.frombuffer(s, kind)
                    docs.append(s - np.unpackbits(np.frombuffer(m, np.uint8), count=len(s)))
                if docs:
                    train(own, docs, state)
                    seen += sum(map(len, docs))
            if seen:
                parts = np.array_split(own.flat, SLICES)
                yield pa.record_batch([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([seen] * SLICES, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "seen", "w"])

        def add(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) * n for x, n in zip(t.column("w"), t.column("seen").to_pylist(), strict=True))
            return pa.table([t.column("slice").slice(0, 1), pa.array([sum(t.column("seen").to_pylist())], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slice", "seen", "w"])

        schema = "slice int, seen long, w binary"
        own = mine.where(F.col("round") == k).repartitionById(copies, F.col("copy")).sortWithinPartitions("doc_id", "n_tokens", "base_score", "symbols").select("symbols", "shifted")
        got = sorted(own.mapInArrow(run, schema).groupBy("slice").applyInArrow(add, schema).collect())
        if got:
            model.use(np.concatenate([np.frombuffer(r["w"], np.float64) / r["seen"] for r in got]).astype(np.float32))
    return model


def lm_score(docs: DataFrame, head: int = HEAD) -> tuple[DataFrame, Model]:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every row; the model."""
    spark = docs.sparkSession
    small_batches(spark)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    held = F.crc32(name.cast("binary")) % 5 == 1
    n = parts_for(spark, text_bytes(docs), 16 << 20)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("bucket"))
    replies, voc = counted(rows, n, head)
    release(spark)
    table = written(encoded(rows, replies, voc, n), "encoded")
    release(spark)
    model = fitted(table, voc)
    flat, classes, prior, total, kind = model.flat, voc.classes(), voc.prior(), voc.n, voc.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(classes, prior, flat=flat)
        for t in _blocks(batches, kind):
            got = score(own, [np.frombuffer(s, kind) for s in t.column("symbols").to_pylist()]) / np.log(10) if len(t) else np.zeros(0)
            out = pa.table([*(t.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array(np.full(len(t), total, np.int64)), t.column("base_score"), pa.array(got + t.column("tail_score").to_numpy())], names=_OUT)
            yield from out.to_batches()

    _OUT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return table.drop("shifted").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), model
