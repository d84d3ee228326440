"""FM-index over integer sequences, with a wavelet matrix for rank and batched backward search.

The suffix order is by the first `depth` symbols only, which is all that patterns of up to `depth` symbols
need: every interval of backward search for such a pattern holds just the suffixes that begin with it.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


class WaveletMatrix:
    """Symbols 0..2^levels - 1; each level keeps one packed bit a symbol and a count every 64."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.bits, self.sums, self.zeros = levels, [], [], []
        x = symbols.astype(np.uint32)
        n = len(x)
        for k in range(levels - 1, -1, -1):
            bit = (x >> np.uint32(k)) & np.uint32(1)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            p = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(p)] = p
            words = packed.view("<u8")
            self.bits.append(words)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int64))
            self.zeros.append(n - int(bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        every = np.arange(1 << levels, dtype=np.int64)
        self.base = self._down(every, np.zeros(len(every), np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word, low = i >> 6, (i & 63).astype(U)
            ones = self.sums[k][word] + np.bitwise_count(self.bits[k][word] & ((U(1) << low) - U(1))).astype(np.int64)
            i = np.where((c >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before place i, element by element."""
        return self._down(c, i) - self.base[c]


def prefix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols, by prefix doubling; 0 stands after the end."""
    rank, known = text.astype(np.int64), 1

    def after(r: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(r)
        if k < len(r):
            out[: len(r) - k] = r[k:]
        return out

    while 2 * known <= depth:
        rank = np.unique(rank * (int(rank.max()) + 1) + after(rank, known), return_inverse=True)[1] + 1
        known *= 2
    if known < depth:
        rank = rank * (int(rank.max()) + 1) + after(rank, depth - known)
    return np.argsort(rank, kind="stable")


class FMIndex:
    """text: symbols from 1; 0 separates sequences and may not be searched for."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, self.n = depth, len(text)
        top = int(text.max(initial=0))
        self.order = prefix_order(text, depth)
        self.tree = WaveletMatrix(text[self.order - 1], max(1, top.bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])

    def search(self, text: np.ndarray, ends: np.ndarray, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics, stopped at depth: for each end the interval of the longest match of
        text[..end] of up to depth symbols, and its length. Ends are taken in blocks, one symbol a step."""
        parts = [self._block(text, ends[k : k + block]) for k in range(0, len(ends), block)]
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none, none, none)

    def _block(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo, hi, size = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64), np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        for k in range(self.depth):
            place = ends[live] - 1 - k
            live = live[place >= 0]
            c = text[ends[live] - 1 - k]
            live, c = live[c > 0], c[c > 0]
            if not len(live):
                break
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            a, b = self.before[c] + both[: len(c)], self.before[c] + both[len(c) :]
            ok = a < b
            live = live[ok]
            lo[live], hi[live] = a[ok], b[ok]
            size[live] += 1
        return lo, hi, size
