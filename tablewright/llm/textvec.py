"""Word and shingle hashes of many texts at once, with numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.  A
word's hash is a polynomial over per-byte random values modulo 2**64 (prefix
sums make every word of a block one subtraction), then mixed.  Texts are
handled in blocks of a quarter of a megabyte, so memory follows the block and the
number of words, not eight-fold the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tablewright.llm.common import flat

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multipliers): a bijection."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, U)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class WordHasher:
    """Tables for one task; build it inside the task."""

    BLOCK = 1 << 18
    WIDTH = 5

    def __init__(self):
        b = np.arange(256, dtype=U)
        b[65:91] += U(32)
        self.table = mix(b * U(0x9E3779B97F4A7C15) + U(0x1234567))
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        # 0 white space, 1 A-Z, 2 a-z, 3 digits, 4 other ASCII, 5 bytes of longer characters, 6 comma and full stop, 7 bar, 9 line feed
        self.classes = np.full(256, 4, np.uint8)
        self.classes[[9, 11, 12, 13, 32]] = 0
        for c, (lo, hi) in ((1, (65, 91)), (2, (97, 123)), (3, (48, 58)), (5, (128, 256))):
            self.classes[lo:hi] = c
        self.classes[[44, 46]], self.classes[124], self.classes[10] = 6, 7, 9
        self.coef = mix(np.arange(1, self.WIDTH + 1, dtype=U)) | U(1)
        self.base = U(0x5851F42D4C957F2D)
        self.base_inv = U(pow(int(self.base), -1, 1 << 64))
        self._powers(self.BLOCK + 1)

    def _powers(self, n: int) -> None:
        with np.errstate(over="ignore"):
            p = np.full(n, self.base, U)
            p[0] = 1
            q = np.full(n, self.base_inv, U)
            q[0] = 1
            self.pow, self.inv = np.cumprod(p, dtype=U), np.cumprod(q, dtype=U)

    def spans(self, data: np.ndarray, off: np.ndarray):
        """Start and end byte of every word, and the first word of each row (one
        more entry than rows)."""
        n = len(data)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(len(off), np.int64)
        sp = self.space[data]
        begin, end = ~sp, ~sp
        rows = off[:-1][off[:-1] < off[1:]]
        lasts = off[1:][off[:-1] < off[1:]] - 1
        b0, e0 = begin[rows], end[lasts]
        begin[1:] &= sp[:-1]
        end[:-1] &= sp[1:]
        begin[rows], end[lasts] = b0, e0
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), U)
        i = 0
        with np.errstate(over="ignore"):
            while i < len(starts):
                s0 = int(starts[i])
                j = max(i + 1, int(np.searchsorted(ends, s0 + self.BLOCK, "right")))
                seg = self.table[data[s0: int(ends[j - 1])]]
                if len(seg) + 1 > len(self.pow):
                    self._powers(len(seg) + 1)
                seg *= self.pow[: len(seg)]
                sums = np.empty(len(seg) + 1, U)
                sums[0] = 0
                np.cumsum(seg, out=sums[1:])
                a, b = starts[i:j] - s0, ends[i:j] - s0
                out[i:j] = mix((sums[b] - sums[a]) * self.inv[a] + (b - a).astype(U))
                i = j
        return out

    def _sequence(self, words: np.ndarray) -> np.ndarray:
        """The hash of fewer words than a shingle has, as one."""
        with np.errstate(over="ignore"):
            total = (words * self.coef[: len(words)]).sum(dtype=U) + U(len(words)) * U(0xD6E8FEB86659FD93)
            return mix(np.array([total], U))

    def sets(self, arr):
        """For each row of an Arrow text column: its sorted distinct shingles."""
        data, off = flat(arr)
        starts, ends, first = self.spans(data, off)
        words = self.hashes(data, starts, ends)
        w = self.WIDTH
        with np.errstate(over="ignore"):
            if len(words) >= w:
                m = len(words) - w + 1
                sh = words[:m] * self.coef[0]
                for j in range(1, w):
                    sh += words[j: m + j] * self.coef[j]
                sh = mix(sh)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo >= w:
                s = np.sort(sh[lo: hi - w + 1])
                if len(s) > 1:
                    keep = np.empty(len(s), bool)
                    keep[0] = True
                    np.not_equal(s[1:], s[:-1], out=keep[1:])
                    s = s[keep]
                yield s
            elif hi > lo:
                yield self._sequence(words[lo:hi])
            else:
                yield np.zeros(0, U)


def word_array(arr, space: np.ndarray, letters: np.ndarray | None = None):
    """The words of an Arrow text column (runs of bytes that ``space`` doesn't
    mark) back to back as an Arrow array, and where each row's words begin.
    ``letters``: what each byte is read as."""
    data, off = flat(arr)
    blank = space[data]
    opens, closes = ~blank, ~blank
    opens[1:] &= blank[:-1]
    closes[:-1] &= blank[1:]
    # a word ends with its row
    full = off[:-1] < off[1:]
    rows, lasts = off[:-1][full], off[1:][full] - 1
    opens[rows], closes[lasts] = ~blank[rows], ~blank[lasts]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    body = data[~blank]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(body if letters is None else letters[body])])
    return words, np.searchsorted(starts, off)
