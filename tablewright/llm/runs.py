"""Periodic runs of words, found on a grammar of the texts.

A run is a stretch of consecutive words with smallest period q (words q apart
are the same) that no neighbouring word extends, at least ``min_words`` words
and ``min_repeats`` periods long.  Words are runs of bytes other than 0x20 and
0x09-0x0D, compared exactly.

The texts of a slice of an Arrow batch share one grammar:

1. *Re-Pair* the word ids.  In each round every pair of neighbouring symbols is
   counted, and every place whose pair is more frequent than the pairs that
   overlap it becomes a new symbol, if its pair keeps two places at least
   (``aaa``: every second place).  When no pair is left, neighbours are joined
   two by two until a text is one symbol.
2. *Runs across a boundary.*  A symbol X = Y Z is looked at once, in its first
   place.  A run in X that holds the last word of Y and the first of Z has a
   whole period right or left of the boundary, so for each q two anchors are
   extended both ways by equal words, inside X.  Equal stretches are found by
   prefix hashes and confirmed word by word.
3. *Translation.*  What was found in X holds at every place of X; the lowest
   symbol above a run of the text has it whole, all others hold parts of it.
4. *Maximal intervals.*  For each q the intervals inside others go, and of
   equal intervals the smallest period stays.

The grammar has some n symbols for n words and the boundaries of one depth look
at O(n) pairs, so the work is O(n log n) words, whatever the periods.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import id_text, slices
from tablewright.llm.textvec import U, mix, word_array

#: Pairs (symbol, period) looked at in one numpy step.
STEP = 1 << 19


class Words:
    """Prefix hashes of a sequence of word ids."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.ids = np.append(ids, -1)
        with np.errstate(over="ignore"):
            self.pow = np.full(n + 1, 0x5851F42D4C957F2D, U)
            self.pow[0] = 1
            np.cumprod(self.pow, out=self.pow)
            self.sums = np.zeros(n + 1, U)
            np.cumsum(mix(ids.astype(U) + U(1)) * self.pow[:-1], out=self.sums[1:])

    def same(self, i: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words from i and from i + q agree for ``length`` words, by hash."""
        with np.errstate(over="ignore"):
            return (self.sums[i + length] - self.sums[i]) * self.pow[q] == self.sums[i + q + length] - self.sums[i + q]

    def reach(self, x: np.ndarray, q: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """How many words from x on (``back``: before x) equal those q later, up to ``limit``."""
        lo, hi = np.zeros_like(limit), limit + 1
        whole = self.same(x - limit if back else x, q, limit)
        lo[whole] = limit[whole]
        while len(open_ := np.flatnonzero(hi - lo > 1)):
            mid = (lo[open_] + hi[open_]) // 2
            ok = self.same(x[open_] - mid if back else x[open_], q[open_], mid)
            lo[open_[ok]] = mid[ok]
            hi[open_[~ok]] = mid[~ok]
            hi[whole] = lo[whole] + 1
        return lo

    def reach_exactly(self, x: int, q: int, limit: int, back: bool) -> int:
        a, b = (self.ids[x - limit: x][::-1], self.ids[x + q - limit: x + q][::-1]) if back else (self.ids[x: x + limit], self.ids[x + q: x + q + limit])
        return int(np.argmax(a != b)) if (a != b).any() else limit


def _pieces(count: np.ndarray):
    """(symbol numbers, periods) for periods 1..count of each symbol, in steps."""
    k = np.repeat(np.arange(len(count)), -(-count // STEP))
    lo = np.ones(len(k), np.int64)
    again = np.flatnonzero(np.diff(k, prepend=-1) == 0)  # a symbol of more than one step
    for i in again.tolist():
        lo[i] = lo[i - 1] + STEP
    size = np.minimum(count[k] - lo + 1, STEP)
    ends = np.cumsum(size)
    i = 0
    while i < len(k):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + 2 * STEP, "right")))
        begin = ends[i:j] - size[i:j]
        yield np.repeat(k[i:j], size[i:j]), np.arange(begin[0], ends[j - 1]) - np.repeat(begin - lo[i:j], size[i:j])
        i = j


def crossing(words: Words, p: np.ndarray, c: np.ndarray, e: np.ndarray, min_words: int, min_repeats: int):
    """Runs of the stretches [p, e) that hold the words c - 1 and c: (number of
    the stretch, start, end, period), of equal ones the smallest period."""
    found = []
    w = words.ids
    for right in (True, False):
        for k, q in _pieces(np.minimum((e - p) // min_repeats, e - c if right else c - p)):
            x = c[k] if right else c[k] - q
            need = np.maximum(min_words - q, (min_repeats - 1) * q)
            half = (need + 1) // 2  # one of the two sides has as many
            ahead = np.flatnonzero((w[x] == w[x + q]) & (x + q + half <= e[k]))
            ahead = ahead[words.same(x[ahead], q[ahead], half[ahead])]
            behind = np.flatnonzero((w[x - 1] == w[x + q - 1]) & (x - half >= p[k]))
            behind = behind[words.same(x[behind] - half[behind], q[behind], half[behind])]
            at = np.union1d(ahead, behind)
            if not len(at):
                continue
            k, q, x = k[at], q[at], x[at]
            l, r = words.reach(x, q, x - p[k], True), words.reach(x, q, e[k] - x - q, False)
            ok = (l + r >= need[at]) & ((l if right else r) > 0)
            if ok.any():
                found.append(np.stack([k[ok], (x - l)[ok], (x + r + q)[ok], q[ok], x[ok]]))
    if not found:
        return np.zeros((4, 0), np.int64)
    k, s, end, q, x = np.concatenate(found, axis=1)
    first = _first_of(k, s, end, q)
    checked = [(w[s[i]: end[i] - q[i]] == w[s[i] + q[i]: end[i]]).all() for i in first.tolist()]
    if not all(checked):
        # two different stretches with one hash: word by word for the symbols concerned
        bad = np.isin(k, k[first[~np.array(checked)]])
        for i in np.flatnonzero(bad).tolist():
            lo, hi = int(p[k[i]]), int(e[k[i]])
            s[i] = x[i] - words.reach_exactly(int(x[i]), int(q[i]), int(x[i]) - lo, True)
            end[i] = x[i] + q[i] + words.reach_exactly(int(x[i]), int(q[i]), hi - int(x[i] + q[i]), False)
        ok = (end - s >= np.maximum(min_words, min_repeats * q)) & (s < c[k]) & (end > c[k])
        k, s, end, q = k[ok], s[ok], end[ok], q[ok]
        first = _first_of(k, s, end, q)
    return np.stack([k[first], s[first], end[first], q[first]])


def _first_of(k, s, e, q) -> np.ndarray:
    """Of rows with the same k, s and e the one with the smallest q."""
    o = np.lexsort((q, e, s, k))
    new = np.ones(len(o), bool)
    new[1:] = (np.diff(k[o]) != 0) | (np.diff(s[o]) != 0) | (np.diff(e[o]) != 0)
    return o[new]


def symbols(ids: np.ndarray, row: np.ndarray):
    """Rounds of new symbols over the words of all rows: (first, middle, end) of a
    symbol's first place, and each place with the number of its symbol.

    A symbol stands at its first word and ``after`` points at the next one.  A
    pair found once stays single until one of its symbols changes, so a round
    counts the pairs that were found twice and those beside new symbols."""
    n = len(ids)
    sym, after, before = ids.astype(np.int64), np.arange(1, n + 1), np.arange(-1, n)
    row = np.append(row, -1)
    gone, mark, rank_at = np.zeros(n, bool), np.zeros(n, bool), np.full(n + 1, -1)
    rng = np.random.default_rng(1)
    top = int(sym.max(initial=-1)) + 1
    pairs = np.flatnonzero(row[1:] == row[:-1])
    while len(pairs):
        code, _ = pd.factorize(sym[pairs] * top + sym[after[pairs]])
        count = np.bincount(code)
        twice = count[code] >= 2
        pairs, code = pairs[twice], code[twice]
        # frequent pairs first, by powers of two; pairs alike in that in random order
        rank = ((np.frexp(count)[1].astype(np.int64) << 40) + rng.permutation(len(count)))[code]
        rank_at[pairs] = rank
        peak = np.flatnonzero((rank >= rank_at[before[pairs]]) & (rank >= rank_at[after[pairs]]))
        rank_at[pairs] = -1
        at, code = pairs[peak], code[peak]
        i = np.arange(len(at))
        opens = np.ones(len(at), bool)
        opens[1:] = after[at[:-1]] != at[1:]
        odd = (i - np.maximum.accumulate(np.where(opens, i, 0))) % 2
        at, code = at[odd == 0], code[odd == 0]
        kept = np.bincount(code, minlength=len(count))[code] >= 2
        at, code = at[kept], code[kept]
        if not len(at):
            break
        name, _ = pd.factorize(code)
        lead = np.flatnonzero(np.diff(np.maximum.accumulate(name), prepend=-1))
        mid = after[at]
        end = after[mid]
        yield at[lead], mid[lead], end[lead], name, at
        sym[at], after[at], before[end], gone[mid] = top + name, end, at, True
        top += len(lead)
        mark[pairs], mark[at], mark[before[at]] = True, True, True
        mark[mid] = False
        pairs = np.flatnonzero(mark)
        mark[pairs] = False
        pairs = pairs[row[after[pairs]] == row[pairs]]
    at = np.flatnonzero(~gone)
    while True:
        end = after[at]
        inside = row[at[1:]] == row[at[:-1]]
        if not inside.any():
            return
        i = np.arange(len(at))
        taken = np.flatnonzero(((i - np.maximum.accumulate(np.where(np.append(True, ~inside), i, 0))) % 2 == 0)[:-1] & inside)
        yield at[taken], at[taken + 1], end[taken + 1], np.arange(len(taken)), at[taken]
        after[at[taken]] = end[taken + 1]
        keep = np.ones(len(at), bool)
        keep[taken + 1] = False
        at = at[keep]


def runs_of(ids: np.ndarray, row: np.ndarray, min_words: int, min_repeats: int):
    """(start, end, period) of all runs, by start and period; ``row`` numbers the
    text of each word, and no run leaves its text."""
    words = Words(ids)
    found = []
    for p, c, e, name, at in symbols(ids, row):
        big = np.flatnonzero(e - p >= min_words)
        if not len(big):
            continue
        k, s, t, q = crossing(words, p[big], c[big], e[big], min_words, min_repeats)
        if not len(k):
            continue
        k = big[k]
        order = np.argsort(name, kind="stable")
        lo, hi = np.searchsorted(name[order], k), np.searchsorted(name[order], k, "right")
        each = np.repeat(np.arange(len(k)), hi - lo)
        place = order[np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(len(each))]
        moved = at[place] - p[k[each]]
        found.append(np.stack([s[each] + moved, t[each] + moved, q[each]]))
    if not found:
        return np.zeros((3, 0), np.int64)
    s, e, q = np.concatenate(found, axis=1)
    o = np.lexsort((-e, s, q))
    s, e, q = s[o], e[o], q[o]
    far = np.maximum.accumulate(q * (len(ids) + 1) + e)  # the furthest end so far, of the same period
    outer = np.ones(len(s), bool)
    outer[1:] = (q[1:] * (len(ids) + 1) + e[1:]) > far[:-1]
    s, e, q = s[outer], e[outer], q[outer]
    one = _first_of(np.zeros_like(s), s, e, q)
    s, e, q = s[one], e[one], q[one]
    o = np.lexsort((q, s))
    return np.stack([s[o], e[o], q[o]])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _runs_of_slice(batch, space: np.ndarray, min_words: int, min_repeats: int) -> pa.RecordBatch:
    words, first = word_array(batch.column(1), space)
    ids = words.dictionary_encode().indices.to_numpy()
    n = batch.num_rows
    row = np.repeat(np.arange(n), np.diff(first))
    s, e, q = runs_of(ids, row, min_words, min_repeats)
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, s + q, 1)
    np.add.at(step, e, -1)
    kept = np.flatnonzero(np.cumsum(step)[:-1] == 0)
    lists = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(kept, first)), words.take(pa.array(kept)))
    collapsed = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))
    spans = pa.StructArray.from_arrays([pa.array(v) for v in (s - first[row[s]], e - s, q)], fields=list(RUN))
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(s, first).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), runs, collapsed.cast(pa.large_string()).cast(pa.string())],
                                      ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(df: DataFrame, min_words: int = 24, min_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, ``runs`` (start, length and
    period in words, by start and period) and ``collapsed``, the words joined by
    one space without those that a run holds after its first period.

    Null texts, texts without words and texts shorter than ``min_words`` have no
    runs; a null id stays null; repeated rows and ids give a row each; an empty
    table gives no rows; other columns are not read.  A text is read whole, in
    one task, however long; nothing is shuffled.
    """
    def run(batches):
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        for batch in batches:
            for part in slices(batch, "text"):
                yield _runs_of_slice(part, space, min_words, min_repeats)

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_periodic_tails(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with a periodic tail in one text of ten, by its id: with
    h = crc32(id as text) and g = h div 10, where h mod 10 is 0 and the text has
    n > 0 words, word i >= a becomes word a + (i - a) mod p, for a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8); these texts' words are joined by one
    space.  Rows without an id or words stay as they are."""
    h = F.crc32(F.col(f"`{id_col}`").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(r"[^\x20\x09-\x0D]+"), 0)

    def periodic(ws):
        n = F.size(ws).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
        at = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(ws, at(i).cast("int"))), " "))

    # the array of one element binds the words, so that they are cut once a row
    tail = F.get(F.transform(F.array(words), periodic), F.lit(0))
    text = F.col(f"`{text_col}`").cast("string")
    return df.withColumn(text_col, F.coalesce(F.when(h % 10 == 0, tail), text))


def digest(runs: DataFrame) -> DataFrame:
    """Number of runs, the one with the most periods (exactly compared; of equals
    the first by start, then period) and digests of the runs and of what is kept."""
    more = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), more)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    every = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return (runs.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
                    F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
