"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared lower-cased (characters whose lower case has another length
stay) with runs of white space as one space.  An item of n characters may occur
with up to e = ``ERROR`` * n edits; it is cut into e + 1 pieces, of which at
least one must then occur unchanged.  More than that: going round the pieces,
one unchanged piece begins a run in which every first l pieces have fewer than
l edits, so the piece after it has one at most, and one half of that piece is
where it belongs, give or take a character.  All pieces go into one
Aho-Corasick automaton; a hit whose next piece can still be in place names a
window of the text, windows of one item that overlap are joined, and each is
verified with Myers' bit-parallel distance, which finds the best end of an
approximate occurrence; a second pass over the reversed strings finds its start.

Items go to the workers in blocks of bounded size, each block being one pass
over the documents, so a benchmark of any size is matched whole.

Null or empty items match nothing.  Items shorter than ``SHORT`` characters
must occur unchanged between characters that are not letters or digits.  Null
texts are empty.  Items that repeat an id or a text are matched each; rows that
repeat give a result each.  An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import empty, id_text, slices, small_batches, text_udf, with_id

#: Edits allowed a character, least length for edits, characters of items in a block.
ERROR, SHORT, BLOCK_CHARS = 0.1, 24, 4 << 20
HIT = "doc_id long, item_id long, start long, end long, distance int, item_chars int"


def lowered(text: str) -> str:
    out = text.lower()
    return out if len(out) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normal(text: str) -> str:
    return " ".join(lowered(text).split())


def positions(text: str) -> list[int]:
    """The place in ``text`` of each character of ``normal(text)``."""
    out: list[int] = []
    for m in re.finditer(r"\S+", text):
        if out:
            out.append(m.start() - 1)
        out.extend(range(m.start(), m.end()))
    return out


def budget(n: int, error: float) -> int:
    return int(error * n) if n >= SHORT else 0


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces of nearly equal length with their places."""
    n, k = len(item), edits + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of the pattern to a part of ``text`` and where the
    first such part ends (exclusive).  ``anchored``: the part begins the text."""
    ones, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = ones, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        x = eq | vn
        d0 = ((((eq & vp) + vp) ^ vp) | x) & ones
        hp, hn = (vn | ~(d0 | vp)) & ones, vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1 | anchored) & ones
        hn = hn << 1 & ones
        vp, vn = (hn | ~(d0 | hp)) & ones, hp & d0
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Built once per task for one block of items."""

    def __init__(self, items: list[tuple[int, str]], error: float):
        import ahocorasick
        self.items, found = [], {}
        for ident, text in items:
            s = normal(text or "")
            if not s:
                continue
            e = budget(len(s), error)
            k = len(self.items)
            self.items.append((ident, s, e, masks(s), masks(s[::-1])))
            cut = pieces(s, e)
            for i, (at, piece) in enumerate(cut):
                after = cut[i + 1][1] if i < e else ""
                found.setdefault(piece, []).append((k, at, after[: len(after) // 2], after[len(after) // 2:]))
        self.auto = ahocorasick.Automaton()
        for piece, places in found.items():
            self.auto.add_word(piece, (len(piece), places))
        self.auto.make_automaton()

    def hits(self, text: str):
        """(item id, start, end, distance, item length) in code points of ``text``;
        the best occurrence of each item."""
        if not self.items:
            return []
        s = normal(text)
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (n, places) in self.auto.iter(s):
            for k, at, a, b in places:
                p = last + 1 + len(a)
                if b and not (s.startswith(a, last + 1) or s.startswith(b, p) or s.startswith(b, p - 1) or s.startswith(b, p + 1)):
                    continue
                _, item, e, *_ = self.items[k]
                lo = last - n + 1 - at - e
                windows.setdefault(k, []).append((max(0, lo), min(len(s), lo + len(item) + 2 * e)))
        out, where = [], None
        for k in sorted(windows):
            ident, item, e, forward, backward = self.items[k]
            best = None
            for lo, hi in _joined(windows[k]):
                if len(item) < SHORT:
                    d, a, b = self._whole(s, item, lo, hi)
                else:
                    d, b = myers(forward, len(item), s[lo:hi])
                    b += lo
                    if d <= e:
                        d, length = myers(backward, len(item), s[max(lo, b - len(item) - e): b][::-1], True)
                        a = b - length
                if d <= e and (best is None or (d, a) < best[:2]):
                    best = (d, a, b)
            if best and best[2] > best[1]:
                where = where or positions(text)
                out.append((ident, where[best[1]], where[best[2] - 1] + 1, best[0], len(item)))
        return out

    @staticmethod
    def _whole(s: str, item: str, lo: int, hi: int) -> tuple[int, int, int]:
        at = s.find(item, lo, hi)
        while at >= 0:
            end = at + len(item)
            if not (at and s[at - 1].isalnum() and item[0].isalnum()) and not (end < len(s) and s[end].isalnum() and item[-1].isalnum()):
                return 0, at, end
            at = s.find(item, at + 1, hi)
        return len(item) + 1, 0, 0


def _joined(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(set(windows)):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _finder(items, error: float):
    def run(batches):
        matcher = Matcher(items.value, error)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(doc, *h) for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for h in matcher.hits(text)]
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.int32()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "item_id", "start", "end", "distance", "item_chars"])
    return run


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, t) of the items with a text, and into how many blocks they go."""
    with_id(with_id(benchmark, item_col), text_col)
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t")).where("t IS NOT NULL")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    return items, -(-chars // BLOCK_CHARS)


def _block(items: DataFrame, block: int, blocks: int):
    """About BLOCK_CHARS characters of items, broadcast."""
    rows = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == block).collect()
    return items.sparkSession.sparkContext.broadcast([(r["id"], r["t"]) for r in rows])


def find_items(df: DataFrame, benchmark: DataFrame, error: float = ERROR, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, start, end
    (code points of the text, end exclusive), distance, item_chars."""
    spark = df.sparkSession
    items, blocks = _items(benchmark, item_col, item_text_col)
    docs, out = id_text(df, id_col, text_col), None
    for b in range(blocks):
        found = docs.mapInArrow(_finder(_block(items, b, blocks), error), HIT)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else empty(spark, HIT)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, error: float = ERROR, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``df`` without the rows that hold an item; columns as they were.  Only the
    texts go to Python, only flags come back."""
    small_batches(df.sparkSession)
    items, blocks = _items(benchmark, item_col, item_text_col)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    for b in range(blocks):
        df = df.where(~_holds(_block(items, b, blocks), error)(text))
    return df


def _holds(items, error: float):
    def make():
        matcher = Matcher(items.value, error)
        return lambda arr: pa.array([bool(matcher.hits(t)) for t in arr.to_pylist()], pa.bool_())
    return text_udf(make, "boolean")
