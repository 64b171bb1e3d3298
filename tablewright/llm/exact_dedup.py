"""Exact duplicates by content-defined chunk recipes.

1. Each text is cut where a rolling hash of its last bytes says so (equal
   passages get equal cuts, wherever they stand); a chunk's digest is 16 bytes
   of keyed BLAKE2.  A text's *recipe* is the ordered list of its chunks'
   digests and lengths.  Only recipes are written, not texts.
2. Different recipes mean different texts.  The chunks of recipes that occur
   twice are read once more and sent to their digest, each at most once a
   megabyte of text and combined before the shuffle; a digest that gets one
   content only is a *verified identifier* of it.  Texts that share no recipe
   move nothing: which texts to read is known from a Bloom filter of at most
   MAX_WORDS words, whose false hits cost work, not results.
3. If a digest stands for two contents, all are drawn anew with another key.
4. Equal ordered lists of verified identifiers are equal texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import flat, id_text, slices, stage
from tablewright.llm.textvec import U, mix

#: Bytes of a chunk: at least, on average about (a power of two) more, at most.
MIN_CHUNK, MORE, MAX_CHUNK = 2048, 4096, 16384
#: Bytes that the rolling hash sees.
WINDOW = 48
#: Words of 64 bits in the Bloom filter, at most (32 MB).
MAX_WORDS = 1 << 22
DIGEST_BYTES = 16
TRIES = 8


class Chunker:
    """Cuts and digests of one task; ``key`` draws other digests."""

    BLOCK = 1 << 18

    def __init__(self, key: int, digest_bytes: int):
        self.key, self.digest_bytes = key.to_bytes(8, "little"), digest_bytes
        self.table = mix(np.arange(256, dtype=U) * U(0x9E3779B97F4A7C15) + U(77))
        base = 0x5851F42D4C957F2D
        self.lift = np.array([pow(base, i, 1 << 64) for i in range(WINDOW)], U)
        with np.errstate(over="ignore"):
            self.inverse = np.full(self.BLOCK + WINDOW, pow(base, -1, 1 << 64), U)
            self.power = np.full(self.BLOCK + WINDOW, base, U)
            self.inverse[0] = self.power[0] = 1
            np.cumprod(self.inverse, out=self.inverse)
            np.cumprod(self.power, out=self.power)

    def _marks(self, text: np.ndarray) -> np.ndarray:
        """Places after which a text may be cut: the hash of the WINDOW bytes
        before them has its upper bits zero."""
        out = []
        with np.errstate(over="ignore"):
            for lo in range(0, len(text) - WINDOW, self.BLOCK):
                part = self.table[text[lo: lo + self.BLOCK + WINDOW - 1]] * self.power[: min(len(text) - lo, self.BLOCK + WINDOW - 1)]
                sums = np.append(U(0), np.cumsum(part, dtype=U))
                rolled = (sums[WINDOW:] - sums[:-WINDOW]) * self.inverse[: len(sums) - WINDOW]
                rolled = (rolled ^ (rolled >> U(29))) * U(0xBF58476D1CE4E5B9)
                out.append(np.flatnonzero(rolled < U((1 << 64) // MORE)) + lo + WINDOW)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def cuts(self, text: np.ndarray) -> list[int]:
        """Ends of the chunks of a text; an empty text is one empty chunk."""
        n, at, ends = len(text), 0, []
        if n > MIN_CHUNK:
            marks = self._marks(text)
            while n - at > MIN_CHUNK:
                i = int(np.searchsorted(marks, at + MIN_CHUNK))
                at = min(int(marks[i]) if i < len(marks) else n, at + MAX_CHUNK, n)
                ends.append(at)
        if not ends or ends[-1] < n:
            ends.append(n)
        return ends

    def digest(self, chunk) -> bytes:
        return hashlib.blake2b(chunk, digest_size=self.digest_bytes, key=self.key).digest()

    def mark(self, text) -> int:
        """A text's place in the Bloom filter."""
        return int.from_bytes(hashlib.blake2b(text, digest_size=8, key=self.key).digest(), "little", signed=True)


def _texts(batch):
    """(row number, bytes of the text) of a slice, without copies."""
    data, off = flat(batch.column(batch.schema.get_field_index("text")))
    off = off.tolist()
    return ((i, data[a:b]) for i, (a, b) in enumerate(zip(off[:-1], off[1:])))


def _recipes(docs: DataFrame, key: int, digest_bytes: int) -> DataFrame:
    def run(batches):
        chunker = Chunker(key, digest_bytes)
        for batch in batches:
            for part in slices(batch, "text"):
                recipe, mark, sha = [], [], []
                for _, text in _texts(part):
                    at, ids = 0, []
                    for end in chunker.cuts(text):
                        ids.append(chunker.digest(text[at:end]) + (end - at).to_bytes(4, "little"))
                        at = end
                    recipe.append(b"".join(ids))
                    mark.append(chunker.mark(text))
                    sha.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(recipe, pa.binary()), pa.array(mark, pa.int64()), pa.array(sha, pa.string())],
                                                 ["doc_id", "recipe", "mark", "text_sha256"])

    rows = docs.mapInArrow(run, "doc_id long, recipe binary, mark long, text_sha256 string")
    return stage(rows.withColumn("row", F.monotonically_increasing_id()), "recipes")


def _bits(mark: np.ndarray, words: int):
    """Word number and four bits of each mark."""
    h = mix(mark.view(U))
    bits = np.zeros(len(h), U)
    for shift in (0, 6, 12, 18):
        bits |= U(1) << ((h >> U(shift)) & U(63))
    return ((h >> U(32)) & U(words - 1)).astype(np.int64), bits


def _bloom(marks: DataFrame, count: int) -> np.ndarray:
    """Bloom filter of the marks: 16 bits for each, up to MAX_WORDS words in all."""
    words = min(MAX_WORDS, 1 << max(6, (count // 4).bit_length()))

    def run(batches):
        own = np.zeros(words, U)
        for batch in batches:
            at, bits = _bits(batch.column(0).to_numpy(), words)
            np.bitwise_or.at(own, at, bits)
        hit = np.flatnonzero(own)
        for lo in range(0, len(hit), 1 << 16):
            part = hit[lo: lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(own[part].view(np.int64))], ["at", "bits"])

    got = marks.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bloom = np.zeros(words, U)
    bloom[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(U)
    return bloom


def _contents(docs: DataFrame, bloom: np.ndarray, key: int, digest_bytes: int) -> DataFrame:
    """(digest, content) of the chunks of texts in the filter, each content once a slice."""
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches):
        chunker, bloom = Chunker(key, digest_bytes), filter_.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = list(_texts(part))
                at, bits = _bits(np.array([chunker.mark(t) for _, t in texts], np.int64), len(bloom))
                seen = set()
                for i in np.flatnonzero((bloom[at] & bits) == bits).tolist():
                    text, lo = texts[i][1], 0
                    for end in chunker.cuts(text):
                        seen.add((chunker.digest(text[lo:end]) + (end - lo).to_bytes(4, "little"), text[lo:end].tobytes()))
                        lo = end
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*seen)], ["id", "content"])

    return docs.mapInArrow(run, "id binary, content binary")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id (of the row that stays among
    equal texts: the one with the largest id), group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are equal; texts are compared
    byte by byte, without any change.  A null id is smaller than any other.  Of
    rows that share both text and id one is kept.  An empty table gives no rows;
    other columns are not read.  ``digest_bytes``: length of the chunk digests
    (short ones only make work).
    """
    docs = id_text(df, id_col, text_col)
    for key in range(TRIES):
        size = digest_bytes if key < TRIES // 2 else DIGEST_BYTES
        rows = _recipes(docs, key, size)
        # two texts under one recipe have, but for one chance in 2**64, two marks; both then go into the filter
        groups = stage(rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep"),
                                                  F.min("mark").alias("m0"), F.max("mark").alias("m1")).where("group_size > 1"), "recipe-groups")
        count = groups.count()
        if not count:
            break
        marks = groups.select(F.explode(F.array("m0", "m1")).alias("mark"))
        chunks = _contents(docs, _bloom(marks, count), key, size)
        two = chunks.groupBy("id").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b")
        if not two.limit(1).count():
            break
    else:
        raise RuntimeError(f"digests of {DIGEST_BYTES} bytes met twice with different contents under {TRIES // 2} keys")
    return rows.join(groups, "recipe", "left").select(
        "doc_id", F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.coalesce("keep.row", "row") == F.col("row")).alias("kept"), "text_sha256")
