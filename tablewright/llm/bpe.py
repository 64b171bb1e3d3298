"""Byte-level BPE encoding and decoding with the tiktoken library and a local
rank file.

A long text is first cut at safe boundaries: between a letter and a space that
a letter follows, where the splitting pattern always ends one match and begins
another, so the pieces' ids joined are the whole text's ids.  A stretch without
such a boundary is matched with the pattern here and each match is encoded on
its own.  Decoding joins the tokens' raw bytes.

The rank file is read once on the driver and broadcast (its size is checked).
Null texts are empty; an empty text has no ids; rows are independent, so
repeats, ties and extra columns need no rule; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm.common import id_text, slices

#: Largest rank file that is broadcast, characters of a piece of a long text.
RANK_BYTES, PIECE_CHARS = 64 << 20, 1 << 14


class Codec:
    """Built once per task from the rank file's bytes."""

    def __init__(self, ranks: bytes, pattern: str):
        import base64

        import regex
        import tiktoken
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.match = regex.compile(pattern)
        self.safe = regex.compile(r"(?<=\p{L})(?= \p{L})")

    def pieces(self, text: str):
        """The text cut at safe boundaries, pieces of about PIECE_CHARS; True
        with those that are longer for want of a boundary."""
        lo, n = 0, len(text)
        while n - lo > PIECE_CHARS:
            cut = self.safe.search(text, lo + PIECE_CHARS)
            hi = cut.start() if cut else n
            yield text[lo:hi], hi - lo > 2 * PIECE_CHARS
            lo = hi
        if lo < n:
            yield text[lo:], False

    def encode(self, text: str) -> list[int]:
        if len(text) <= PIECE_CHARS:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        for piece, long in self.pieces(text):
            if long:
                for m in self.match.finditer(piece):
                    out.extend(self.encoding._encode_single_piece(m.group()))
            else:
                out.extend(self.encoding.encode_ordinary(piece))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def _encoder(ranks, pattern: str, decoded: bool):
    def run(batches):
        codec = Codec(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                raw = [np.array(x, "<u4").tobytes() for x in ids]
                out = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(raw, pa.binary())]
                if decoded:
                    out.append(pa.array([codec.decode(np.frombuffer(x, "<u4").tolist()) for x in raw], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids", "decoded"][: len(out)])
    return run


def _decoder(ranks, pattern: str):
    def run(batches):
        codec = Codec(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch, "ids"):
                texts = [codec.decode(np.frombuffer(x, "<u4").tolist()) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])
    return run


def _ranks(spark, path: str):
    with open(path, "rb") as f:
        ranks = f.read(RANK_BYTES + 1)
    if len(ranks) > RANK_BYTES:
        raise ValueError(f"{path} is larger than {RANK_BYTES} bytes")
    return spark.sparkContext.broadcast(ranks)


def encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers); with
    ``decoded`` also the bytes that the ids decode to, in the same task."""
    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded
    return id_text(df, id_col, text_col).mapInArrow(_encoder(_ranks(df.sparkSession, rank_path), pattern, decoded), schema)


def decode(tokens: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) with ``decoded``, the raw bytes: for stored ids."""
    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(_decoder(_ranks(tokens.sparkSession, rank_path), pattern), "doc_id long, n_tokens long, ids binary, decoded binary")
