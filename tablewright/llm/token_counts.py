"""Unigram token counts by trie-shared dynamic programming.

Nothing of a text is lost: the text with a word-start mark before it and for
every space is cut into pre-tokens where no piece can cross (before a run of
marks, around runs of tabs and line breaks that no piece holds), so their counts
add up to those of the whole text.  The distinct pre-tokens of a block of texts
go into a trie, and a best-score table over prefixes is computed along it: the entry of a node (best
score and number of tokens of any segmentation of that prefix) depends on its
prefix only, so pre-tokens share it for every common prefix, and a pre-token's
result is read at its terminal node.  The trie is walked as the sorted list of
its words, keeping the entries along the current path.

Vocabulary and order come from a sentencepiece model file; a piece's score is
the logarithm of Zipf's law at its rank.  A character outside the vocabulary
costs its UTF-8 bytes, as tokens of their own with the lowest score.  Equal
scores go to fewer tokens.

With ``words_only`` a pre-token is a mark and a word between white space, and
white space has no tokens.  ``n_pretokens`` counts those words either way.

Null texts are empty; empty texts have no tokens; repeated rows and extra
columns need no rule; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm.common import id_text, slices

MARK = "▁"
#: Largest model file that is broadcast.
MODEL_BYTES = 64 << 20
#: Pre-tokens whose results a task keeps from block to block.
MOST_KNOWN = 500_000


def vocabulary(model: bytes) -> tuple[dict[str, float], float]:
    """Scores of the ordinary pieces, and the score of one byte."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {p: -math.log(r + 2) for r, p in enumerate(pieces)}, -math.log(len(pieces) + 2) - 1.0


def pretoken_pattern(scores: dict[str, float]) -> re.Pattern:
    """Matches are the pre-tokens of a marked text, all of it, in order; no piece
    of the vocabulary reaches from one into the next."""
    alone = "".join(c for c in "\t\n\v\f\r" if not any(c in p for p in scores))
    runs = f"[{alone}]+|" if alone else ""
    if any(MARK in p.lstrip(MARK) for p in scores):  # pieces of several words
        return re.compile(f"{runs}[^{alone}]+" if alone else "(?s:.+)")
    return re.compile(f"{runs}{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+")


class Trie:
    """Counts for sorted pre-tokens; the state is the path of the last word."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte = scores, byte_score
        self.longest = max(map(len, scores), default=1)
        self.ends: dict[str, list[int]] = {}
        for p in scores:  # lengths of pieces by last character: only those are tried at a node
            self.ends.setdefault(p[-1], []).append(len(p))
        self.ends = {c: sorted(set(n)) for c, n in self.ends.items()}
        self.path, self.best, self.count = "", [0.0], [0]

    def terminal(self, text: str) -> tuple[int, float]:
        """Tokens and score of the best segmentation of a pre-token."""
        path, best, count = self.path, self.best, self.count
        n = min(len(path), len(text))
        if path[:n] == text[:n]:
            shared = n
        else:
            shared = next(i for i in range(n) if path[i] != text[i])
        del best[shared + 1:], count[shared + 1:]
        scores, ends = self.scores, self.ends
        for d in range(shared + 1, len(text) + 1):
            c = text[d - 1]
            size = len(c.encode())
            top, tokens = best[d - 1] + size * self.byte, count[d - 1] + size
            for m in ends.get(c, ()):
                if m > d:
                    break
                s = scores.get(text[d - m: d])
                if s is not None:
                    s += best[d - m]
                    k = count[d - m] + 1
                    if s > top or s == top and k < tokens:
                        top, tokens = s, k
            best.append(top)
            count.append(tokens)
        self.path = text
        return count[-1], best[-1]


def _counter(model, words_only: bool):
    def run(batches):
        scores, byte = vocabulary(model.value)
        cut = pretoken_pattern(scores).findall
        trie, seen = Trie(scores, byte), {}
        tokens, score = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            for part in slices(batch, "text", 1 << 23):
                if len(seen) > MOST_KNOWN:  # results are the same without what is known; only memory is bounded
                    trie, seen = Trie(scores, byte), {}
                    tokens, score = np.zeros(0, np.int64), np.zeros(0)
                known, words, plain = len(seen), [], []
                for t in part.column(1).to_pylist():
                    own = t.split()
                    plain.append(len(own))
                    own = [MARK + w for w in own] if words_only else cut(MARK + t.replace(" ", MARK)) if t else []
                    words.append(np.fromiter((seen.setdefault(w, len(seen)) for w in own), np.int64, len(own)))
                new = sorted(w for w, i in itertools.islice(seen.items(), known, None))
                tokens, score = np.append(tokens, np.zeros(len(new), np.int64)), np.append(score, np.zeros(len(new)))
                for w in new:
                    tokens[seen[w]], score[seen[w]] = trie.terminal(w)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(plain, pa.int64()), pa.array([int(tokens[w].sum()) for w in words], pa.int64()),
                    pa.array([float(score[w].sum()) for w in words], pa.float64())], ["doc_id", "n_pretokens", "n_tokens", "score"])
    return run


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", words_only: bool = True) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, score (of the whole text, or of its words)."""
    with open(model_path, "rb") as f:
        model = f.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"{model_path} is larger than {MODEL_BYTES} bytes")
    return id_text(df, id_col, text_col).mapInArrow(_counter(df.sparkSession.sparkContext.broadcast(model), words_only),
                                                    "doc_id long, n_pretokens long, n_tokens long, score double")
