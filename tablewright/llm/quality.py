"""Quality classifier: histogram gradient-boosted trees over document
statistics.

Statistics come from the text alone (lengths, character classes, repeated
words, lines and shingles), for whole texts, a block of bytes at a time.  The
trees are grown on quantile-binned features of a bounded sample of labelled
rows, level by level from gradient histograms, and flattened into arrays
(feature, threshold, left child; the right one follows it), which numpy walks
for all rows of a batch at once.

Null texts are empty texts; those have statistics and a score as well.  Rows
that repeat are scored each on its own.  Labels that repeat an id count with
their mean, rounded; null labels say nothing.  With no labelled rows, or labels
of one class only, the score is the labels' mean (0.5 without any).  Other
columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import flat, id_text, slices, small_batches, stage, text_udf
from tablewright.llm.textvec import U, WordHasher, mix

#: Most labelled rows that the fit reads (ids in hash order).
FIT_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, L2 = 60, 4, 0.15, 64, 8.0, 1.0
THRESHOLD = 0.3

FEATURES = ["log_bytes", "log_words", "word_bytes", "upper", "lower", "digit", "space", "symbol", "high", "comma_stop", "pipe", "line_words", "log_lines",
            "distinct_words", "distinct_shingles", "repeated_lines", "upper_words", "symbol_words", "short_words", "long_words", "top_word"]


def statistics(arr, hasher: WordHasher) -> np.ndarray:
    """Rows x FEATURES for an Arrow text column."""
    data, off = flat(arr)
    n = len(off) - 1
    out = np.zeros((n, len(FEATURES)))
    starts, ends, first = hasher.spans(data, off)
    words = hasher.hashes(data, starts, ends)
    cls = hasher.classes
    size = np.diff(off).astype(float)
    per_byte = 1 / np.maximum(size, 1)
    counts = np.zeros((n, cls.max() + 1))
    for lo, hi, i in zip(off[:-1].tolist(), off[1:].tolist(), range(n)):
        counts[i] = np.bincount(cls[data[lo:hi]], minlength=counts.shape[1])
    nw = np.diff(first).astype(float)
    per_word = 1 / np.maximum(nw, 1)
    length = (ends - starts).astype(float)
    head = cls[data[starts]] if len(starts) else np.zeros(0, np.uint8)
    tail = cls[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    second = cls[data[np.minimum(starts + 1, ends - 1)]] if len(starts) else np.zeros(0, np.uint8)

    def mean(x):
        total = np.concatenate(([0.0], np.cumsum(x)))
        return (total[first[1:]] - total[first[:-1]]) * per_word

    lines = counts[:, 9] + 1
    columns = [np.log1p(size), np.log1p(nw), mean(length), *(counts[:, c] * per_byte for c in (1, 2, 3, 0, 4, 5)), (counts[:, 6]) * per_byte, counts[:, 7] * per_byte,
               nw / lines, np.log1p(lines)]
    for j, c in enumerate(columns):
        out[:, j] = c
    j = len(columns)
    out[:, j + 3] = mean((head == 1) & (second == 1))
    out[:, j + 4] = mean(tail == 4)
    out[:, j + 5] = mean(length <= 3)
    out[:, j + 6] = mean(length >= 12)
    out[:, j] = out[:, j + 1] = 1.0
    # lines: their words' hashes summed with the place within the line
    breaks = np.flatnonzero(data == 10)
    for i in range(n):
        w = words[first[i]: first[i + 1]]
        if not len(w):
            continue
        _, times = np.unique(w, return_counts=True)
        out[i, j] = len(times) / len(w)
        out[i, j + 7] = times.max() / len(w)
        if len(w) >= 3:
            with np.errstate(over="ignore"):
                tri = w[:-2] + w[1:-1] * U(0x9E3779B97F4A7C15) + w[2:] * U(0xC2B2AE3D27D4EB4F)
            out[i, j + 1] = len(np.unique(tri)) / len(tri)
        own = breaks[np.searchsorted(breaks, off[i]): np.searchsorted(breaks, off[i + 1])]
        if len(own):
            at = np.searchsorted(starts[first[i]: first[i + 1]], own)
            at = np.unique(np.concatenate(([0], at)))
            at = at[at < len(w)]
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(mix(w + np.arange(len(w), dtype=U) - np.repeat(at, np.diff(np.append(at, len(w)))).astype(U)), at)
            out[i, j + 2] = 1 - len(np.unique(sums)) / len(sums)
    return out


# ---- trees ---------------------------------------------------------------

def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> dict:
    """Boosted trees for the logistic loss.  Node arrays of all trees back to
    back; a leaf has feature -1 and its value in ``threshold``."""
    base = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    bias = float(np.log(base / (1 - base)))
    model = {"bias": bias, "feature": np.zeros(0, np.int32), "threshold": np.zeros(0), "left": np.zeros(0, np.int64), "roots": np.zeros(0, np.int64), "depth": depth}
    if len(y) < 2 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    score = np.full(len(y), bias)
    feature, threshold, left, roots = [], [], [], []
    offset = np.arange(x.shape[1]) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        root = len(feature)
        roots.append(root)
        feature.append(-1), threshold.append(0.0), left.append(0)
        level = [(root, np.arange(len(y)))]
        for d in range(depth + 1):
            following = []
            for node, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                value = -gs / (hs + L2)
                best = (1e-6, -1, -1)
                if d < depth and len(rows) >= 2:
                    where = (binned[rows] + offset).ravel()
                    hg = np.bincount(where, np.repeat(g[rows], x.shape[1]), bins * x.shape[1]).reshape(-1, bins).cumsum(1)[:, :-1]
                    hh = np.bincount(where, np.repeat(h[rows], x.shape[1]), bins * x.shape[1]).reshape(-1, bins).cumsum(1)[:, :-1]
                    hn = np.bincount(where, minlength=bins * x.shape[1]).reshape(-1, bins).cumsum(1)[:, :-1]
                    gain = hg ** 2 / (hh + L2) + (gs - hg) ** 2 / (hs - hh + L2) - gs ** 2 / (hs + L2)
                    gain[(hn < LEAST_LEAF) | (len(rows) - hn < LEAST_LEAF)] = 0
                    f, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[f, b] > best[0] and b < len(edges[f]):
                        best = (gain[f, b], f, b)
                if best[1] < 0:
                    threshold[node] = rate * value
                    score[rows] += rate * value
                    continue
                _, f, b = best
                feature[node], threshold[node], left[node] = int(f), float(edges[f][b]), len(feature)
                goes = binned[rows, f] <= b
                for part in (rows[goes], rows[~goes]):
                    following.append((len(feature), part))
                    feature.append(-1), threshold.append(0.0), left.append(0)
            level = following
    return model | {"feature": np.array(feature, np.int32), "threshold": np.array(threshold), "left": np.array(left, np.int64), "roots": np.array(roots, np.int64)}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores of many rows: all trees are walked a level at a time."""
    total = np.full(len(x), model["bias"])
    if len(model["roots"]) and len(x):
        feature, threshold, left = model["feature"], model["threshold"], model["left"]
        row = np.arange(len(x))
        for root in model["roots"]:
            node = np.full(len(x), root)
            for _ in range(model["depth"]):
                f = feature[node]
                inner = f >= 0
                go = left[node] + (x[row, np.maximum(f, 0)] > threshold[node])
                node = np.where(inner, go, node)
            total += threshold[node]
    return 1 / (1 + np.exp(-total))


# ---- Spark ---------------------------------------------------------------

def _statistics(batches):
    hasher = WordHasher()
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            x = statistics(part.column(1), hasher)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "x"])


def _scorer(model):
    def run(batches):
        m, hasher = model.value, WordHasher()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(predict(m, statistics(part.column(1), hasher)))], ["doc_id", "score"])
    return run


def held_out(doc_id):
    """Whether a row is kept from learning."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> dict:
    """A model from at most ``fit_rows`` labelled rows that are not held out."""
    y = (labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("double").alias("y"))
         .where("doc_id IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("doc_id")))
         .groupBy("doc_id").agg(F.round(F.avg("y")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    y = stage(y, "quality-labels")
    rows = id_text(df, id_col, text_col).join(F.broadcast(y), "doc_id").select("doc_id", "text", "y")
    x = rows.select("doc_id", "text").mapInArrow(_statistics, "doc_id long, x array<double>").join(F.broadcast(y), "doc_id")
    # bounded by fit_rows, up to rows that repeat an id
    got = x.groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y")).orderBy("doc_id").collect()
    return fit_trees(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["y"] for r in got]))


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = id_text(df, id_col, text_col).mapInArrow(_scorer(shared), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the classifier accepts, all columns as they were.
    Only the texts go to Python, only scores come back."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m, hasher = shared.value, WordHasher()
        return lambda arr: pa.array(predict(m, statistics(arr, hasher)))

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return df.where(text_udf(make, "double")(text) >= THRESHOLD)
