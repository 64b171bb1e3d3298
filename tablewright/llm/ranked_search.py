"""Ranked lexical search, reversed: the items (queries) form the index, the
documents stream through it.

1. The items' distinct terms go to blocks of some BLOCK_POSTINGS (item, term)
   pairs; a block's inverted index (term -> items) is broadcast.  One block is
   usual; the documents are read once for each.
2. Documents are cut into terms once: length and (term, occurrences) of the
   block's terms only, written to the shared folder.  Numbers of documents and
   terms and the document frequencies are sums over that table.
3. The written counts stream through the index with the weights.  A task holds
   for each item a heap of its k best documents; a score below an item's k-th
   goes at once, so a task gives k rows an item at most.
4. The tasks' heaps are merged, first in 32 buckets an item, then over all.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII;
only A-Z are lower-cased.  With N documents that have a term, L terms in all, n
terms in a document, df documents with a term and tf occurrences, a term weighs
w = floor(1000 ln((2N + 2) / (2df + 1))), and a document scores the sum over
the item's terms of w * (10**9 tf div (1000 tf + 8 (10 + 90 n N div L))).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import id_text, slices, stage, with_id
from tablewright.llm.textvec import word_array

#: Pairs (item, term) in one broadcast index, about.
BLOCK_POSTINGS = 2_000_000
#: Products (document, term, item) summed in one numpy step, about.
STEP = 1 << 20
MERGE_BUCKETS = 32
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Index:
    """Inverted index of one block: ``terms`` (Arrow), the items of term t at
    ``items[first[t]:first[t + 1]]`` as places in ``ids``."""

    def __init__(self, pairs: pa.Table):
        pairs = pairs.combine_chunks()
        one = lambda c: c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)
        item, term = one(pairs.column("item_id")), one(pairs.column("term")).cast(pa.large_binary()).dictionary_encode()
        self.ids = pc.unique(item)
        item = pc.index_in(item, value_set=self.ids).to_numpy().astype(np.int64)
        self.terms, t = term.dictionary, term.indices.to_numpy()
        order = np.argsort(t, kind="stable")
        self.items, self.first = item[order], np.searchsorted(t[order], np.arange(len(self.terms) + 1))


def _term_counts(docs: DataFrame, index) -> DataFrame:
    """doc_id, n (terms in the text) and its terms of the index with their occurrences."""
    def run(batches):
        terms = index.value.terms
        byte = np.arange(256)
        other = (byte < 48) | ((byte > 57) & (byte < 65)) | ((byte > 90) & (byte < 97)) | ((byte > 122) & (byte < 128))
        lower = np.where((byte > 64) & (byte < 91), byte + 32, byte).astype(np.uint8)
        for batch in batches:
            for part in slices(batch, "text"):
                words, first = word_array(part.column(1), other, lower)
                coded = words.dictionary_encode()
                known = pc.fill_null(pc.index_in(coded.dictionary, value_set=terms), -1).to_numpy().astype(np.int64)
                t = known[coded.indices.to_numpy()]
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                key, tf = np.unique((row * len(terms) + t)[t >= 0], return_counts=True)
                at, term = np.divmod(key, max(len(terms), 1))
                off = pa.array(np.searchsorted(at, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), pa.ListArray.from_arrays(off, pa.array(term.astype(np.int32))),
                                                  pa.ListArray.from_arrays(off, pa.array(tf.astype(np.int64)))], ["doc_id", "n", "terms", "tfs"])

    return stage(docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>"), "term-counts")


class Heaps:
    """The k best (score, document) of each item, equal scores by ascending id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.zeros(items, np.int64)
        self.item, self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, item, score, doc, null) -> None:
        good = (score > 0) & (score >= self.floor[item])
        if not good.any():
            return
        item, score, doc, null = (np.concatenate([a, b[good]]) for a, b in ((self.item, item), (self.score, score), (self.doc, doc), (self.null, null)))
        o = np.lexsort((doc, null, -score, item))
        item = item[o]
        place = np.arange(len(o)) - np.searchsorted(item, item)
        o, item = o[place < self.k], item[place < self.k]
        self.item, self.score, self.doc, self.null = item, score[o], doc[o], null[o]
        last = place[place < self.k] == self.k - 1
        self.floor[item[last]] = self.score[last]


def _score(counts: DataFrame, index, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    def run(batches):
        ix = index.value
        heaps, width = Heaps(len(ix.ids), k), np.diff(ix.first)
        for batch in batches:
            n = batch.column(1).to_pylist()
            norm = np.array([8 * (10 + 90 * x * n_docs // n_terms) for x in n], np.int64)
            terms, tfs = batch.column(2), batch.column(3)
            off = np.asarray(terms.offsets) - terms.offsets[0].as_py()
            t, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), np.diff(off))
            gain = weights[t] * (1_000_000_000 * tf // (1000 * tf + norm[row]))
            doc, null = pc.fill_null(batch.column(0), 0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            grown = np.cumsum(width[t])
            lo = 0
            while lo < len(n):
                done = int(grown[off[lo] - 1]) if off[lo] else 0
                # as many whole documents as give about STEP products
                hi = max(lo + 1, int(np.searchsorted(off, np.searchsorted(grown, done + STEP), "right")) - 1)
                a, b = off[lo], off[hi]
                if b > a:
                    size = width[t[a:b]]
                    each = np.repeat(np.arange(a, b), size)
                    item = ix.items[np.repeat(ix.first[t[a:b]] - np.cumsum(size) + size, size) + np.arange(len(each))]
                    code, key = pd.factorize(row[each] * len(ix.ids) + item)
                    g = gain[each]
                    # sums of both halves are exact in doubles
                    score = (np.bincount(code, g >> 20).astype(np.int64) << 20) + np.bincount(code, g & ((1 << 20) - 1)).astype(np.int64)
                    at, item = np.divmod(key, len(ix.ids))
                    heaps.offer(item, score, doc[at], null[at])
                lo = hi
        yield pa.RecordBatch.from_arrays([ix.ids.take(pa.array(heaps.item)), pa.array(heaps.doc, mask=heaps.null), pa.array(heaps.score)], ["item_id", "doc_id", "score"])

    return counts.mapInArrow(run, "item_id long, doc_id long, score long")


def _top(df: DataFrame, k: int, *by: str) -> DataFrame:
    w = Window.partitionBy("item_id", *by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_id_col: str = "item_id",
                  text_col: str = "text", block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """Each item's ``k`` best documents with a score above 0: item_id, rank (from 1),
    doc_id, score; equal scores by ascending doc_id, a null id last.

    Null texts and texts without a term count for nothing; an item without terms
    has no rows.  Items with one id (or none) are one item; documents are rows,
    so a repeated row ranks twice.  Without documents or items there are no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    with_id(with_id(items, item_id_col), text_col)
    words = F.regexp_extract_all(F.translate(F.col(f"`{text_col}`").cast("string"), UPPER, LOWER), F.lit(TERM), 0)
    pairs = stage(items.select(F.col(f"`{item_id_col}`").cast("long").alias("item_id"), F.explode(words).alias("term")).distinct(), "item-terms")
    blocks = max(1, math.ceil(pairs.count() / block_postings))
    texts, found = id_text(docs, id_col, text_col), []
    for block in range(blocks):
        index = Index(pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow())
        if not len(index.ids):
            continue
        shared = spark.sparkContext.broadcast(index)
        counts = _term_counts(texts, shared)
        n_docs, n_terms = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()
        weights = np.zeros(len(index.terms), np.int64)
        weights[df.column("t").to_numpy()] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.column("df").to_pylist()]
        if n_terms:
            found.append(_score(counts, shared, weights, n_docs, n_terms, k))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    best = _top(best.withColumn("bucket", F.spark_partition_id() % MERGE_BUCKETS), k, "bucket")
    return _top(best, k).select("item_id", "rank", "doc_id", "score")
