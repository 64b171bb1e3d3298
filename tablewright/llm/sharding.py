"""Uniform shuffle into shards of exact sizes by a hypergeometric communication
matrix.

The output is cut into cells: every shard is a run of ``cells`` consecutive
cells, all sizes fixed beforehand (shards differ by one row at most, cells of a
shard as well).  How many rows each input partition sends to each cell is drawn
from the multivariate hypergeometric distribution given the partition's row
count and the cells' sizes, which is how a uniform permutation would deal them.
Each partition then permutes its rows locally and cuts them into runs of those
lengths, the runs are exchanged, and each cell permutes what it received.  The
result is a uniform shuffle in which no task holds more than one input
partition or one cell.

Rows are first written with their partition and position, so a retried task
meets the same rows in the same order; every random order is a hash of those
and the seed.  The driver handles partitions x cells numbers, never rows.

Null and empty values, repeated rows and rows that agree in every column are
ordinary rows: each gets its own slot.  An empty table gives an empty result.
Input columns called ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import id_text, stage


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``n`` draws without replacement are good.  Inversion over the
    support within 40 standard deviations of the mode (all of it, if that is
    less); what lies beyond has no weight in double precision."""
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), lo), hi)
    sd = math.sqrt(n * (good / total) * (bad / total) * (total - n) / max(total - 1, 1))
    reach = int(40 * sd) + 40
    a, b = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    step = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    weight = np.concatenate(([0.0], np.cumsum(step)))
    weight = np.cumsum(np.exp(weight - weight.max()))
    return a + int(np.searchsorted(weight, rng.random() * weight[-1], "right").clip(0, b - a))


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> np.ndarray:
    """Row i, column j: how many rows partition i sends to cell j.  Row and
    column sums are as given."""
    assert sum(rows) == sum(columns)
    left = np.array(columns, np.int64)
    out = np.zeros((len(rows), len(columns)), np.int64)
    for i, n in enumerate(rows):
        rng = np.random.default_rng([seed, i])
        rest = int(left.sum())
        for j in range(len(columns)):
            if not n:
                break
            good = int(left[j])
            x = hypergeometric(good, rest - good, n, rng)
            out[i, j] = x
            n -= x
            rest -= good
        left -= out[i]
    return out


def even_sizes(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def shuffle_into_shards(df: DataFrame, n_shards: int = 8, seed: int = 20, cells: int | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (0 to the shard's
    size - 1).  ``cells``: cells per shard; by default as many as give the
    session's number of shuffle partitions in all."""
    spark = df.sparkSession
    cells = cells or max(1, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / n_shards))
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    rows = stage(df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("r"), F.spark_partition_id().alias("part"),
                           F.monotonically_increasing_id().alias("pos")), "shard-rows", "zstd")  # whole rows: the largest share of the disk after the exchanges
    counts = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())
    total = sum(n for _, n in counts)
    shard_sizes = even_sizes(total, n_shards)
    matrix = communication_matrix([n for _, n in counts], [x for s in shard_sizes for x in even_sizes(s, cells)], seed)

    # a marker where each run begins, among the partition's rows in their first random order
    begins = np.cumsum(matrix, axis=1) - matrix + 1
    at, cell = np.nonzero(matrix)
    part = np.array([p for p, _ in counts] or [0])
    marks = [(int(part[i]), int(begins[i, j]), int(j)) for i, j in zip(at, cell)]
    mark_df = spark.createDataFrame(marks, "part int, begin long, cell int").select(
        "part", F.lit(1).alias("mark"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("h"), "begin", "cell",
        F.lit(None).cast(rows.schema["r"].dataType).alias("r"))
    row_df = rows.select("part", F.lit(0).alias("mark"), "pos", F.xxhash64(F.lit(seed), "part", "pos").alias("h"),
                         F.lit(None).cast("long").alias("begin"), F.lit(None).cast("int").alias("cell"), "r")
    first = Window.partitionBy("part").orderBy("mark", "h", "pos")
    runs = Window.partitionBy("part").orderBy("place", F.desc("mark")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sent = (row_df.unionByName(mark_df)
            .withColumn("place", F.coalesce("begin", F.row_number().over(first).cast("long")))
            .withColumn("cell", F.last("cell", ignorenulls=True).over(runs))
            .where("mark = 0").select("r", "part", "pos", "cell"))

    second = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed + 1), "part", "pos"), "part", "pos")
    shard = F.floor(F.col("cell") / cells).cast("int")
    k = F.col("cell") % cells
    size = F.lit(total // n_shards) + F.when(shard < total % n_shards, 1).otherwise(0)
    before = k * F.floor(size / cells) + F.least(k, size % cells)
    return (sent.withColumn("rn", F.row_number().over(second))
            .select("r.*", shard.alias("shard"), (before + F.col("rn") - 1).cast("long").alias("slot")))


def digest(df: DataFrame, *keep: str) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1; a null text has none) and the CRC-32 of
    the text (null counts as empty), then the columns ``keep`` as they are."""
    t = id_text(df, keep=keep)
    return t.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), *keep)
