"""Ordered positions without a single-task window.

``Window.orderBy`` without a partition key (or partitioned by a column name
in a long table) sends a whole column to one task.  ``running_weight`` gives
the same answer -- for every row, the total weight of the rows before it in its
group -- with work split by value range, at every size:

1. the input is range-partitioned on (group, order...), tagged with its
   partition id and written to the shared folder, so the tags cannot change if
   an executor is lost and the stage is recomputed;
2. per (partition, group) totals -- at most partitions + groups rows, a proven
   bound -- give each slice's offset by a window over that small table;
3. a window partitioned by (partition, group) gives local running sums; the
   slices are balanced because the range partitioner sampled the keys, and a
   slice larger than memory spills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.staging import staged


def _range_slices(df: DataFrame, keys: list[str], n_slices: int | None) -> DataFrame:
    n = n_slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(max(1, n), *[F.col(k) for k in keys])
                    .withColumn("_slice", F.spark_partition_id()), "range-slices")


def running_weight(df: DataFrame, group_cols: list[str], order_cols: list[str],
                   weight_col: str | None = None, n_slices: int | None = None) -> DataFrame:
    """Add ``_below`` (weight of earlier rows in the group) and ``_total``.

    Order is ``order_cols`` ascending; they should make rows unique (a frequency
    table or a key column).  ``n_slices``: by default the session's number of
    shuffle partitions.
    """
    w = F.col(weight_col) if weight_col else F.lit(1)
    order = [F.col(c) for c in order_cols]
    sliced = _range_slices(df.withColumn("_w", w.cast("long")), group_cols + order_cols, n_slices)
    per_slice = sliced.groupBy("_slice", *group_cols).agg(F.sum("_w").alias("_sw"))
    gw = Window.partitionBy(*group_cols).orderBy("_slice")
    offsets = (per_slice
               .withColumn("_off", F.coalesce(
                   F.sum("_sw").over(gw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("_total", F.sum("_sw").over(Window.partitionBy(*group_cols)))
               .drop("_sw"))
    local = Window.partitionBy("_slice", *group_cols).orderBy(*order)
    with_local = sliced.withColumn("_lb", F.coalesce(
        F.sum("_w").over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = with_local.join(offsets, on=["_slice", *group_cols], how="inner")
    return (out.withColumn("_below", F.col("_off") + F.col("_lb"))
               .drop("_off", "_lb", "_w", "_slice"))
