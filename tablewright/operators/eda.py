"""Exploratory tables: the data behind each chart of the EDA step.

Everything is computed as bounded results: counts per (column, value) limited
per column, counts per (column, bin), one row of box statistics per column,
and "first n rows" samples taken by an explicit order key (TakeOrdered).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.scalars import bin_edges, hist_bin, to_text
from tablewright.operators.audit import missing_table
from tablewright.operators.stats import fence_stats, iqr_fences, nunique, quantiles
from tablewright.schema import as_double, categorical_cols, dtype_name, numeric_cols, q


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, count): values as text, a missing value counted as 'nan'."""
    structs = [F.struct(F.lit(c).alias("column"),
                        to_text(F.col(q(c)), boolean=isinstance(df.schema[c].dataType, T.BooleanType)).alias("value"))
               for c in cols]
    return (df.select(F.inline(F.array(*structs)))
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))


def top_values(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """(column, rank, value, count): the k most frequent values per column, ties
    by value.  ``row_number() <= k`` lets Spark put a per-partition group limit
    before the shuffle, so no column's full value list meets in one task."""
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return (value_counts(df, cols).withColumn("rank", F.row_number().over(w).cast("long"))
            .filter(F.col("rank") <= k).select("column", "rank", "value", "count"))


def group_mean(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, mean_y) per key, missing key kept as its own group (callers sort
    with ``asc_nulls_last("x")`` for the reference's key order)."""
    return df.groupBy(F.col(q(x)).alias("x")).agg(F.avg(as_double(df, y)).alias("mean_y"))


def quality(df: DataFrame) -> DataFrame:
    """(column, dtype, null_count, unique) for every column."""
    spark = df.sparkSession
    types = spark.createDataFrame([(c, dtype_name(df.schema[c].dataType)) for c in df.columns],
                                  "column string, dtype string")
    m = missing_table(df).select("column", F.col("missing_count").alias("null_count"))
    u = nunique(df, df.columns)
    return types.join(m, "column").join(u, "column")


def missingness(df: DataFrame, top_n: int = 12) -> DataFrame:
    """(column, missing_count): columns with a missing value, most first, top n."""
    return (missing_table(df).filter("missing_count > 0")
            .orderBy(F.desc("missing_count"), F.asc("column")).limit(top_n)
            .select("column", "missing_count"))


def histograms(df: DataFrame, cols: list[str], bins: int = 30) -> DataFrame:
    """(column, bin, lo, hi, count): equal-width bins over [min, max] of each
    column's non-null values, every bin present (empty bins count 0).

    Two scans: min/max of every column in one aggregate (k values brought back
    as literals), then one binning pass grouped by (column, bin)."""
    spark = df.sparkSession
    row = df.agg(*[F.min(as_double(df, c)).alias(f"mn{i}") for i, c in enumerate(cols)],
                 *[F.max(as_double(df, c)).alias(f"mx{i}") for i, c in enumerate(cols)]).collect()[0]
    ranges = {c: (row[f"mn{i}"], row[f"mx{i}"]) for i, c in enumerate(cols) if row[f"mn{i}"] is not None}
    schema = "column string, bin int, lo double, hi double, count long"
    if not ranges:
        return spark.createDataFrame([], schema)
    names = list(ranges)
    structs = [F.struct(F.lit(c).alias("column"),
                        hist_bin(as_double(df, c), F.lit(ranges[c][0]), F.lit(ranges[c][1]), bins).alias("bin"))
               for c in names]
    binned = (df.select(F.inline(F.array(*structs))).filter(F.col("bin").isNotNull())
                .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = spark.createDataFrame([(c, ranges[c][0], ranges[c][1], b) for c in names for b in range(bins)],
                                 "column string, mn double, mx double, bin int")
    lo, hi = bin_edges(F.col("mn"), F.col("mx"), F.col("bin"), bins)
    # grid and counts both have at most k * bins rows
    return (grid.join(binned, ["column", "bin"], "left")
                .select("column", "bin", lo.alias("lo"), hi.alias("hi"),
                        F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def boxplot(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n, q1, median, q3, whisker_lo, whisker_hi, fliers_lo, fliers_hi):
    whiskers are the most extreme values inside Q1-1.5 IQR .. Q3+1.5 IQR,
    fliers the counts outside.  Exact quartiles, then one aggregate."""
    spark = df.sparkSession
    schema = ("column string, n long, q1 double, median double, q3 double, "
              "whisker_lo double, whisker_hi double, fliers_lo long, fliers_hi long")
    if not cols:
        return spark.createDataFrame([], schema)
    qs = quantiles(df, cols, [0.25, 0.5, 0.75])
    fs = fence_stats(df, iqr_fences(qs))
    rows = [(c, int(fs[c]["n"]), qs[c][0.25], qs[c][0.5], qs[c][0.75], fs[c]["whisker_lo"], fs[c]["whisker_hi"],
             int(fs[c]["below"]), int(fs[c]["above"])) for c in cols if c in fs]
    return spark.createDataFrame(rows, schema)


def flier_sample(df: DataFrame, box: DataFrame, k: int = 50) -> DataFrame:
    """(column, rank, value): up to k fliers per column (values outside the
    fences of ``box``), most extreme first.  The per-column limit is applied
    before the shuffle (WindowGroupLimit), so the sample is bounded by k."""
    fences = {r["column"]: (r["q1"] - 1.5 * (r["q3"] - r["q1"]), r["q3"] + 1.5 * (r["q3"] - r["q1"]))
              for r in box.collect()}
    if not fences:
        return df.sparkSession.createDataFrame([], "column string, rank long, value double")
    structs = [F.struct(F.lit(c).alias("column"), as_double(df, c).alias("value"),
                        F.greatest(F.lit(lo) - as_double(df, c), as_double(df, c) - F.lit(hi)).alias("dist"))
               for c, (lo, hi) in fences.items()]
    out = df.select(F.inline(F.array(*structs))).filter(F.col("dist") > 0)
    w = Window.partitionBy("column").orderBy(F.desc("dist"), F.asc("value"))
    return (out.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
               .select("column", "rank", "value"))


def categories(df: DataFrame, max_cols: int = 3, max_levels: int = 15) -> DataFrame:
    """Top levels of the first ``max_cols`` categorical columns."""
    cols = categorical_cols(df)[:max_cols]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, rank int, value string, count long")
    return top_values(df, cols, max_levels)


def head_sample(df: DataFrame, cols: list[str], n: int, order_by: list[str]) -> DataFrame:
    """First n complete rows of ``cols`` by an explicit order key (TakeOrdered:
    each task keeps n rows, the driver merges them)."""
    keep = list(dict.fromkeys(list(cols) + list(order_by)))
    sub = df.select(*[F.col(q(c)) for c in keep]).dropna("any", subset=list(cols))
    return sub.orderBy(*[F.col(q(c)) for c in order_by]).limit(n)


def target_scatter_bins(df: DataFrame, target: str, features: list[str], bins: int = 50) -> DataFrame:
    """(feature, xbin, ybin, count): 2-D binned (feature, target) density for
    every row -- the bounded form of a scatter of all points."""
    t = as_double(df, target)
    parts = [F.struct(F.lit(c).alias("feature"), as_double(df, c).alias("x"), t.alias("y")) for c in features]
    long = df.select(F.inline(F.array(*parts))).dropna("any", subset=["x", "y"])
    rng = long.groupBy("feature").agg(F.min("x").alias("xmn"), F.max("x").alias("xmx"),
                                      F.min("y").alias("ymn"), F.max("y").alias("ymx"))
    return (long.join(F.broadcast(rng), "feature")
                .select("feature", hist_bin(F.col("x"), F.col("xmn"), F.col("xmx"), bins).alias("xbin"),
                        hist_bin(F.col("y"), F.col("ymn"), F.col("ymx"), bins).alias("ybin"))
                .groupBy("feature", "xbin", "ybin").agg(F.count(F.lit(1)).alias("count")))


def numeric_for_eda(df: DataFrame, max_numeric: int) -> list[str]:
    return numeric_cols(df)[:max_numeric]


__all__ = ["value_counts", "top_values", "group_mean", "quality", "missingness", "histograms",
           "boxplot", "flier_sample", "categories", "head_sample", "target_scatter_bins"]
