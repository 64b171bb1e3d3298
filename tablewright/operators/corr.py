"""Correlation matrices in long form (a, b, r), pairwise-complete like pandas.

* Pearson: all pairs in one aggregate pass (covar_pop / (sd_a * sd_b); a
  constant column gives null instead of ANSI's divide-by-zero error).
* Spearman: Pearson of average ranks.  Ranks come from per-column frequency
  tables and distributed running counts (``ranks.running_weight``), joined back
  on the value -- AQE splits a hot value's partition on the row side.
* Kendall tau-b: ``kendall``, a recursive decomposition into bounded blocks.
"""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.kendall import kendall_pairs
from tablewright.operators.ranks import running_weight
from tablewright.schema import as_double
from tablewright.session import ship_by_value
from tablewright.staging import scoped

# The Arrow function below runs on executors: send this module's code
# with the task instead of requiring the package to be installed there.
ship_by_value(sys.modules[__name__])


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def _matrix(spark, cols, vals: dict, sd_pos: dict) -> DataFrame:
    rows = []
    for a in cols:
        for b in cols:
            if a == b:
                r = 1.0 if sd_pos.get(a) else None
            else:
                r = vals.get((a, b), vals.get((b, a)))
            rows.append((a, b, None if r is None or (isinstance(r, float) and math.isnan(r)) else float(r)))
    return spark.createDataFrame(rows, "a string, b string, r double")


def _gram(batches, k: int):
    """Per task the k x k sums of pairwise-complete rows, over Arrow batches of
    centred values: counts, sums, squares and products."""
    import numpy as np
    import pyarrow as pa
    n, sx, sxx, sxy = (np.zeros((k, k)) for _ in range(4))
    for batch in batches:
        x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)]).astype(float)
        there = np.isfinite(x).astype(float)
        x = np.where(there > 0, x, 0.0)
        n += there.T @ there
        sx += x.T @ there
        sxx += (x * x).T @ there
        sxy += x.T @ x
    i, j = np.divmod(np.arange(k * k), k)
    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i, j, n.ravel(), sx.ravel(), sxx.ravel(), sxy.ravel())], ["i", "j", "n", "sx", "sxx", "sxy"])


def _pearson_grid(df: DataFrame, xs: list[Column], means: list[float] | None = None) -> dict:
    """{(i, j): r} for all pairs of the expressions, null where a side is
    constant: one scan for the means, unless they are known, and one for the
    sums, however many pairs."""
    k = len(xs)
    named = df.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)])
    if means is None:
        means = list(named.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(k)]).collect()[0])
    centred = named.select(*[(F.col(f"x{i}") - F.lit(float(means[i] or 0.0))).alias(f"x{i}") for i in range(k)])
    parts = centred.mapInArrow(lambda batches: _gram(batches, k), "i long, j long, n double, sx double, sxx double, sxy double")
    rows = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sxy")]).collect()
    got = {(r["i"], r["j"]): r for r in rows}
    out = {}
    for (i, j), r in got.items():
        t = got[j, i]
        if r["n"]:
            vx, vy = r["sxx"] - r["sx"] ** 2 / r["n"], t["sxx"] - t["sx"] ** 2 / r["n"]
            # sums of a constant leave only what rounding leaves
            if vx > 1e-13 * r["sxx"] and vy > 1e-13 * t["sxx"]:
                out[i, j] = (r["sxy"] - r["sx"] * t["sx"] / r["n"]) / math.sqrt(vx) / math.sqrt(vy)
    return out


def pearson_pairs(df: DataFrame, pairs: list[tuple[str, str]], xs: dict[str, Column] | None = None, mean: float | None = None) -> dict:
    """{pair: r}; ``mean``: the mean of every column, if it is known."""
    names = list(dict.fromkeys(c for p in pairs for c in p))
    if not names:
        return {}
    grid = _pearson_grid(df, [xs[c] if xs else as_double(df, c) for c in names], None if mean is None else [mean] * len(names))
    at = {c: i for i, c in enumerate(names)}
    return {p: grid.get((at[p[0]], at[p[1]])) for p in pairs}


def _sd_positive(df: DataFrame, cols: list[str]) -> dict:
    row = df.agg(*[F.stddev_pop(as_double(df, c)).alias(f"s{i}") for i, c in enumerate(cols)]).collect()[0]
    return {c: (row[f"s{i}"] or 0) > 0 for i, c in enumerate(cols)}


def pearson_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """All pairs, and whether a column varies (for the diagonal), in two scans."""
    grid = _pearson_grid(df, [as_double(df, c) for c in cols])
    vals = {(cols[i], cols[j]): r for (i, j), r in grid.items() if i < j}
    return _matrix(df.sparkSession, cols, vals, {c: (i, i) in grid for i, c in enumerate(cols)})


# ---- ranks -----------------------------------------------------------------

def avg_rank_table(vals: DataFrame, value_col: str = "value") -> DataFrame:
    """(value, rank): average 1-based rank of each value."""
    freq = vals.groupBy(value_col).agg(F.count(F.lit(1)).alias("count")).withColumn("_g", F.lit(0))
    off = running_weight(freq, ["_g"], [value_col], "count")
    ranks = off.select(value_col, (F.col("_below") + (F.col("count") + F.lit(1)) / F.lit(2.0)).alias("rank"))
    return ranks


def _ranked(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows restricted to ``cols`` (as double) with one rank column per column."""
    base = df.select(*[as_double(df, c).alias(f"v{i}") for i, c in enumerate(cols)])
    out = base
    for i, _ in enumerate(cols):
        rt = avg_rank_table(base.select(F.col(f"v{i}").alias("value")).filter("value IS NOT NULL"))
        rt = rt.withColumnRenamed("value", f"v{i}").withColumnRenamed("rank", f"r{i}")
        # adaptive execution picks the join from run-time sizes and splits a hot value
        out = out.join(rt, on=f"v{i}", how="left")
    return out


@scoped
def spearman_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    spark = df.sparkSession
    # one pass: null counts (which pairs share ranks) and whether a column is
    # constant (its ranks are then constant too: null on the diagonal)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(as_double(df, c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(as_double(df, c)).alias(f"s{i}") for i, c in enumerate(cols)]).collect()[0]
    complete = [c for i, c in enumerate(cols) if row[f"n{i}"] == 0]
    sd_pos = {c: (row[f"s{i}"] or 0) > 0 for i, c in enumerate(cols)}
    vals: dict = {}
    pairs = _pairs(complete)
    if pairs:
        rk = _ranked(df, complete)
        xs = {c: F.col(f"r{i}") for i, c in enumerate(complete)}
        # the ranks of n values have the mean (n + 1) / 2
        vals.update(pearson_pairs(rk, pairs, xs, (row["n"] + 1) / 2))
    mixed = [(a, b) for a, b in _pairs(cols) if not (a in complete and b in complete)]
    if mixed:
        vals.update(_spearman_pairwise(df, mixed))
    return _matrix(spark, cols, vals, sd_pos)


def _spearman_pairwise(df: DataFrame, pairs: list[tuple[str, str]]) -> dict:
    """Spearman r for many column pairs, each on its own pairwise-complete
    rows, in one set of jobs whatever the number of pairs.

    Long table (pair, x, y) of complete rows collapsed to (pair, x, y, count);
    per (pair, side) frequency tables ranked by the distributed running count;
    ranks joined back on (pair, value); weighted Pearson of ranks centred on
    their known mean (n+1)/2, grouped by pair."""
    structs = [F.struct(F.lit(i).alias("pair"), as_double(df, a).alias("x"), as_double(df, b).alias("y"))
               for i, (a, b) in enumerate(pairs)]
    pf = (df.select(F.inline(F.array(*structs))).filter("x IS NOT NULL AND y IS NOT NULL")
            .groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w"))).persist()
    try:
        sides = (pf.groupBy("pair", F.col("x").alias("value")).agg(F.sum("w").alias("count"))
                   .withColumn("side", F.lit("x"))
                 .unionByName(pf.groupBy("pair", F.col("y").alias("value")).agg(F.sum("w").alias("count"))
                   .withColumn("side", F.lit("y"))))
        off = running_weight(sides, ["pair", "side"], ["value"], "count")
        rk = off.select("pair", "side", "value",
                        (F.col("_below") + (F.col("count") + F.lit(1)) / F.lit(2.0)
                         - (F.col("_total") + F.lit(1)) / F.lit(2.0)).alias("rc"))
        rx = rk.filter("side = 'x'").select("pair", F.col("value").alias("x"), F.col("rc").alias("rx"))
        ry = rk.filter("side = 'y'").select("pair", F.col("value").alias("y"), F.col("rc").alias("ry"))
        j = pf.join(rx, ["pair", "x"]).join(ry, ["pair", "y"])
        w = F.col("w")
        got = (j.groupBy("pair")
                .agg(F.sum(w * F.col("rx") * F.col("ry")).alias("sxy"),
                     F.sum(w * F.col("rx") * F.col("rx")).alias("sxx"),
                     F.sum(w * F.col("ry") * F.col("ry")).alias("syy"))
                .select("pair", F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))).alias("r"))
                .collect())
    finally:
        pf.unpersist()
    out = {p: None for p in pairs}
    for r in got:
        out[pairs[r["pair"]]] = r["r"]
    return out


# ---- Kendall tau-b -----------------------------------------------------------

def kendall_pair(df: DataFrame, a: str, b: str) -> float | None:
    """Kendall tau-b of two columns on their pairwise-complete rows."""
    return kendall_pairs(df, [(a, b)])[(a, b)]


def kendall_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    vals = kendall_pairs(df, _pairs(cols))
    return _matrix(df.sparkSession, cols, vals, _sd_positive(df, cols))


def corr_matrix(df: DataFrame, cols: list[str], method: str = "pearson") -> DataFrame:
    if method == "pearson":
        return pearson_matrix(df, cols)
    if method == "spearman":
        return spearman_matrix(df, cols)
    if method == "kendall":
        return kendall_matrix(df, cols)
    raise ValueError(f"unknown method {method}")
