"""Dataset-level figures (KPIs, missing cells) and the per-column profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.parse import coerce_datetime_candidates
from tablewright.operators.corr import pearson_matrix
from tablewright.operators.stats import agg_chunks, duplicate_count, freq_table, kpi_counts, long_values, nunique, quantiles, skew_expr
from tablewright.schema import as_double, dtype_name, is_missing, nan_to_null, numeric_cols, q
from tablewright.staging import scoped, staged


def missing_cells(df: DataFrame) -> DataFrame:
    """One row: total null cells over all columns."""
    total = None
    for c in df.columns:
        e = F.count_if(is_missing(df, c))
        total = e if total is None else total + e
    return df.agg(total.cast("long").alias("missing_cells"))


def dataset_kpis(df: DataFrame, target: str | None = None) -> DataFrame:
    """rows, cols, missing cells and share (2 dp, over max(1, rows*cols)),
    duplicate rows, target type -- as numbers and as display text."""
    cols = len(df.columns)
    rows, missing, dups = kpi_counts(df)
    pct = missing * 100.0 / max(1, rows * cols)
    ttype = dtype_name(df.schema[target].dataType) if target and target in df.columns else "-"
    data = [(rows, cols, missing, round(pct, 2), dups, ttype, f"{rows:,}", f"{cols:,}", f"{pct:.2f}%", f"{dups:,}")]
    return df.sparkSession.createDataFrame(
        data, "rows long, cols int, missing long, missing_pct double, duplicates long, target_type string, "
              "rows_text string, cols_text string, missing_pct_text string, duplicates_text string")


# Alert thresholds of the profile table.
ALERT_MISSING_PCT = 20.0
ALERT_ZEROS_PCT = 50.0
ALERT_SKEW_ABS = 1.0
ALERT_HIGH_CARD_PCT = 50.0


# Values that the frequent-items summary of a column tracks, and how many it names.
TRACKED, NAMED = 10_000, 64


def _named(row: dict, i: int, n: int, top_k: int) -> tuple[list[int], float]:
    """The summary's candidates for a column's top values, by hash, and a number of
    occurrences that no other value exceeds; no candidates where that number
    can't separate them.  A summary of m tracked values is off by 3.5 n / m at
    most, and leaves out what it can't tell from that."""
    items = [r for r in row[f"top{i}"] or [] if r["item"] is not None]
    bound = 2 * 3.5 * n / TRACKED
    if len(row[f"top{i}"] or []) >= NAMED:
        bound = max(bound, items[-1]["count"])
    clear = len(items) >= top_k and items[top_k - 1]["count"] > bound
    return ([r["item"] for r in items] if clear else []), bound


def _top_values(df: DataFrame, row: dict, top_k: int) -> tuple[dict, dict]:
    """({column: distinct values}, {column: [(value, count)]}).  Columns with
    clear frequent values are settled by an exact recount of the candidates, so
    their values are shuffled for the distinct count alone; all other columns
    get one frequency table, written once, for both."""
    cols, n = df.columns, row["__n"]
    named = {c: _named(row, i, n, top_k) for i, c in enumerate(cols)}
    asked = [c for c in cols if named[c][0]]
    tops: dict = {}
    if asked:
        pairs = df.sparkSession.createDataFrame([(c, h) for c in asked for h in named[c][0]], "column string, hash long")
        exact = long_values(df, asked, numeric=False).withColumn("hash", F.xxhash64("value")).join(F.broadcast(pairs), ["column", "hash"], "left_semi")
        for r in exact.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")).collect():
            tops.setdefault(r["column"], []).append((r["value"], r["count"]))
        for c in asked:
            best = sorted(tops.pop(c, []), key=lambda r: (-r[1], r[0]))[:top_k]
            if len(best) == top_k and best[-1][1] > named[c][1]:
                tops[c] = best
    settled, rest = list(tops), [c for c in cols if c not in tops]
    distinct = {r["column"]: r["unique"] for r in nunique(df, settled).collect()} if settled else {}
    if rest:
        freq = staged(freq_table(df, rest, numeric=False), "profile-values")
        distinct |= {r["column"]: r["d"] for r in freq.groupBy("column").agg(F.count(F.lit(1)).alias("d")).collect()}
        w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
        for r in freq.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= top_k).orderBy("column", "rk").collect():
            tops.setdefault(r["column"], []).append((r["value"], r["count"]))
    return distinct, tops


@scoped
def column_profile(df: DataFrame, top_k: int = 5) -> DataFrame:
    """Per column: type, count, nulls, distinct, zeros, negatives, mean, sd,
    min, quartiles, max, skew, kurtosis, text lengths, top values, alerts.  NaN
    is a missing value.

    One aggregate pass for moments, counts and frequent-item summaries, one
    recount or frequency pass for top values, one quantile pass; every result
    is k rows.
    """
    df = nan_to_null(df)
    df = df.select(*[(F.col(q(f.name)) + F.lit(0.0).cast(f.dataType)).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(q(f.name))
                     for f in df.schema.fields])  # -0.0 is 0.0
    spark = df.sparkSession
    num = numeric_cols(df)
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        col = F.col(q(c))
        aggs += [F.count(col).alias(f"c{i}"), F.call_function("approx_top_k", F.when(col.isNotNull(), F.xxhash64(col.cast("string"))), F.lit(NAMED), F.lit(TRACKED)).alias(f"top{i}")]
        if c in num:
            v = as_double(df, c)
            aggs += [F.count_if(v == 0).alias(f"z{i}"), F.count_if(v < 0).alias(f"ng{i}"),
                     F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"mn{i}"),
                     F.max(v).alias(f"mx{i}"), skew_expr(v).alias(f"sk{i}"), F.kurtosis(v).alias(f"k{i}")]
        elif isinstance(df.schema[c].dataType, T.StringType):
            ln = F.length(col)
            aggs += [F.min(ln).alias(f"ln{i}"), F.max(ln).alias(f"lx{i}"), F.avg(ln).alias(f"la{i}")]
    row = agg_chunks(df, aggs)
    n = row["__n"]
    qs = quantiles(df, num, [0.25, 0.5, 0.75]) if num else {}
    distinct, tops = _top_values(df, row, top_k)
    out = []
    for i, c in enumerate(cols):
        cnt = row[f"c{i}"]
        nulls = n - cnt
        d = int(distinct.get(c, 0))
        isnum = c in num
        z = row[f"z{i}"] if isnum else None
        ng = row[f"ng{i}"] if isnum else None
        qq = qs.get(c, {})
        alerts = []
        if n and nulls * 100.0 / n > ALERT_MISSING_PCT:
            alerts.append("missing")
        if d == 1:
            alerts.append("constant")
        if isnum and cnt and z * 100.0 / cnt > ALERT_ZEROS_PCT:
            alerts.append("zeros")
        sk = row[f"sk{i}"] if isnum else None
        if sk is not None and abs(sk) >= ALERT_SKEW_ABS:
            alerts.append("skewed")
        if not isnum and cnt and d * 100.0 / cnt > ALERT_HIGH_CARD_PCT and d > 1:
            alerts.append("high_cardinality")
        is_text = isinstance(df.schema[c].dataType, T.StringType)
        out.append((c, dtype_name(df.schema[c].dataType), int(cnt), int(nulls), d,
                    None if z is None else int(z), None if ng is None else int(ng),
                    row[f"m{i}"] if isnum else None, row[f"s{i}"] if isnum else None,
                    row[f"mn{i}"] if isnum else None, qq.get(0.25), qq.get(0.5), qq.get(0.75),
                    row[f"mx{i}"] if isnum else None, sk, row[f"k{i}"] if isnum else None,
                    row[f"ln{i}"] if is_text else None, row[f"lx{i}"] if is_text else None,
                    row[f"la{i}"] if is_text else None, ", ".join(f"{v} ({m})" for v, m in tops.get(c, [])), ", ".join(alerts)))
    return spark.createDataFrame(out, (
        "column string, dtype string, count long, nulls long, distinct long, zeros long, negatives long, "
        "mean double, sd double, min double, q1 double, median double, q3 double, max double, skew double, "
        "kurtosis double, len_min int, len_max int, len_mean double, top_values string, alerts string"))


def full_profile(df: DataFrame, order_by: list[str], top_k: int = 5) -> dict[str, DataFrame]:
    """The profile of a table whose text columns of dates became timestamps (one
    layout per column, from its first value by ``order_by``): ``columns``
    (``column_profile``), ``duplicates`` (one row: rows that repeat another) and
    ``correlations`` (Pearson, all pairs of numeric columns)."""
    df = coerce_datetime_candidates(df, order_by)
    return {"columns": column_profile(df, top_k),
            "duplicates": df.sparkSession.createDataFrame([(duplicate_count(df),)], "duplicates long"),
            "correlations": pearson_matrix(df, numeric_cols(df))}
