"""Data audit: missing values, text columns that parse as numbers or dates,
IQR outliers.  Each table is one aggregate pass (outliers: a quantile pass and
a counting pass) over the whole input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.parse import parse_num, parse_ts
from tablewright.operators.stats import AGG_CHUNK, fence_stats, iqr_fences, quantiles
from tablewright.schema import is_missing, numeric_cols, q, text_cols


def _unpivot_row(one_row: DataFrame, fields: list[tuple[str, list[tuple[str, str]]]]) -> DataFrame:
    """Turn a one-row aggregate into one row per column.

    ``fields`` = [(column name, [(output name, aggregate alias), ...]), ...]."""
    structs = [F.struct(F.lit(name).alias("column"),
                        *[F.col(alias).alias(out) for out, alias in pairs])
               for name, pairs in fields]
    return one_row.select(F.inline(F.array(*structs)))


def column_position(cols: list[str]) -> Column:
    """Schema position of the row's ``column`` -- the tie-break of the audit
    sorts (a stable two-key sort keeps the original column order)."""
    return F.element_at(F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))]),
                        F.col("column"))


def _chunks(cols: list[str], per: int):
    for i in range(0, len(cols), per):
        yield cols[i:i + per]


def missing_table(df: DataFrame) -> DataFrame:
    """(column, missing_count, missing_pct) for every column (unfiltered).

    Wide tables are aggregated in column chunks (each chunk scans only its own
    columns) and the per-chunk rows unioned."""
    parts = []
    for cols in _chunks(df.columns, AGG_CHUNK):
        aggs = [F.count(F.lit(1)).alias("__n")]
        aggs += [F.count_if(is_missing(df, c)).alias(f"__m{i}") for i, c in enumerate(cols)]
        one = df.agg(*aggs)
        parts.append(_unpivot_row(one, [(c, [("missing_count", f"__m{i}"), ("rows", "__n")])
                                        for i, c in enumerate(cols)]))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    pct = F.round(F.try_divide(F.col("missing_count").cast("double"), F.col("rows")) * 100.0, 2)
    return long.select("column", F.col("missing_count").cast("long").alias("missing_count"),
                       pct.alias("missing_pct"))


def audit_missing(df: DataFrame) -> DataFrame:
    """Columns with a missing value, most missing first."""
    return (missing_table(df).filter(F.col("missing_count") > 0)
            .orderBy(F.desc("missing_pct"), F.desc("missing_count"), column_position(df.columns)))


def parse_ratio_exprs(c: str, i: int) -> list[Column]:
    col = F.col(q(c))
    return [F.count(col).alias(f"__nn{i}"),
            F.count(parse_num(col)).alias(f"__pn{i}"),
            F.count(parse_ts(col)).alias(f"__pt{i}")]


def audit_coercion(df: DataFrame) -> DataFrame:
    """(column, numeric_parse_pct, datetime_parse_pct, sample_dtype) for text
    columns: share of non-null values that parse, 0 when all null."""
    cols = text_cols(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, numeric_parse_pct double, "
                                         "datetime_parse_pct double, sample_dtype string")
    parts = []
    for chunk in _chunks(cols, AGG_CHUNK // 3):
        aggs = []
        for i, c in enumerate(chunk):
            aggs += parse_ratio_exprs(c, i)
        one = df.agg(*aggs)
        parts.append(_unpivot_row(one, [(c, [("nn", f"__nn{i}"), ("pn", f"__pn{i}"), ("pt", f"__pt{i}")])
                                        for i, c in enumerate(chunk)]))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)

    def pct(x):
        return F.round(F.coalesce(F.try_divide(F.col(x).cast("double"), F.col("nn")), F.lit(0.0)) * 100.0, 2)

    return (long.select("column", pct("pn").alias("numeric_parse_pct"),
                        pct("pt").alias("datetime_parse_pct"),
                        F.lit("string").alias("sample_dtype"))
            .orderBy(F.desc("numeric_parse_pct"), F.desc("datetime_parse_pct"), column_position(cols)))


def iqr_bounds(df: DataFrame, cols: list[str]) -> dict:
    """{column: (q1, q3, lo, hi)} over non-null values; all-null columns absent."""
    qs = quantiles(df, cols, [0.25, 0.75])
    out = {}
    for c in cols:
        if c not in qs:
            continue
        q1, q3 = qs[c][0.25], qs[c][0.75]
        iqr = q3 - q1
        out[c] = (q1, q3, q1 - 1.5 * iqr, q3 + 1.5 * iqr)
    return out


def audit_outliers(df: DataFrame) -> DataFrame:
    """(column, outliers, outlier_pct): values outside Q1-1.5 IQR .. Q3+1.5 IQR
    (strict on both sides), share of non-null values; IQR 0 -> 0 outliers.

    Exact quartiles, then one aggregate for the counts outside the fences."""
    cols = numeric_cols(df)
    spark = df.sparkSession
    schema = "column string, outliers long, outlier_pct double"
    if not cols:
        return spark.createDataFrame([], schema)
    qs = quantiles(df, cols, [0.25, 0.75])
    fs = fence_stats(df, iqr_fences(qs))
    rows = []
    for c in cols:
        if c not in fs:
            continue  # all-null column
        iqr = qs[c][0.75] - qs[c][0.25]
        out = 0 if iqr == 0 else int(fs[c]["below"] + fs[c]["above"])
        rows.append((c, out, round(out / fs[c]["n"] * 100.0, 2)))
    t = spark.createDataFrame(rows, schema)
    return t.orderBy(F.desc("outlier_pct"), F.desc("outliers"), column_position(cols))


def audit_dataset(df: DataFrame) -> dict[str, DataFrame]:
    return {"missing": audit_missing(df),
            "coercion_candidates": audit_coercion(df),
            "outliers": audit_outliers(df)}
