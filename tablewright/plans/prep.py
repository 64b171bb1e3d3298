"""Ordered, reportable preparation: fit once (a few aggregate jobs), then apply
as one lazy projection (+ one distinct).

Steps, in this order (the order is part of the semantics):
1. drop exact duplicate rows;
2. coerce text columns whose non-null values parse as numbers (share >= threshold);
3. expand remaining text columns that parse as dates into _year/_month/_day;
4. drop columns whose missing share is strictly above a limit (if limit > 0);
5. fill numeric nulls with the exact median;
6. fill other nulls with the most frequent value (smallest on ties) or "missing";
7. clip numeric columns to Q1-1.5 IQR .. Q3+1.5 IQR (IQR 0 skipped).

``PrepPlan`` holds only names and literals, so it can be applied to any
DataFrame with the same schema -- a batch table or a stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.parse import parse_num, parse_ts
from tablewright.functions.scalars import clip as clip_expr
from tablewright.operators.stats import (
    agg_chunks, distinct_rows, exact_quantiles, fence_stats, iqr_fences, modes, quantiles,
)
from tablewright.schema import as_double, is_numeric_type, nan_to_null, q, text_cols

# The report keys, and the change labels of the summary table.
REPORT_LISTS = [
    "columns_coerced_numeric", "date_columns_expanded", "columns_dropped_for_missing",
    "numeric_columns_imputed", "categorical_columns_imputed", "outlier_columns_clipped",
]
SUMMARY_LABELS = [
    ("Rows", None), ("Columns", None), ("Duplicates removed", None),
    ("Numeric coercions", "columns_coerced_numeric"),
    ("Date expansions", "date_columns_expanded"),
    ("Dropped high-missing columns", "columns_dropped_for_missing"),
    ("Numeric imputations", "numeric_columns_imputed"),
    ("Categorical imputations", "categorical_columns_imputed"),
    ("Outlier clipping", "outlier_columns_clipped"),
]


@dataclass
class PrepOptions:
    drop_duplicates: bool = True
    coerce_numeric: bool = True
    numeric_threshold: float = 0.9
    expand_dates: bool = True
    datetime_threshold: float = 0.9
    max_missing_pct: float = 0.0
    impute_numeric: bool = True
    impute_categorical: bool = True
    clip_outliers: bool = False


@dataclass
class PrepPlan:
    options: PrepOptions
    coerce: list[str] = field(default_factory=list)
    expand: list[str] = field(default_factory=list)
    drop: list[str] = field(default_factory=list)
    fill_numeric: dict[str, float | None] = field(default_factory=dict)
    fill_categorical: dict[str, Any] = field(default_factory=dict)
    clip: dict[str, tuple[float, float]] = field(default_factory=dict)
    report: dict[str, Any] = field(default_factory=dict)
    # the deduplicated copy written while fitting (reused by apply_preparation)
    deduped: DataFrame | None = field(default=None, repr=False, compare=False)

    # -- application -------------------------------------------------------
    def _coerced(self, df: DataFrame) -> DataFrame:
        cols = []
        for f in df.schema.fields:
            c = F.col(q(f.name))
            cols.append((parse_num(c) if f.name in self.coerce else c).alias(f.name))
        return df.select(*cols)

    def _expanded(self, df: DataFrame) -> DataFrame:
        if not self.expand:
            return df
        order = [c for c in df.columns if c not in self.expand]
        exprs: dict[str, Column] = {c: F.col(q(c)) for c in order}
        for c in self.expand:
            ts = parse_ts(F.col(q(c)))
            for part, fn in (("year", F.year), ("month", F.month), ("day", F.dayofmonth)):
                name = f"{c}_{part}"
                if name not in exprs:
                    order.append(name)
                # double, as pandas gives for a date part with missing values
                exprs[name] = fn(ts).cast("double")
        return df.select(*[exprs[c].alias(c) for c in order])

    def _filled(self, df: DataFrame) -> DataFrame:
        out = []
        for f in df.schema.fields:
            c = F.col(q(f.name))
            if f.name in self.fill_numeric:
                v = self.fill_numeric[f.name]
                c = F.coalesce(c.cast("double"), F.lit(v).cast("double"))
            elif f.name in self.fill_categorical:
                v = self.fill_categorical[f.name]
                if v == "missing" or isinstance(f.dataType, T.StringType):
                    c = F.coalesce(c.cast("string"), F.lit(v))
                else:
                    c = F.coalesce(c, F.lit(v).cast(f.dataType))
            out.append(c.alias(f.name))
        return df.select(*out)

    def _clipped(self, df: DataFrame) -> DataFrame:
        if not self.clip:
            return df
        out = []
        for f in df.schema.fields:
            c = F.col(q(f.name))
            if f.name in self.clip:
                lo, hi = self.clip[f.name]
                c = clip_expr(as_double(df, f.name), lo, hi)
            out.append(c.alias(f.name))
        return df.select(*out)

    def transform(self, df: DataFrame, dedupe: bool = True) -> DataFrame:
        """Apply the fitted plan; ``dedupe=False`` skips the distinct (streams)."""
        out = nan_to_null(df)
        out = out.dropDuplicates() if (dedupe and self.options.drop_duplicates) else out
        out = self._expanded(self._coerced(out))
        if self.drop:
            out = out.drop(*self.drop)
        return self._clipped(self._filled(out))

    # -- reporting ---------------------------------------------------------
    def summary_rows(self) -> list[tuple[str, str]]:
        r = self.report
        rows = []
        for label, key in SUMMARY_LABELS:
            if label == "Rows":
                v = f"{r['original_rows']} -> {r['final_rows']}"
            elif label == "Columns":
                v = f"{r['original_cols']} -> {r['final_cols']}"
            elif label == "Duplicates removed":
                v = str(r["duplicate_rows_removed"])
            else:
                v = ", ".join(r[key]) or "-"
            rows.append((label, v))
        return rows


def fit_preparation(df: DataFrame, options: PrepOptions | None = None, **kw) -> PrepPlan:
    o = options or PrepOptions(**kw)
    plan = PrepPlan(options=o)
    df = nan_to_null(df)
    report: dict[str, Any] = {k: [] for k in REPORT_LISTS}
    report["original_cols"] = len(df.columns)
    report["duplicate_rows_removed"] = 0

    cur = df
    if o.drop_duplicates:
        # written once: later statistics jobs read the written rows (columns pruned)
        cur, report["original_rows"], kept = distinct_rows(df, "prepared-rows")
        report["duplicate_rows_removed"] = report["original_rows"] - kept
        plan.deduped = cur
    else:
        report["original_rows"] = df.count()

    # 2 + 3 (+ the null counts every later step needs) in one pass: both parse
    # shares for each text column and the null count of every column.  After
    # coercion / expansion a column's nulls are rows minus parsed values, so no
    # second pass is needed.
    texts = text_cols(cur)
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.count_if(F.col(q(c)).isNull()).alias(f"z{i}") for i, c in enumerate(cur.columns)]
    for i, c in enumerate(texts):
        col = F.col(q(c))
        aggs += [F.count(col).alias(f"n{i}"), F.count(parse_num(col)).alias(f"p{i}"),
                 F.count(parse_ts(col)).alias(f"t{i}")]
    row = agg_chunks(cur, aggs)  # wide tables: chunks of aggregates, each scanning its columns
    n = row["__n"]
    nulls = {c: row[f"z{i}"] for i, c in enumerate(cur.columns)}
    parsed_num, parsed_ts = {}, {}
    for i, c in enumerate(texts):
        nn = row[f"n{i}"]
        parsed_num[c], parsed_ts[c] = row[f"p{i}"], row[f"t{i}"]
        num_ratio = row[f"p{i}"] / nn if nn else 0.0
        ts_ratio = row[f"t{i}"] / nn if nn else 0.0
        if o.coerce_numeric and num_ratio >= o.numeric_threshold:
            plan.coerce.append(c)
        elif o.expand_dates and ts_ratio >= o.datetime_threshold:
            plan.expand.append(c)
    report["columns_coerced_numeric"] = list(plan.coerce)
    report["date_columns_expanded"] = list(plan.expand)
    for c in plan.coerce:
        nulls[c] = n - parsed_num[c]
    for c in plan.expand:
        for part in ("year", "month", "day"):
            nulls[f"{c}_{part}"] = n - parsed_ts[c]
    cur = plan._expanded(plan._coerced(cur))

    # 4
    if o.max_missing_pct > 0 and n:
        plan.drop = [c for c in cur.columns if nulls[c] / n * 100.0 > o.max_missing_pct]
        report["columns_dropped_for_missing"] = list(plan.drop)
        cur = cur.drop(*plan.drop)

    # 5 to 7: medians and modes of what is missing, then the quartiles and the
    # "would change" counts of the filled rows.
    kinds = {f.name: f.dataType for f in cur.schema.fields}
    numeric = [c for c in cur.columns if is_numeric_type(kinds[c]) and not isinstance(kinds[c], T.BooleanType)]
    other = [c for c in cur.columns if c not in numeric]
    need_num = [c for c in numeric if nulls[c] > 0] if o.impute_numeric else []
    if o.impute_numeric:
        med = {r["column"]: r["value"] for r in exact_quantiles(cur, need_num, [0.5])}
        for c in need_num:
            plan.fill_numeric[c] = med.get(c)
        report["numeric_columns_imputed"] = list(need_num)
    if o.impute_categorical:
        need = [c for c in other if nulls[c] > 0]
        md = modes(cur, need) if need else {}
        for c in need:
            v = md.get(c)
            plan.fill_categorical[c] = "missing" if v is None else v
        report["categorical_columns_imputed"] = list(need)
    if o.clip_outliers and numeric:
        filled = plan._filled(cur)
        qs = quantiles(filled, numeric, [0.25, 0.75])
        bounds = {c: f for c, f in iqr_fences(qs).items() if qs[c][0.75] - qs[c][0.25] != 0}
        fs = fence_stats(filled, bounds)
        for c in numeric:
            if c in bounds and fs[c]["below"] + fs[c]["above"] > 0:
                plan.clip[c] = bounds[c]
        report["outlier_columns_clipped"] = list(plan.clip)
    cur = plan._clipped(plan._filled(cur))

    report["final_rows"] = report["original_rows"] - report["duplicate_rows_removed"]
    report["final_cols"] = len(cur.columns)
    plan.report = report
    return plan


def apply_preparation(df: DataFrame, **kw) -> tuple[DataFrame, dict[str, Any]]:
    """(prepared DataFrame, report) -- the reference's call shape."""
    plan = fit_preparation(df, **kw)
    if plan.deduped is not None:
        # the fit already wrote the distinct rows: no second distinct shuffle
        return plan.transform(plan.deduped, dedupe=False), plan.report
    return plan.transform(df), plan.report


# Advice lines of the preparation notes.
NOTE_MISSING = "Missing data exists. Highest missing column: {column} ({pct}%)."
NOTE_NUMERIC = "Some text columns look numeric and can be coerced safely."
NOTE_DATES = "Some text columns look date-like and can be expanded into year/month/day features."
NOTE_OUTLIERS = ("Several numeric columns have material outliers; "
                 "review boxplots or apply IQR clipping.")
NOTE_NONE = ("No obvious preparation issues detected. "
             "You can move straight to EDA or modeling.")


def preparation_notes(audit: dict[str, DataFrame]) -> DataFrame:
    """(position, note): advice from the three (small, one row per column)
    audit tables, as one lazy union; the fallback line when nothing applies."""
    missing = audit["missing"]
    coercion = audit["coercion_candidates"]
    outliers = audit["outliers"]
    spark = missing.sparkSession
    # the audit's missing table is already sorted (ties in schema order): its first row
    worst = (missing.limit(1)
             .select(F.lit(1).alias("position"),
                     F.format_string(NOTE_MISSING.replace("%", "%%").replace("{column}", "%s")
                                     .replace("{pct}", "%s"),
                                     F.col("column"), F.col("missing_pct").cast("string")).alias("note")))
    num = coercion.filter("numeric_parse_pct >= 80").limit(1).select(F.lit(2).alias("position"), F.lit(NOTE_NUMERIC).alias("note"))
    dat = coercion.filter("datetime_parse_pct >= 80").limit(1).select(F.lit(3).alias("position"), F.lit(NOTE_DATES).alias("note"))
    out = outliers.filter("outlier_pct >= 5").limit(1).select(F.lit(4).alias("position"), F.lit(NOTE_OUTLIERS).alias("note"))
    notes = (worst.unionByName(num).unionByName(dat).unionByName(out)
             .unionByName(spark.range(1).select(F.lit(5).alias("position"), F.lit(NOTE_NONE).alias("note"))))
    # at most five rows: global windows over this tiny table are fine
    allw = Window.partitionBy()
    kept = notes.withColumn("_n", F.count(F.lit(1)).over(allw)).filter((F.col("position") < 5) | (F.col("_n") == 1))
    return kept.select(F.row_number().over(Window.orderBy("position")).cast("long").alias("position"), "note")
