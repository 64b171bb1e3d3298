"""Audit, ratios, quantiles, predicates and sorts over ``dirty_orders`` and
``lineitem``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.functions.parse import parse_num, parse_ts
from tablewright.operators import audit as A
from tablewright.operators.stats import quantile_table
from tablewright.queries import register
from tablewright.queries.sqlhelp import (
    DIRTY_COLS, DIRTY_NUMERIC, DIRTY_TEXT, parse_date_sql, parse_num_sql, union_all, with_dirty,
)
from tablewright.sources.tables import dirty_orders, table

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


def _num_sql(c):
    return f"CAST({c} AS INTEGER)" if c == "flag" else c


_MISSING_SQL = with_dirty() + union_all([
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) AS missing_pct FROM dirty_orders"
    for c in DIRTY_COLS])


@register("audit_missing", f"SELECT * FROM ({_MISSING_SQL}) WHERE missing_count > 0")
def audit_missing(spark, sf):
    return A.audit_missing(dirty_orders(spark, sf))


@register("filter_positive", f"SELECT \"column\", missing_count FROM ({_MISSING_SQL}) WHERE missing_count > 0")
def filter_positive(spark, sf):
    return A.missing_table(dirty_orders(spark, sf)).filter("missing_count > 0").select("column", "missing_count")


_POS_ALL = "(VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(DIRTY_COLS)) + ") pos(c, i)"
_POS_TEXT = "(VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(DIRTY_TEXT)) + ") pos(c, i)"


@register("worst_column", f"SELECT m.* FROM ({_MISSING_SQL}) m JOIN {_POS_ALL} ON m.\"column\" = pos.c "
                          "WHERE missing_count > 0 ORDER BY missing_pct DESC, missing_count DESC, pos.i LIMIT 1")
def worst_column(spark, sf):
    return A.audit_missing(dirty_orders(spark, sf)).limit(1)


def _ratio_sql(kind):
    fn = parse_num_sql if kind == "num" else parse_date_sql
    return with_dirty() + union_all([
        f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count({fn(c)}) AS parsed, "
        f"COALESCE(count({fn(c)}) * 1.0 / NULLIF(count({c}), 0), 0.0) AS ratio FROM dirty_orders"
        for c in DIRTY_TEXT])


def _ratio_spark(spark, sf, parser):
    d = dirty_orders(spark, sf)
    parts = []
    for c in DIRTY_TEXT:
        col = F.col(c)
        parts.append(d.agg(F.lit(c).alias("column"), F.count(col).alias("non_null"),
                           F.count(parser(col)).alias("parsed")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ratio", F.coalesce(F.try_divide(F.col("parsed").cast("double"),
                                                           F.col("non_null")), F.lit(0.0)))


@register("numeric_parse_ratio", _ratio_sql("num"))
def numeric_parse_ratio(spark, sf):
    return _ratio_spark(spark, sf, parse_num)


@register("datetime_parse_ratio", _ratio_sql("ts"))
def datetime_parse_ratio(spark, sf):
    return _ratio_spark(spark, sf, parse_ts)


_COERCE_SQL = with_dirty() + union_all([
    f"SELECT '{c}' AS \"column\", "
    f"round(COALESCE(count({parse_num_sql(c)}) * 100.0 / NULLIF(count({c}), 0), 0.0), 2) AS numeric_parse_pct, "
    f"round(COALESCE(count({parse_date_sql(c)}) * 100.0 / NULLIF(count({c}), 0), 0.0), 2) AS datetime_parse_pct, "
    f"'string' AS sample_dtype FROM dirty_orders"
    for c in DIRTY_TEXT])


@register("audit_coercion", _COERCE_SQL)
def audit_coercion(spark, sf):
    return A.audit_coercion(dirty_orders(spark, sf))


@register("sort_audit", "SELECT t.*, row_number() OVER (ORDER BY numeric_parse_pct DESC, "
                        f"datetime_parse_pct DESC, pos.i) AS position FROM ({_COERCE_SQL}) t "
                        f"JOIN {_POS_TEXT} ON t.\"column\" = pos.c")
def sort_audit(spark, sf):
    t = A.audit_coercion(dirty_orders(spark, sf))
    # one row per text column: a global window over a k-row table
    w = Window.orderBy(F.desc("numeric_parse_pct"), F.desc("datetime_parse_pct"), A.column_position(DIRTY_TEXT))
    return t.withColumn("position", F.row_number().over(w).cast("long"))


_Q_CTE = "q AS (SELECT " + ", ".join(
    f"quantile_cont({_num_sql(c)}, 0.25) AS q1_{c}, quantile_cont({_num_sql(c)}, 0.75) AS q3_{c}"
    for c in DIRTY_NUMERIC) + " FROM dirty_orders)"


def _outlier_branch(c):
    v = _num_sql(c)
    lo = f"(q1_{c} - 1.5 * (q3_{c} - q1_{c}))"
    hi = f"(q3_{c} + 1.5 * (q3_{c} - q1_{c}))"
    cnt = f"CASE WHEN max(q3_{c}) = max(q1_{c}) THEN 0 ELSE count(*) FILTER (WHERE {v} < {lo} OR {v} > {hi}) END"
    return (f"SELECT '{c}' AS \"column\", {cnt} AS outliers, "
            f"round(({cnt}) * 100.0 / count({v}), 2) AS outlier_pct FROM dirty_orders, q")


@register("audit_outliers", with_dirty(_Q_CTE) + union_all([_outlier_branch(c) for c in DIRTY_NUMERIC]))
def audit_outliers(spark, sf):
    return A.audit_outliers(dirty_orders(spark, sf))


@register("pred_outside", with_dirty(_Q_CTE) +
          "SELECT o_orderkey, amount FROM dirty_orders, q "
          "WHERE amount < q1_amount - 1.5 * (q3_amount - q1_amount) OR amount > q3_amount + 1.5 * (q3_amount - q1_amount)")
def pred_outside(spark, sf):
    d = dirty_orders(spark, sf)
    q1, q3, lo, hi = A.iqr_bounds(d, ["amount"])["amount"]
    return d.filter((F.col("amount") < lo) | (F.col("amount") > hi)).select("o_orderkey", "amount")


@register("quantile", union_all([
    f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS p, count({c}) AS n, round(quantile_cont({c}, {p}), 6) AS value FROM lineitem"
    for c in LINE_NUM for p in PROBS]))
def quantile(spark, sf):
    t = quantile_table(table(spark, sf, "lineitem"), LINE_NUM, PROBS)
    return t.withColumn("value", F.round("value", 6))


@register("median", with_dirty() + union_all([
    f"SELECT '{c}' AS \"column\", median({_num_sql(c)}) AS median FROM dirty_orders" for c in DIRTY_NUMERIC]))
def median(spark, sf):
    d = dirty_orders(spark, sf)
    return (quantile_table(d, DIRTY_NUMERIC, [0.5])
            .select("column", F.col("value").alias("median")))


@register("filter_threshold", "SELECT \"column\", kind FROM (" + union_all([
    f"SELECT \"column\", 'numeric' AS kind FROM ({_COERCE_SQL}) WHERE numeric_parse_pct >= 80",
    f"SELECT \"column\", 'datetime' AS kind FROM ({_COERCE_SQL}) WHERE datetime_parse_pct >= 80"]) + ")")
def filter_threshold(spark, sf):
    t = A.audit_coercion(dirty_orders(spark, sf))
    return (t.filter("numeric_parse_pct >= 80").select("column", F.lit("numeric").alias("kind"))
            .unionByName(t.filter("datetime_parse_pct >= 80").select("column", F.lit("datetime").alias("kind"))))
