"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import clip, date_parts, parse_num, parse_ts, residual, to_text
from tablewright.functions.parse import coerce_datetime_candidates
from tablewright.queries import register
from tablewright.queries.sqlhelp import parse_date_sql, parse_num_sql, with_dirty
from tablewright.sources.tables import dirty_orders, table

R = 9


@register("parse_num", with_dirty() + f"SELECT o_orderkey, num_text, {parse_num_sql('num_text')} AS num_value FROM dirty_orders")
def q_parse_num(spark, sf):
    d = dirty_orders(spark, sf)
    return d.select("o_orderkey", "num_text", parse_num(F.col("num_text")).alias("num_value"))


@register("parse_ts", with_dirty() + f"SELECT o_orderkey, date_text, {parse_date_sql('date_text')} AS ts FROM dirty_orders")
def q_parse_ts(spark, sf):
    d = dirty_orders(spark, sf)
    return d.select("o_orderkey", "date_text", parse_ts(F.col("date_text")).alias("ts"))


@register("parse_ts_first", with_dirty() +
          "SELECT * REPLACE (try_strptime(trim(date_text), '%Y-%m-%d') AS date_text) FROM dirty_orders")
def q_parse_ts_first(spark, sf):
    return coerce_datetime_candidates(dirty_orders(spark, sf), ["o_orderkey"])


@register("date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, "
                        "CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, "
                        "CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day FROM orders")
def q_date_parts(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", *date_parts(F.col("o_orderdate"), "o_orderdate"))


@register("fill_value", with_dirty() + "SELECT * REPLACE (COALESCE(amount, 0.0) AS amount, "
                                       "COALESCE(category, 'missing') AS category) FROM dirty_orders")
def q_fill_value(spark, sf):
    return dirty_orders(spark, sf).fillna({"amount": 0.0, "category": "missing"})


@register("clip", "SELECT l_orderkey, l_linenumber, LEAST(GREATEST(l_quantity, 5.0), 45.0) AS l_quantity FROM lineitem")
def q_clip(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", clip(F.col("l_quantity"), 5.0, 45.0).alias("l_quantity"))


@register("to_text", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation_text, "
                     "COALESCE(CAST(c_mktsegment AS VARCHAR), 'nan') AS segment_text FROM customer")
def q_to_text(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", to_text(F.col("c_nationkey")).alias("nation_text"),
                    to_text(F.col("c_mktsegment")).alias("segment_text"))


@register("abs_round", "SELECT c_custkey, abs(c_acctbal) AS abs_acctbal, round(c_acctbal / 3, 2) AS third_rounded FROM customer")
def q_abs_round(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.abs("c_acctbal").alias("abs_acctbal"),
                    F.round(F.col("c_acctbal") / 3, 2).alias("third_rounded"))


@register("log1p_expm1", f"SELECT event_id, round(ln(1 + value), {R}) AS log_value, "
                         f"round(exp(ln(1 + value)) - 1, {R}) AS back FROM events")
def q_log1p_expm1(spark, sf):
    e = table(spark, sf, "events")
    lv = F.log1p("value")
    return e.select("event_id", F.round(lv, R).alias("log_value"), F.round(F.expm1(lv), R).alias("back"))


_PRED_SQL = "l_quantity * 1500.0 + 900.0"


@register("residual", f"SELECT l_orderkey, l_linenumber, l_extendedprice - ({_PRED_SQL}) AS residual FROM lineitem")
def q_residual(spark, sf):
    li = table(spark, sf, "lineitem")
    pred = F.col("l_quantity") * 1500.0 + 900.0
    return li.select("l_orderkey", "l_linenumber", residual(F.col("l_extendedprice"), pred).alias("residual"))


@register("qcut4", "WITH e AS (SELECT quantile_cont(l_extendedprice, 0.0) AS e0, quantile_cont(l_extendedprice, 0.25) AS e1, "
                   "quantile_cont(l_extendedprice, 0.5) AS e2, quantile_cont(l_extendedprice, 0.75) AS e3, "
                   "quantile_cont(l_extendedprice, 1.0) AS e4 FROM lineitem) "
                   "SELECT band, count(*) AS rows FROM (SELECT CASE WHEN l_extendedprice <= e1 THEN 0 "
                   "WHEN l_extendedprice <= e2 THEN 1 WHEN l_extendedprice <= e3 THEN 2 ELSE 3 END AS band "
                   "FROM lineitem, e WHERE l_extendedprice IS NOT NULL) GROUP BY band")
def q_qcut4(spark, sf):
    from tablewright.operators.evaluation import qcut_bands
    li = table(spark, sf, "lineitem")
    banded, _ = qcut_bands(li, "l_extendedprice", 4)
    return banded.filter("band IS NOT NULL").groupBy("band").agg(F.count(F.lit(1)).alias("rows"))



@register("abs", "SELECT c_custkey, abs(c_acctbal) AS abs_acctbal FROM customer")
def q_abs(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.abs("c_acctbal").alias("abs_acctbal"))


@register("round", "SELECT c_custkey, round(c_acctbal / 3, 2) AS third_rounded FROM customer")
def q_round(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.round(F.col("c_acctbal") / 3, 2).alias("third_rounded"))


@register("log1p", f"SELECT event_id, round(ln(1 + value), {R}) AS log_value FROM events")
def q_log1p(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(F.log1p("value"), R).alias("log_value"))


@register("expm1", f"SELECT event_id, round(exp(value / 100.0) - 1, {R}) AS exp_value FROM events")
def q_expm1(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(F.expm1(F.col("value") / 100.0), R).alias("exp_value"))
