"""EDA tables, top-k / sample operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.parse import coerce_datetime_candidates
from tablewright.operators import eda as E
from tablewright.operators.corr import corr_matrix
from tablewright.operators.planning import detect_task
from tablewright.operators.profile import column_profile, full_profile
from tablewright.queries import register
from tablewright.queries.sqlhelp import DIRTY_COLS, DIRTY_NUMERIC, union_all, with_dirty
from tablewright.sources.tables import dirty_orders, table

R = 9
LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_DTYPES = {"o_orderkey": "bigint", "num_text": "string", "date_text": "string", "category": "string",
           "amount": "double", "sparse": "string", "flag": "boolean"}


@register("eda_quality", with_dirty() + union_all([
    f"SELECT '{c}' AS \"column\", '{_DTYPES[c]}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
    f"count(DISTINCT {c}) AS \"unique\" FROM dirty_orders" for c in DIRTY_COLS]))
def eda_quality(spark, sf):
    return E.quality(dirty_orders(spark, sf))


_MISS = with_dirty() + "SELECT * FROM (" + union_all([
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing_count FROM dirty_orders"
    for c in DIRTY_COLS]) + ") WHERE missing_count > 0 ORDER BY missing_count DESC, \"column\""


@register("eda_missingness", _MISS + " LIMIT 12")
def eda_missingness(spark, sf):
    return E.missingness(dirty_orders(spark, sf), 12)


@register("topk_missing", _MISS + " LIMIT 3")
def topk_missing(spark, sf):
    return E.missingness(dirty_orders(spark, sf), 3)


def _hist_sql(tbl, cols, bins, alias="column"):
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS \"{alias}\", CAST(b AS INTEGER) AS bin, lo2 + b * ((hi2 - lo2) / {bins}) AS lo, "
            f"lo2 + (b + 1) * ((hi2 - lo2) / {bins}) AS hi, "
            f"(SELECT count(*) FROM {tbl} WHERE {c} IS NOT NULL AND "
            f"least(greatest(CAST(floor(({c} - lo2) / (hi2 - lo2) * {bins}) AS INTEGER), 0), {bins - 1}) = b) AS count "
            f"FROM (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END AS lo2, "
            f"CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END AS hi2 FROM {tbl}), "
            f"range(0, {bins}) t(b)")
    return union_all(parts)


@register("eda_histograms", _hist_sql("lineitem", LINE_NUM, 30))
def eda_histograms(spark, sf):
    return E.histograms(table(spark, sf, "lineitem"), LINE_NUM, 30)


@register("hist_bin", _hist_sql("events", ["value"], 10))
def hist_bin(spark, sf):
    return E.histograms(table(spark, sf, "events"), ["value"], 10)


def _box_sql(tbl, cols):
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS n, q1, med AS median, q3, "
            f"min({c}) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1)) AS whisker_lo, "
            f"max({c}) FILTER (WHERE {c} <= q3 + 1.5 * (q3 - q1)) AS whisker_hi, "
            f"count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1)) AS fliers_lo, "
            f"count(*) FILTER (WHERE {c} > q3 + 1.5 * (q3 - q1)) AS fliers_hi "
            f"FROM {tbl}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, "
            f"quantile_cont({c}, 0.75) AS q3 FROM {tbl}) GROUP BY q1, med, q3")
    return union_all(parts)


@register("eda_boxplot", _box_sql("lineitem", LINE_NUM))
def eda_boxplot(spark, sf):
    return E.boxplot(table(spark, sf, "lineitem"), LINE_NUM)


def _top_sql(src_cte, cols, k):
    inner = union_all([
        f"SELECT '{c}' AS \"column\", COALESCE(CAST({c} AS VARCHAR), 'nan') AS value, count(*) AS count FROM {src_cte} GROUP BY 2"
        for c in cols])
    return (f"SELECT \"column\", rank, value, count FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" "
            f"ORDER BY count DESC, value) AS rank FROM ({inner})) WHERE rank <= {k}")


@register("eda_categories", with_dirty() + _top_sql("dirty_orders", ["num_text", "date_text", "category"], 15))
def eda_categories(spark, sf):
    return E.categories(dirty_orders(spark, sf), max_cols=3, max_levels=15)


@register("topk_values", _top_sql("orders", ["o_orderpriority", "o_orderstatus"], 3))
def topk_values(spark, sf):
    return E.top_values(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], 3)


@register("eda_custom_counts", _top_sql("customer", ["c_nationkey"], 20))
def eda_custom_counts(spark, sf):
    return E.top_values(table(spark, sf, "customer"), ["c_nationkey"], 20)


def _spearman_pair_sql(a, b):
    def v(c):
        return f"CAST({c} AS INTEGER)" if c == "flag" else c
    sub = (f"(SELECT rank() OVER (ORDER BY {v(a)}) + (count(*) OVER (PARTITION BY {v(a)}) - 1) / 2.0 AS ra, "
           f"rank() OVER (ORDER BY {v(b)}) + (count(*) OVER (PARTITION BY {v(b)}) - 1) / 2.0 AS rb "
           f"FROM dirty_orders WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")
    r = f"round(covar_pop(ra, rb) / NULLIF(stddev_pop(ra) * stddev_pop(rb), 0), {R})"
    return [f"SELECT '{a}' AS a, '{b}' AS b, {r} AS r FROM {sub}", f"SELECT '{b}' AS a, '{a}' AS b, {r} AS r FROM {sub}"]


_EC = ["o_orderkey", "amount", "flag"]


@register("eda_corr", "SELECT * REPLACE (CASE WHEN r = 0 THEN 0.0 ELSE r END AS r) FROM (" + with_dirty() + union_all(
    [f"SELECT '{c}' AS a, '{c}' AS b, 1.0 AS r" for c in _EC] +
    _spearman_pair_sql("o_orderkey", "amount") + _spearman_pair_sql("o_orderkey", "flag") +
    _spearman_pair_sql("amount", "flag")) + ")")
def eda_corr(spark, sf):
    m = corr_matrix(dirty_orders(spark, sf), _EC, "spearman")
    r = F.round("r", R)
    return m.withColumn("r", F.when(r == 0, F.lit(0.0)).otherwise(r))


@register("eda_pairwise", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders "
                          "WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL AND o_totalprice IS NOT NULL "
                          "ORDER BY o_orderkey LIMIT 1000")
def eda_pairwise(spark, sf):
    o = table(spark, sf, "orders")
    cols = E.numeric_for_eda(o, 6)
    return E.head_sample(o, cols, 1000, ["o_orderkey"])


@register("head_sample", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem "
                         "WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL "
                         "ORDER BY l_orderkey, l_linenumber LIMIT 2000")
def head_sample(spark, sf):
    return E.head_sample(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], 2000,
                         ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@register("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 200")
def preview(spark, sf):
    return table(spark, sf, "orders").orderBy("o_orderkey").limit(200)


@register("eda_target", "SELECT 'classification' AS task, c_mktsegment AS value, count(*) AS count FROM customer GROUP BY 2")
def eda_target(spark, sf):
    c = table(spark, sf, "customer")
    task = detect_task(c, "c_mktsegment")
    return E.value_counts(c, ["c_mktsegment"]).select(F.lit(task).alias("task"), "value", "count")


@register("eda_target_regression", _hist_sql("events", ["value"], 25))
def eda_target_regression(spark, sf):
    e = table(spark, sf, "events")
    assert detect_task(e, "value") == "regression"
    return E.histograms(e, ["value"], 25)


def _scatter_sql(tbl, target, feats, bins):
    def b(c, mn, mx):
        lo = f"(CASE WHEN {mn} = {mx} THEN {mn} - 0.5 ELSE {mn} END)"
        hi = f"(CASE WHEN {mn} = {mx} THEN {mx} + 0.5 ELSE {mx} END)"
        return f"least(greatest(CAST(floor(({c} - {lo}) / ({hi} - {lo}) * {bins}) AS INTEGER), 0), {bins - 1})"
    parts = []
    for f in feats:
        parts.append(
            f"SELECT '{f}' AS feature, {b(f, 'xmn', 'xmx')} AS xbin, {b(target, 'ymn', 'ymx')} AS ybin, count(*) AS count "
            f"FROM {tbl}, (SELECT min({f}) AS xmn, max({f}) AS xmx, min({target}) AS ymn, max({target}) AS ymx "
            f"FROM {tbl} WHERE {f} IS NOT NULL AND {target} IS NOT NULL) "
            f"WHERE {f} IS NOT NULL AND {target} IS NOT NULL GROUP BY 1, 2, 3")
    return union_all(parts)


@register("eda_target_scatter", _scatter_sql("lineitem", "l_extendedprice", ["l_quantity", "l_discount"], 50))
def eda_target_scatter(spark, sf):
    return E.target_scatter_bins(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], 50)


@register("eda_custom_xy", "SELECT o_orderpriority AS x, round(avg(o_totalprice), 3) AS mean_y FROM "
                           "(SELECT o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority IS NOT NULL "
                           "AND o_totalprice IS NOT NULL ORDER BY o_orderkey LIMIT 2000) GROUP BY 1 ORDER BY 1 LIMIT 30")
def eda_custom_xy(spark, sf):
    o = table(spark, sf, "orders")
    sample = E.head_sample(o, ["o_orderpriority", "o_totalprice"], 2000, ["o_orderkey"])
    return (E.group_mean(sample, "o_orderpriority", "o_totalprice").orderBy(F.asc_nulls_last("x")).limit(30)
            .withColumn("mean_y", F.round("mean_y", 3)))


@register("limit_groups", "SELECT l_suppkey AS x, round(avg(l_quantity), 6) AS mean_y FROM lineitem "
                          "GROUP BY 1 ORDER BY 1 LIMIT 30")
def limit_groups(spark, sf):
    li = table(spark, sf, "lineitem")
    return (E.group_mean(li, "l_suppkey", "l_quantity").orderBy(F.asc_nulls_last("x")).limit(30)
            .withColumn("mean_y", F.round("mean_y", 6)))


_ORDERS_PROFILE = [("o_orderkey", "bigint", True), ("o_custkey", "bigint", True), ("o_orderstatus", "string", False),
                   ("o_totalprice", "double", True), ("o_orderdate", "timestamp_ntz", False),
                   ("o_orderpriority", "string", False)]


def _z0(e):
    """-0.0 shown as 0.0 (a near-zero moment may round to either sign)."""
    return f"(CASE WHEN {e} = 0 THEN 0.0 ELSE {e} END)"


def _profile_sql():
    from tablewright.operators.profile import (ALERT_HIGH_CARD_PCT, ALERT_MISSING_PCT, ALERT_SKEW_ABS,
                                               ALERT_ZEROS_PCT)
    parts = []
    for c, t, num in _ORDERS_PROFILE:
        txt = t == "string"
        tops = (f"(SELECT string_agg(v || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY n DESC, v) FROM "
                f"(SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1 "
                f"ORDER BY n DESC, v LIMIT 5))")
        sk = (f"CASE WHEN count({c}) < 3 THEN NULL WHEN var_pop({c}) = 0 THEN 0.0 ELSE skewness({c}) END"
              if num else "NULL")
        alerts = [f"CASE WHEN count(*) > 0 AND (count(*) - count({c})) * 100.0 / count(*) > {ALERT_MISSING_PCT} THEN 'missing' END",
                  f"CASE WHEN count(DISTINCT {c}) = 1 THEN 'constant' END"]
        if num:
            alerts += [f"CASE WHEN count({c}) > 0 AND count(*) FILTER (WHERE {c} = 0) * 100.0 / count({c}) > {ALERT_ZEROS_PCT} THEN 'zeros' END",
                       f"CASE WHEN abs({sk}) >= {ALERT_SKEW_ABS} THEN 'skewed' END"]
        else:
            alerts += [f"CASE WHEN count({c}) > 0 AND count(DISTINCT {c}) * 100.0 / count({c}) > {ALERT_HIGH_CARD_PCT} "
                       f"AND count(DISTINCT {c}) > 1 THEN 'high_cardinality' END"]
        parts.append(
            f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS count, count(*) - count({c}) AS nulls, "
            f"count(DISTINCT CAST({c} AS VARCHAR)) AS \"distinct\", "
            + (f"CAST(count(*) FILTER (WHERE {c} = 0) AS DOUBLE) AS zeros, "
               f"CAST(count(*) FILTER (WHERE {c} < 0) AS DOUBLE) AS negatives, "
               f"round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS sd, CAST(min({c}) AS DOUBLE) AS min, "
               f"quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3, "
               f"CAST(max({c}) AS DOUBLE) AS max, {_z0(f'round({sk}, 6)')} AS skew, "
               f"{_z0(f'round(kurtosis_pop({c}), 6)')} AS kurtosis, "
               if num else
               "CAST(NULL AS DOUBLE) AS zeros, CAST(NULL AS DOUBLE) AS negatives, CAST(NULL AS DOUBLE) AS mean, "
               "CAST(NULL AS DOUBLE) AS sd, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS q1, "
               "CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS q3, CAST(NULL AS DOUBLE) AS max, "
               "CAST(NULL AS DOUBLE) AS skew, CAST(NULL AS DOUBLE) AS kurtosis, ")
            + (f"CAST(min(length({c})) AS DOUBLE) AS len_min, CAST(max(length({c})) AS DOUBLE) AS len_max, "
               f"round(avg(length({c})), 6) AS len_mean, " if txt else
               "CAST(NULL AS DOUBLE) AS len_min, CAST(NULL AS DOUBLE) AS len_max, CAST(NULL AS DOUBLE) AS len_mean, ")
            + f"{tops} AS top_values, COALESCE(concat_ws(', ', {', '.join(alerts)}), '') AS alerts FROM orders")
    return union_all(parts)


@register("eda_profile", _profile_sql())
def eda_profile(spark, sf):
    p = column_profile(coerce_datetime_candidates(table(spark, sf, "orders"), ["o_orderkey"]))
    # compared across engines: floats rounded; counts that may be missing as double
    def z0(e):
        return F.when(e == 0, F.lit(0.0)).otherwise(e)
    return p.select(*[F.round(c, 3).alias(c) if c in ("mean", "sd")
                      else z0(F.round(c, 6)).alias(c) if c in ("skew", "kurtosis", "len_mean")
                      else F.col(c).cast("double").alias(c) if c in ("zeros", "negatives", "len_min", "len_max")
                      else F.col(c) for c in p.columns])


def _profile_parts_sql():
    """Dates of ``dirty_orders`` as timestamps, duplicates and correlations of the same profile."""
    dated = "dated AS (SELECT * REPLACE (try_strptime(trim(date_text), '%Y-%m-%d') AS date_text) FROM dirty_orders)"
    x = {c: f"CAST({c} AS DOUBLE)" if c != "flag" else "CAST(CAST(flag AS INTEGER) AS DOUBLE)" for c in DIRTY_NUMERIC}
    parts = ["SELECT 'duplicates' AS part, '' AS a, '' AS b, CAST((SELECT count(*) FROM dated) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dated)) AS DOUBLE) AS value",
             "SELECT 'timestamp', 'date_text', '', CAST(count(date_text) AS DOUBLE) FROM dated"]
    for a in DIRTY_NUMERIC:
        for b in DIRTY_NUMERIC:
            r = (f"CASE WHEN stddev_pop({x[a]}) > 0 THEN 1.0 END" if a == b else
                 f"round(covar_pop({x[a]}, {x[b]}) / NULLIF(stddev_pop({x[a]}) * stddev_pop({x[b]}), 0), {R})")
            parts.append(f"SELECT 'correlation', '{a}', '{b}', {_z0(r)} FROM dated WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
    return with_dirty(dated) + union_all(parts)


@register("eda_profile_parts", _profile_parts_sql())
def eda_profile_parts(spark, sf):
    p = full_profile(dirty_orders(spark, sf), ["o_orderkey"])
    r = F.round("r", R)
    return (p["duplicates"].select(F.lit("duplicates").alias("part"), F.lit("").alias("a"), F.lit("").alias("b"), F.col("duplicates").cast("double").alias("value"))
            .unionByName(p["columns"].where("dtype = 'timestamp'").select(F.lit("timestamp").alias("part"), F.col("column").alias("a"), F.lit("").alias("b"), F.col("count").cast("double").alias("value")))
            .unionByName(p["correlations"].select(F.lit("correlation").alias("part"), "a", "b", F.when(r == 0, F.lit(0.0)).otherwise(r).alias("value"))))


_NAN_PRICE = "CASE WHEN o_orderkey % 20 <> 0 AND o_orderkey % 33 <> 0 THEN o_totalprice END"


@register("eda_profile_nan", f"""
WITH p AS (SELECT {_NAN_PRICE} AS price, o_orderstatus AS status, CASE WHEN o_orderkey % 33 <> 0 THEN o_orderpriority END AS priority FROM orders)
SELECT 'price' AS "column", count(price) AS count, count(*) - count(price) AS nulls, count(DISTINCT price) AS "distinct", round(avg(price), 3) AS mean, median(price) AS median, max(price) AS max, '' AS top FROM p
UNION ALL SELECT 'status', count(status), count(*) - count(status), count(DISTINCT status), NULL, NULL, NULL,
  (SELECT string_agg(status || ' (' || n || ')', ', ' ORDER BY n DESC, status) FROM (SELECT status, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, 1 LIMIT 2)) FROM p
UNION ALL SELECT 'priority', count(priority), count(*) - count(priority), count(DISTINCT priority), NULL, NULL, NULL,
  (SELECT string_agg(priority || ' (' || n || ')', ', ' ORDER BY n DESC, priority) FROM (SELECT priority, count(*) AS n FROM p WHERE priority IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 2)) FROM p""")
def eda_profile_nan(spark, sf):
    """NaN and null are both missing; frequent values come from the summary."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(F.when(k % 20 == 0, float("nan")).when(k % 33 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("price"),
                                          F.col("o_orderstatus").alias("status"), F.when(k % 33 != 0, F.col("o_orderpriority")).alias("priority"))
    p = column_profile(o, top_k=2)
    return p.select("column", "count", "nulls", "distinct", F.round("mean", 3).alias("mean"), "median", "max", F.when(F.col("column") == "price", "").otherwise(F.col("top_values")).alias("top"))
