"""Aggregations, correlations, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import corr as C
from tablewright.operators import stats as S
from tablewright.operators.profile import dataset_kpis, missing_cells
from tablewright.queries import register
from tablewright.queries.sqlhelp import DIRTY_COLS, DIRTY_TEXT, union_all, with_dirty
from tablewright.sources.tables import dirty_orders, table

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
R = 9  # decimals kept for floating results compared across engines


@register("row_col_count", "SELECT count(*) AS rows, 11 AS cols FROM lineitem")
def row_col_count(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.agg(F.count(F.lit(1)).alias("rows")).withColumn("cols", F.lit(len(li.columns)))


_CELLS = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in DIRTY_COLS)


@register("missing_cells", with_dirty() + f"SELECT {_CELLS} AS missing_cells FROM dirty_orders")
def q_missing_cells(spark, sf):
    return missing_cells(dirty_orders(spark, sf))


@register("duplicate_count", with_dirty() +
          "SELECT (SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS duplicates")
def duplicate_count(spark, sf):
    d = dirty_orders(spark, sf)
    return spark.createDataFrame([(S.duplicate_count(d),)], "duplicates long")


@register("dataset_kpis", with_dirty() + (
    "SELECT rows, 7 AS cols, missing, round(missing * 100.0 / greatest(1, rows * 7), 2) AS missing_pct, dups AS duplicates, "
    "'string' AS target_type, format('{:,}', rows) AS rows_text, format('{:,}', 7) AS cols_text, "
    "format('{:.2f}%', missing * 100.0 / greatest(1, rows * 7)) AS missing_pct_text, format('{:,}', dups) AS duplicates_text "
    f"FROM (SELECT count(*) AS rows, {_CELLS} AS missing, "
    "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS dups FROM dirty_orders)"))
def q_dataset_kpis(spark, sf):
    return dataset_kpis(dirty_orders(spark, sf), "category")


@register("mode_min", with_dirty() + union_all([
    f"SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS mode FROM dirty_orders WHERE {c} IS NOT NULL "
    f"GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in DIRTY_TEXT]))
def mode_min(spark, sf):
    m = S.modes(dirty_orders(spark, sf), DIRTY_TEXT)
    return spark.createDataFrame([(c, m[c]) for c in DIRTY_TEXT], "column string, mode string")


@register("nunique", with_dirty() + union_all([
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"unique\" FROM dirty_orders" for c in DIRTY_COLS]))
def nunique(spark, sf):
    return S.nunique(dirty_orders(spark, sf), DIRTY_COLS)


_SKEW_COLS = [("events", "value"), ("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"), ("orders", "o_totalprice")]


@register("skew", union_all([
    f"SELECT '{t}.{c}' AS \"column\", round(CASE WHEN count({c}) < 3 THEN NULL WHEN var_pop({c}) = 0 THEN 0.0 "
    f"ELSE skewness({c}) END, {R}) AS skew FROM {t}" for t, c in _SKEW_COLS]).replace(
    "AS skew FROM", "AS skew0 FROM").join(["SELECT \"column\", CASE WHEN skew0 = 0 THEN 0.0 ELSE skew0 END AS skew FROM (", ")"]))
def skew(spark, sf):
    parts = []
    for t, c in _SKEW_COLS:
        df = table(spark, sf, t)
        sk = F.round(S.skew_expr(F.col(c)), R)
        parts.append(df.agg(F.lit(f"{t}.{c}").alias("column"), F.when(sk == 0, F.lit(0.0)).otherwise(sk).alias("skew")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pearson_sql(tbl, cols):
    br = []
    for a in cols:
        for b in cols:
            if a == b:
                br.append(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END AS r FROM {tbl}")
            else:
                br.append(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}) / NULLIF(stddev_pop({a}) * stddev_pop({b}), 0), {R}) AS r "
                          f"FROM {tbl} WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
    return union_all(br)


def _rounded(m, col="r"):
    """Round for the cross-engine compare; -0.0 shown as 0.0."""
    r = F.round(col, R)
    return m.withColumn(col, F.when(r == 0, F.lit(0.0)).otherwise(r))


def _z(sql, col="r"):
    """Same normalisation on the SQL side."""
    return f"SELECT * REPLACE (CASE WHEN {col} = 0 THEN 0.0 ELSE {col} END AS {col}) FROM ({sql})"


@register("corr_pearson", _z(_pearson_sql("lineitem", LINE_NUM)))
def corr_pearson(spark, sf):
    return _rounded(C.pearson_matrix(table(spark, sf, "lineitem"), LINE_NUM))


_SP_COLS = ["l_quantity", "l_discount", "l_tax"]
_SP_RANKED = ("rk AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _SP_COLS) +
    " FROM lineitem)")


@register("corr_spearman", _z(f"WITH {_SP_RANKED} " + _pearson_sql("rk", _SP_COLS)))
def corr_spearman(spark, sf):
    return _rounded(C.spearman_matrix(table(spark, sf, "lineitem"), _SP_COLS))


_KT = ("WITH pr AS (SELECT sum(sign(a.p_size - b.p_size) * sign(a.p_retailprice - b.p_retailprice)) AS s, "
       "count(*) FILTER (WHERE a.p_size = b.p_size) AS tx, count(*) FILTER (WHERE a.p_retailprice = b.p_retailprice) AS ty, "
       "count(*) AS n0 FROM part a JOIN part b ON a.p_partkey < b.p_partkey) ")


@register("corr_kendall", _z(_KT + union_all([
    "SELECT 'p_size' AS a, 'p_size' AS b, 1.0 AS r",
    "SELECT 'p_retailprice' AS a, 'p_retailprice' AS b, 1.0 AS r",
    f"SELECT 'p_size' AS a, 'p_retailprice' AS b, round(s / sqrt((n0 - tx) * (n0 - ty)), {R}) AS r FROM pr",
    f"SELECT 'p_retailprice' AS a, 'p_size' AS b, round(s / sqrt((n0 - tx) * (n0 - ty)), {R}) AS r FROM pr"])))
def corr_kendall(spark, sf):
    return _rounded(C.kendall_matrix(table(spark, sf, "part"), ["p_size", "p_retailprice"]))


_CT_FEATS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@register("corr_target", _z(union_all([
    f"SELECT '{c}' AS \"column\", round(covar_pop({c}, l_extendedprice) / NULLIF(stddev_pop({c}) * stddev_pop(l_extendedprice), 0), {R}) AS r "
    f"FROM lineitem WHERE {c} IS NOT NULL AND l_extendedprice IS NOT NULL" for c in _CT_FEATS])))
def corr_target(spark, sf):
    from tablewright.operators.planning import target_correlations
    return _rounded(target_correlations(table(spark, sf, "lineitem"), "l_extendedprice", _CT_FEATS))


def _text_sql(c):
    if c == "flag":
        return "COALESCE(CASE WHEN flag THEN 'True' WHEN NOT flag THEN 'False' END, 'nan')"
    return f"COALESCE(CAST({c} AS VARCHAR), 'nan')"


@register("value_counts", with_dirty() + union_all([
    f"SELECT '{c}' AS \"column\", {_text_sql(c)} AS value, count(*) AS count "
    f"FROM dirty_orders GROUP BY 2" for c in ["category", "sparse", "flag"]]))
def value_counts(spark, sf):
    from tablewright.operators.eda import value_counts as vc
    return vc(dirty_orders(spark, sf), ["category", "sparse", "flag"])


@register("group_mean", "SELECT o_orderpriority AS x, round(avg(o_totalprice), 3) AS mean_y FROM orders GROUP BY 1")
def group_mean(spark, sf):
    from tablewright.operators.eda import group_mean as gm
    return gm(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice").withColumn("mean_y", F.round("mean_y", 3))


@register("min_class_count", "SELECT min(n) AS min_class_count FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)")
def min_class_count(spark, sf):
    c = table(spark, sf, "customer")
    return c.groupBy("c_mktsegment").count().agg(F.min("count").alias("min_class_count"))


@register("select_features", "SELECT l_quantity, l_discount, l_shipdate FROM lineitem")
def select_features(spark, sf):
    from tablewright.ml.data import feature_frame
    return feature_frame(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_shipdate"])


@register("drop_null_target", with_dirty() + "SELECT * FROM dirty_orders WHERE amount IS NOT NULL")
def drop_null_target(spark, sf):
    from tablewright.ml.data import drop_null_target as dnt
    return dnt(dirty_orders(spark, sf), "amount")


@register("drop_null_any", with_dirty() +
          "SELECT num_text, category, amount FROM dirty_orders WHERE num_text IS NOT NULL AND category IS NOT NULL AND amount IS NOT NULL")
def drop_null_any(spark, sf):
    return dirty_orders(spark, sf).select("num_text", "category", "amount").dropna("any")


@register("drop_columns", with_dirty() + "SELECT * EXCLUDE (sparse, flag) FROM dirty_orders")
def drop_columns(spark, sf):
    return dirty_orders(spark, sf).drop("sparse", "flag")


@register("pred_negative_target", union_all([
    "SELECT 'events.value' AS \"column\", bool_or(TRY_CAST(value AS DOUBLE) < 0) AS has_negative FROM events",
    "SELECT 'customer.c_acctbal' AS \"column\", bool_or(TRY_CAST(c_acctbal AS DOUBLE) < 0) AS has_negative FROM customer"]))
def pred_negative_target(spark, sf):
    from tablewright.ml.data import has_negative
    e = spark.createDataFrame([("events.value", has_negative(table(spark, sf, "events"), "value")),
                               ("customer.c_acctbal", has_negative(table(spark, sf, "customer"), "c_acctbal"))],
                              "column string, has_negative boolean")
    return e
