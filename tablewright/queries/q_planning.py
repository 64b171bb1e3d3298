"""Planning: task detection, transform advice, feature presets, top correlated."""

from __future__ import annotations

from tablewright.operators.planning import detect_task, presets_table, recommend_transform, strongest
from tablewright.queries import register
from tablewright.sources.tables import table

_TARGETS = [("events", "value"), ("lineitem", "l_extendedprice"), ("customer", "c_mktsegment"), ("customer", "c_nationkey")]
_TEXT = {("customer", "c_mktsegment")}


def _detect_sql(t, c):
    if (t, c) in _TEXT:
        return f"SELECT '{t}.{c}' AS target, 'classification' AS task"
    return (f"SELECT '{t}.{c}' AS target, CASE WHEN count(DISTINCT {c}) <= 20 THEN 'classification' "
            f"ELSE 'regression' END AS task FROM {t}")


@register("detect_task", " UNION ALL ".join(_detect_sql(t, c) for t, c in _TARGETS))
def q_detect_task(spark, sf):
    rows = [(f"{t}.{c}", detect_task(table(spark, sf, t), c)) for t, c in _TARGETS]
    return spark.createDataFrame(rows, "target string, task string")


def _rec_sql(t, c):
    if (t, c) in _TEXT:
        return f"SELECT '{t}.{c}' AS target, 'none' AS transform"
    return (f"SELECT '{t}.{c}' AS target, CASE WHEN count(DISTINCT {c}) <= 20 THEN 'none' "
            f"WHEN count({c}) = 0 OR min({c}) < 0 THEN 'none' "
            f"WHEN abs(CASE WHEN var_pop({c}) = 0 THEN 0 ELSE skewness({c}) END) >= 1 THEN 'log1p' ELSE 'none' END AS transform "
            f"FROM {t}")


@register("recommend_transform", " UNION ALL ".join(_rec_sql(t, c) for t, c in _TARGETS))
def q_recommend_transform(spark, sf):
    rows = []
    for t, c in _TARGETS:
        df = table(spark, sf, t)
        rows.append((f"{t}.{c}", recommend_transform(df, c, detect_task(df, c))))
    return spark.createDataFrame(rows, "target string, transform string")


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]
_LI_CAT = ["l_returnflag", "l_linestatus", "l_shipdate"]
_LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
           "l_returnflag", "l_linestatus", "l_shipdate"]


def _corr_rank_sql():
    br = " UNION ALL ".join(
        f"SELECT '{c}' AS c, {i} AS pos, abs(covar_pop({c}, l_extendedprice) / NULLIF(stddev_pop({c}) * stddev_pop(l_extendedprice), 0)) AS r FROM lineitem"
        for i, c in enumerate(_LI_NUM))
    return f"rk AS (SELECT c, row_number() OVER (ORDER BY r DESC NULLS LAST, pos) AS position FROM ({br}))"


def _presets_sql():
    rows = []
    for i, c in enumerate(_LI_ALL):
        rows.append(f"SELECT 'All Features' AS preset, {i + 1} AS position, '{c}' AS \"column\"")
    for i, c in enumerate(_LI_NUM):
        rows.append(f"SELECT 'Numeric Only', {i + 1}, '{c}'")
    rows.append("SELECT 'Top Correlated', position, c FROM rk WHERE position <= 5")
    rows.append("SELECT 'Enriched Mix', position, c FROM rk WHERE position <= 5")
    rows.append("SELECT 'Enriched Mix', 6, 'l_returnflag'")
    rows.append("SELECT 'Enriched Mix', 7, 'l_linestatus'")
    return f"WITH {_corr_rank_sql()} " + " UNION ALL ".join(rows)


@register("feature_presets", _presets_sql())
def q_feature_presets(spark, sf):
    li = table(spark, sf, "lineitem")
    return presets_table(li, "l_extendedprice", "regression")


@register("topk_corr", f"WITH {_corr_rank_sql()} SELECT position, c AS \"column\" FROM rk WHERE position <= 5")
def q_topk_corr(spark, sf):
    best = strongest(table(spark, sf, "lineitem"), "l_extendedprice", _LI_NUM)[:5]
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(best)], "position long, column string")
