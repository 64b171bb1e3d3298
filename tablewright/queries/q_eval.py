"""Evaluation tables on ``lineitem`` with a rule-made prediction column (so
they can be checked before any model exists)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import evaluation as V
from tablewright.queries import register
from tablewright.sources.tables import table

R = 9
CLS_RULE_SQL = "CASE WHEN l_discount >= 0.07 THEN 'A' WHEN l_quantity > 30 THEN 'R' ELSE 'N' END"
REG_RULE_SQL = "l_quantity * 1500.0 + 900.0"
FOLD_SQL = "((l_orderkey * 7919 + l_linenumber) % 5)"


def cls_frame(spark, sf):
    li = table(spark, sf, "lineitem")
    pred = (F.when(F.col("l_discount") >= 0.07, "A").when(F.col("l_quantity") > 30, "R").otherwise("N"))
    return li.select(F.col("l_returnflag").alias("label"), pred.alias("prediction"),
                     ((F.col("l_orderkey") * 7919 + F.col("l_linenumber")) % 5).alias("fold"))


def reg_frame(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_extendedprice").alias("actual"),
                     (F.col("l_quantity") * 1500.0 + 900.0).alias("predicted"),
                     ((F.col("l_orderkey") * 7919 + F.col("l_linenumber")) % 5).alias("fold"))


_CLS_CTE = (
    f"WITH p AS (SELECT l_returnflag AS label, {CLS_RULE_SQL} AS prediction, {FOLD_SQL} AS fold FROM lineitem), "
    "c AS (SELECT fold, label, prediction, count(*) AS n FROM p GROUP BY ALL), "
    "cls AS (SELECT fold, label AS class FROM c UNION SELECT fold, prediction FROM c), "
    "pc AS (SELECT cls.fold, class, "
    "COALESCE((SELECT sum(n) FROM c WHERE c.fold = cls.fold AND label = class AND prediction = class), 0) AS tp, "
    "COALESCE((SELECT sum(n) FROM c WHERE c.fold = cls.fold AND label = class), 0) AS support, "
    "COALESCE((SELECT sum(n) FROM c WHERE c.fold = cls.fold AND prediction = class), 0) AS predicted FROM cls), "
    "m AS (SELECT *, COALESCE(CAST(tp AS DOUBLE) / NULLIF(predicted, 0), 0.0) AS precision, "
    "COALESCE(CAST(tp AS DOUBLE) / NULLIF(support, 0), 0.0) AS recall FROM pc), "
    "m2 AS (SELECT *, COALESCE(2 * precision * recall / NULLIF(precision + recall, 0), 0.0) AS f1 FROM m), "
    "g AS (SELECT class, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM pc GROUP BY class), "
    "gm AS (SELECT *, COALESCE(CAST(tp AS DOUBLE) / NULLIF(predicted, 0), 0.0) AS precision, "
    "COALESCE(CAST(tp AS DOUBLE) / NULLIF(support, 0), 0.0) AS recall FROM g), "
    "gm2 AS (SELECT *, COALESCE(2 * precision * recall / NULLIF(precision + recall, 0), 0.0) AS f1 FROM gm) ")

_METRIC_SQL = {
    "accuracy": "sum(tp) * 1.0 / sum(support)",
    "precision_weighted": "sum(precision * support) / sum(support)",
    "recall_weighted": "sum(recall * support) / sum(support)",
    "f1_weighted": "sum(f1 * support) / sum(support)",
}


def _cls_metric(spark, sf, name):
    m = V.classification_metrics(cls_frame(spark, sf), "label", "prediction")
    return m.select(F.round(name, R).alias(name))


for _key, _name in [("eval_accuracy", "accuracy"), ("eval_precision_w", "precision_weighted"),
                    ("eval_recall_w", "recall_weighted"), ("eval_f1_w", "f1_weighted")]:
    register(_key, _CLS_CTE + f"SELECT round({_METRIC_SQL[_name]}, {R}) AS {_name} FROM gm2")(
        lambda spark, sf, _n=_name: _cls_metric(spark, sf, _n))


@register("eval_report", _CLS_CTE + (
    f"SELECT class AS row, round(precision, {R}) AS precision, round(recall, {R}) AS recall, round(f1, {R}) AS f1, "
    "CAST(support AS BIGINT) AS support FROM gm2 UNION ALL "
    f"SELECT 'accuracy', NULL, NULL, round(sum(tp) * 1.0 / sum(support), {R}), CAST(sum(support) AS BIGINT) FROM gm2 UNION ALL "
    f"SELECT 'macro avg', round(avg(precision), {R}), round(avg(recall), {R}), round(avg(f1), {R}), CAST(sum(support) AS BIGINT) FROM gm2 UNION ALL "
    f"SELECT 'weighted avg', round(sum(precision * support) / sum(support), {R}), round(sum(recall * support) / sum(support), {R}), "
    f"round(sum(f1 * support) / sum(support), {R}), CAST(sum(support) AS BIGINT) FROM gm2"))
def eval_report(spark, sf):
    r = V.classification_report(cls_frame(spark, sf), "label", "prediction")
    return r.select("row", *[F.round(c, R).alias(c) for c in ["precision", "recall", "f1"]], "support")


@register("eval_confusion", f"WITH p AS (SELECT l_returnflag AS label, {CLS_RULE_SQL} AS prediction FROM lineitem), "
                            "l AS (SELECT DISTINCT label FROM p) "
                            "SELECT a.label AS actual, b.label AS predicted, "
                            "(SELECT count(*) FROM p WHERE p.label = a.label AND p.prediction = b.label) AS count "
                            "FROM l a, l b")
def eval_confusion(spark, sf):
    return V.confusion(cls_frame(spark, sf), "label", "prediction")


@register("sorted_labels", "SELECT row_number() OVER (ORDER BY label) AS position, label FROM "
                           "(SELECT DISTINCT CAST(l_returnflag AS VARCHAR) AS label FROM lineitem)")
def sorted_labels(spark, sf):
    return V.sorted_labels(table(spark, sf, "lineitem"), "l_returnflag")


_REG = f"WITH p AS (SELECT l_extendedprice AS actual, {REG_RULE_SQL} AS predicted, {FOLD_SQL} AS fold FROM lineitem) "
_R2 = ("CASE WHEN var_pop(actual) * count(actual) = 0 THEN CASE WHEN sum((actual - predicted) ^ 2) = 0 THEN 1.0 ELSE 0.0 END "
       "ELSE 1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(actual)) END")
_RMSE = "sqrt(sum((actual - predicted) ^ 2) / count(actual))"
_MAE = "avg(abs(actual - predicted))"


# decimals kept: r2 is about 1, errors are price-sized (about 1e4)
_DEC = {"r2": 9, "rmse": 3, "mae": 3}


def _reg_metric(spark, sf, name):
    m = V.regression_metrics(reg_frame(spark, sf), "actual", "predicted")
    return m.select(F.round(name, _DEC[name]).alias(name))


for _key, _name, _sql in [("eval_r2", "r2", _R2), ("eval_rmse", "rmse", _RMSE), ("eval_mae", "mae", _MAE)]:
    register(_key, _REG + f"SELECT round({_sql}, {_DEC[_name]}) AS {_name} FROM p")(
        lambda spark, sf, _n=_name: _reg_metric(spark, sf, _n))


@register("cv_mean", _REG + f"SELECT 'rule' AS model, 5 AS folds, round(avg(r2), 9) AS r2, round(avg(rmse), 3) AS rmse, "
                            f"round(avg(mae), 3) AS mae FROM (SELECT fold, {_R2} AS r2, {_RMSE} AS rmse, {_MAE} AS mae "
                            "FROM p GROUP BY fold)")
def cv_mean(spark, sf):
    per_fold = V.regression_metrics(reg_frame(spark, sf), "actual", "predicted", by=["fold"])
    return per_fold.agg(F.lit("rule").alias("model"), F.count(F.lit(1)).cast("int").alias("folds"),
                        *[F.round(F.avg(c), _DEC[c]).alias(c) for c in ["r2", "rmse", "mae"]])


@register("min_max", _REG + "SELECT least(min(actual), min(predicted)) AS min_val, "
                            "greatest(max(actual), max(predicted)) AS max_val FROM p")
def min_max(spark, sf):
    return V.min_max(reg_frame(spark, sf), "actual", "predicted")


@register("eval_pred_actual", _REG + "SELECT actual, predicted FROM p")
def eval_pred_actual(spark, sf):
    return reg_frame(spark, sf).select("actual", "predicted")


@register("eval_residual_hist", _REG + (
    "SELECT CAST(b AS INTEGER) AS bin, lo2 + b * ((hi2 - lo2) / 30) AS lo, lo2 + (b + 1) * ((hi2 - lo2) / 30) AS hi, "
    "(SELECT count(*) FROM p WHERE least(greatest(CAST(floor(((actual - predicted) - lo2) / (hi2 - lo2) * 30) AS INTEGER), 0), 29) = b) AS count "
    "FROM (SELECT CASE WHEN min(actual - predicted) = max(actual - predicted) THEN min(actual - predicted) - 0.5 ELSE min(actual - predicted) END AS lo2, "
    "CASE WHEN min(actual - predicted) = max(actual - predicted) THEN max(actual - predicted) + 0.5 ELSE max(actual - predicted) END AS hi2 FROM p), "
    "range(0, 30) t(b)"))
def eval_residual_hist(spark, sf):
    return V.residual_hist(reg_frame(spark, sf), "actual", "predicted", 30)


_BANDS = _REG + (
    ", e AS (SELECT quantile_cont(actual, 0.0) AS e0, quantile_cont(actual, 0.25) AS e1, quantile_cont(actual, 0.5) AS e2, "
    "quantile_cont(actual, 0.75) AS e3, quantile_cont(actual, 1.0) AS e4 FROM p), "
    "b AS (SELECT actual, predicted, CASE WHEN actual <= e1 THEN 0 WHEN actual <= e2 THEN 1 WHEN actual <= e3 THEN 2 ELSE 3 END AS band, "
    "e0, e1, e2, e3, e4 FROM p, e) "
    "SELECT band, CASE band WHEN 0 THEN any_value(e0) WHEN 1 THEN any_value(e1) WHEN 2 THEN any_value(e2) ELSE any_value(e3) END AS band_lo, "
    "CASE band WHEN 0 THEN any_value(e1) WHEN 1 THEN any_value(e2) WHEN 2 THEN any_value(e3) ELSE any_value(e4) END AS band_hi, "
    "count(*) AS rows, round(avg(actual), 3) AS mean_actual, round(avg(predicted), 3) AS mean_predicted, "
    "round(avg(abs(actual - predicted)), 3) AS mean_abs_error FROM b GROUP BY band")


def _bands(spark, sf):
    t = V.error_bands(reg_frame(spark, sf), "actual", "predicted")
    return t.select("band", "band_lo", "band_hi", "rows",
                    *[F.round(c, 3).alias(c) for c in ["mean_actual", "mean_predicted", "mean_abs_error"]])


register("eval_bands", _BANDS)(_bands)
register("band_agg", _BANDS)(_bands)
