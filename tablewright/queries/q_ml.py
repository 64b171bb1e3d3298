"""Feature pipeline, split/folds, models and comparison.

Closed-form oracles where SQL can state the answer (imputers, scaler, one-hot,
split and folds with an arithmetic order key, one-feature OLS / ridge /
lasso, and a whole comparison of the closed-form models); for the tree,
boosting and logistic models, facts that any right fit satisfies."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.ml import models as M
from tablewright.ml.compare import build_pipeline, has_two_classes, predict, scoring_model, spread, train_and_compare
from tablewright.ml.features import ExactMedianImputer, ModeImputer, PopulationScaler, preprocessor
from tablewright.ml.split import assign_split_folds, split_sizes
from tablewright.queries import register
from tablewright.queries.sqlhelp import with_dirty
from tablewright.sources.tables import dirty_orders, table
from tablewright.staging import staged

R = 6

@register("ml_impute_num", with_dirty() + "SELECT o_orderkey, COALESCE(amount, (SELECT median(amount) FROM dirty_orders)) AS amount_imp FROM dirty_orders")
def ml_impute_num(spark, sf):
    d = dirty_orders(spark, sf)
    m = ExactMedianImputer(inputCols=["amount"], outputCols=["amount_imp"]).fit(d)
    return m.transform(d).select("o_orderkey", "amount_imp")


_MODE_CAT = "(SELECT category FROM dirty_orders WHERE category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@register("ml_impute_cat", with_dirty() + f"SELECT o_orderkey, COALESCE(category, {_MODE_CAT}) AS category_imp FROM dirty_orders")
def ml_impute_cat(spark, sf):
    d = dirty_orders(spark, sf)
    m = ModeImputer(inputCols=["category"], outputCols=["category_imp"]).fit(d)
    return m.transform(d).select("o_orderkey", "category_imp")


def _z0_sql(e):
    return f"(CASE WHEN {e} = 0 THEN 0.0 ELSE {e} END)"


def _z0(c):
    """-0.0 shown as 0.0: a value next to the mean may round to either sign."""
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


_SC = ("round((amount - (SELECT avg(amount) FROM dirty_orders)) / (SELECT CASE WHEN stddev_pop(amount) > 0 "
       f"THEN stddev_pop(amount) ELSE 1 END FROM dirty_orders), {R})")


@register("ml_scale", with_dirty() + f"SELECT o_orderkey, {_z0_sql(_SC)} AS amount_sc FROM dirty_orders")
def ml_scale(spark, sf):
    d = dirty_orders(spark, sf)
    m = PopulationScaler(inputCols=["amount"], outputCols=["amount_sc"]).fit(d)
    return m.transform(d).select("o_orderkey", _z0(F.round("amount_sc", R)).alias("amount_sc"))


_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _onehot_sql():
    cols = ", ".join(f"CASE WHEN c = '{lv}' THEN 1.0 ELSE 0.0 END AS oh_{i}" for i, lv in enumerate(_LEVELS))
    return with_dirty() + f"SELECT o_orderkey, {cols} FROM (SELECT o_orderkey, COALESCE(category, {_MODE_CAT}) AS c FROM dirty_orders)"


def _unpack(df, col, n, prefix):
    arr = vector_to_array(F.col(col))
    return [arr[i].alias(f"{prefix}{i}") for i in range(n)]


@register("ml_onehot", _onehot_sql())
def ml_onehot(spark, sf):
    d = dirty_orders(spark, sf)
    pm = preprocessor(d, ["category"], output="oh").fit(d)
    out = pm.transform(d)
    return out.select("o_orderkey", *_unpack(out, "oh", len(_LEVELS), "oh_"))


@register("ml_preprocess", with_dirty() + (
    "SELECT o_orderkey, " + _z0_sql("round((COALESCE(amount, m) - mu) / sd, 6)") + " AS f0, " +
    ", ".join(f"CASE WHEN COALESCE(category, {_MODE_CAT}) = '{lv}' THEN 1.0 ELSE 0.0 END AS f{i + 1}" for i, lv in enumerate(_LEVELS)) +
    " FROM dirty_orders, (SELECT median(amount) AS m FROM dirty_orders), "
    "(SELECT avg(a) AS mu, CASE WHEN stddev_pop(a) > 0 THEN stddev_pop(a) ELSE 1 END AS sd FROM "
    "(SELECT COALESCE(amount, (SELECT median(amount) FROM dirty_orders)) AS a FROM dirty_orders))"))
def ml_preprocess(spark, sf):
    d = dirty_orders(spark, sf)
    pm = preprocessor(d, ["amount", "category"]).fit(d)
    out = pm.transform(d)
    cols = _unpack(out, "features", 1 + len(_LEVELS), "f")
    return out.select("o_orderkey", _z0(F.round(cols[0], 6)).alias("f0"), *cols[1:])


# split / folds on customer with an order both engines can compute
_ORD_SQL = "((c_custkey * 7919) % 10007)"


def _ord():
    return (F.col("c_custkey") * 7919) % 10007


def _split_sql(strat: bool):
    cls = "c_mktsegment" if strat else "'all'"
    return (
        f"WITH r AS (SELECT c_custkey, {cls} AS cls, row_number() OVER (PARTITION BY {cls} ORDER BY {_ORD_SQL}, c_custkey) - 1 AS rk FROM customer), "
        f"{_SIZES_SQL}, "
        "k AS (SELECT greatest(2, least(5, " + ("min(m)" if strat else "max(m) // 5") + ")) AS k FROM s) "
        "SELECT c_custkey, CASE WHEN rk < tn THEN 'test' ELSE 'train' END AS split, CAST(CASE WHEN rk < tn THEN -1 "
        "WHEN rk - tn < (m % k) * (m // k + 1) THEN (rk - tn) // (m // k + 1) "
        "ELSE m % k + (rk - tn - (m % k) * (m // k + 1)) // (m // k) END AS INTEGER) AS fold FROM r JOIN s USING (cls), k")


# class sizes: n rows, tn test rows (largest remainders), m training rows
_SIZES_SQL = (
    "c AS (SELECT cls, count(*) AS n, CAST(ceil(0.2 * sum(count(*)) OVER ()) AS BIGINT) AS total, CAST(sum(count(*)) OVER () AS BIGINT) AS every FROM r GROUP BY cls), "
    "f AS (SELECT *, total * n // every AS base, total - CAST(sum(total * n // every) OVER () AS BIGINT) AS spare, "
    "row_number() OVER (ORDER BY total * n % every DESC, cls) AS place FROM c), "
    "s AS (SELECT cls, n, base + CASE WHEN place <= spare THEN 1 ELSE 0 END AS tn, n - base - CASE WHEN place <= spare THEN 1 ELSE 0 END AS m FROM f)")


@register("ml_split", _split_sql(True))
def ml_split(spark, sf):
    c = table(spark, sf, "customer")
    out, _ = assign_split_folds(c, "c_mktsegment", "classification", order=_ord(), tie_cols=["c_custkey"])
    # test rows have no fold: shown as -1
    return out.select("c_custkey", F.col("_split").alias("split"), F.coalesce("_fold", F.lit(-1)).alias("fold"))


@register("ml_folds", _split_sql(False))
def ml_folds(spark, sf):
    c = table(spark, sf, "customer")
    out, _ = assign_split_folds(c, "c_acctbal", "regression", order=_ord(), tie_cols=["c_custkey"])
    # test rows have no fold: shown as -1
    return out.select("c_custkey", F.col("_split").alias("split"), F.coalesce("_fold", F.lit(-1)).alias("fold"))


@register("ml_folds_n", f"SELECT 'classification' AS task, CAST(greatest(2, least(5, min(m))) AS INTEGER) AS folds FROM (WITH r AS (SELECT c_mktsegment AS cls FROM customer), {_SIZES_SQL} SELECT m FROM s) UNION ALL "
                        f"SELECT 'regression', CAST(greatest(2, least(5, max(m) // 5)) AS INTEGER) FROM (WITH r AS (SELECT 'all' AS cls FROM customer), {_SIZES_SQL} SELECT m FROM s)")
def ml_folds_n(spark, sf):
    c = table(spark, sf, "customer")
    a, b = split_sizes(c, "c_mktsegment", "classification"), split_sizes(c, "c_acctbal", "regression")
    return spark.createDataFrame([("classification", a["folds"]), ("regression", b["folds"])], "task string, folds int")


def _one_feature_fit(spark, sf, name):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    data = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(li) \
        .withColumn("_label", F.col("l_extendedprice"))
    row = li.agg(F.count("l_extendedprice").alias("n"), F.stddev_pop("l_extendedprice").alias("sd")).collect()[0]
    st = M.FoldStats(n=row["n"], label_sd_pop=row["sd"], n_features=1)
    m = M.regressor(name, st).fit(data)
    return spark.createDataFrame([(round(float(m.intercept), R), round(float(m.coefficients[0]), R))],
                                 "intercept double, slope double")


@register("ml_linreg", f"SELECT round(regr_intercept(l_extendedprice, l_quantity), {R}) AS intercept, "
                       f"round(regr_slope(l_extendedprice, l_quantity), {R}) AS slope FROM lineitem")
def ml_linreg(spark, sf):
    return _one_feature_fit(spark, sf, "Linear Regression")


@register("ml_ridge", f"SELECT round(avg(l_extendedprice) - any_value(s) * avg(l_quantity), {R}) AS intercept, round(any_value(s), {R}) AS slope "
                      "FROM lineitem, (SELECT covar_pop(l_quantity, l_extendedprice) * count(*) / "
                      f"(var_pop(l_quantity) * count(*) + {M.RIDGE_ALPHA}) AS s FROM lineitem)")
def ml_ridge(spark, sf):
    return _one_feature_fit(spark, sf, "Ridge")


@register("ml_lasso", f"SELECT round(avg(l_extendedprice) - any_value(s) * avg(l_quantity), {R}) AS intercept, round(any_value(s), {R}) AS slope "
                      "FROM lineitem, (SELECT sign(covar_pop(l_quantity, l_extendedprice)) * "
                      f"greatest(abs(covar_pop(l_quantity, l_extendedprice)) - {M.LASSO_ALPHA}, 0) / var_pop(l_quantity) AS s FROM lineitem)")
def ml_lasso(spark, sf):
    return _one_feature_fit(spark, sf, "Lasso")


def docs_labelled(spark, sf):
    """documents joined to their quality labels (labels cover some docs)."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id")


_DOC_FEATS = ["lang", "source", "n_chars"]
_EV_FEATS = ["user_id", "event_type"]


# ---- single models: facts that hold for any right fit -----------------------
# The split is a hash order and the trees are random, so SQL states what every
# fit must satisfy on every row: how many rows were trained on and scored, that
# predictions stay among the labels (forests: inside the training range), and
# that the training part is fitted no worse than by its majority or mean.

def _facts_sql(source: str, target: str, extra: str = "") -> str:
    return (f"SELECT n - t AS train_rows, t AS test_rows, n AS scored_rows, n AS in_range_rows, true AS fits_training{extra} "
            f"FROM (SELECT count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS t FROM {source} WHERE {target} IS NOT NULL)")


_CLS_SRC, _REG_SRC = "documents JOIN labels USING (doc_id)", "events"


def _fitted(spark, sf, task, name):
    """(scored rows: _split, actual, predicted; the fitted pipeline; training part)."""
    if task == "classification":
        df, target, feats, keys = docs_labelled(spark, sf), "quality", _DOC_FEATS, ["doc_id"]
    else:
        df, target, feats, keys = table(spark, sf, "events"), "value", _EV_FEATS, ["event_id"]
    data = df.select(*keys, *feats, target).where(F.col(target).isNotNull())
    tagged, info = assign_split_folds(data, target, task, tie_cols=keys)
    tagged = staged(spread(tagged, info["train_rows"] + info["test_rows"]), "split")
    train = tagged.filter("_split = 'train'")
    model = build_pipeline(train, target, feats, task, name).fit(train)
    scored = scoring_model(model).transform(tagged).select("_split", F.col(target).cast("double").alias("actual"), F.col("predicted").cast("double").alias("predicted"))
    return scored, model, train


def _facts(scored, in_range, fits):
    train = F.col("_split") == "train"
    return scored.agg(
        F.count_if(train).alias("train_rows"), F.count_if(~train).alias("test_rows"), F.count("predicted").alias("scored_rows"),
        F.count_if(in_range).alias("in_range_rows"), fits.alias("fits_training"))


def _classifier_facts(spark, sf, name):
    scored, model, train = _fitted(spark, sf, "classification", name)
    train_row = F.col("_split") == "train"
    ones, n = F.count_if(train_row & (F.col("actual") == 1)), F.count_if(train_row)
    fits = F.count_if(train_row & (F.col("actual") == F.col("predicted"))) >= F.greatest(ones, n - ones)
    return _facts(scored, F.col("predicted").isin(0.0, 1.0), fits), model, train


def _regressor_facts(spark, sf, name, bounded):
    scored, _, _ = _fitted(spark, sf, "regression", name)
    train_row = F.col("_split") == "train"
    y = F.when(train_row, F.col("actual"))
    e = F.when(train_row, F.col("actual") - F.col("predicted"))
    if bounded:  # an average of training values lies between them
        ends = scored.agg(F.min(y).alias("lo"), F.max(y).alias("hi")).first()
        in_range = F.col("predicted").between(ends["lo"] - 1e-9, ends["hi"] + 1e-9)
    else:
        in_range = F.col("predicted").isNotNull() & ~F.isnan("predicted")
    return _facts(scored, in_range, F.sum(e * e) <= F.var_pop(y) * F.count(y))


@register("ml_logreg", _facts_sql(_CLS_SRC, "quality", ", true AS gradient_is_zero"))
def ml_logreg(spark, sf):
    """With the objective's gradient on the training part: zero at the optimum."""
    facts, model, train = _classifier_facts(spark, sf, "Logistic Regression")
    lr = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    reg = lr.getOrDefault("regParam")
    p = vector_to_array(F.col("probability"))[1]
    rows = model.transform(train).select((p - F.col("_label")).alias("e"), F.posexplode(F.concat(vector_to_array(F.col("features")), F.array(F.lit(1.0)))).alias("slot", "x"))
    weights = [*(float(w) * reg for w in lr.coefficients), 0.0]
    gradient = rows.groupBy("slot").agg((F.avg(F.col("e") * F.col("x")) + F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("slot") + 1)).alias("g"))
    return facts.withColumn("gradient_is_zero", F.lit(gradient.agg(F.max(F.abs("g")) < 1e-4).first()[0]))


@register("ml_rf_cls", _facts_sql(_CLS_SRC, "quality"))
def ml_rf_cls(spark, sf):
    return _classifier_facts(spark, sf, "Random Forest")[0]


@register("ml_gbt_cls", _facts_sql(_CLS_SRC, "quality"))
def ml_gbt_cls(spark, sf):
    return _classifier_facts(spark, sf, "Gradient Boosting")[0]


@register("ml_rf_reg", _facts_sql(_REG_SRC, "value"))
def ml_rf_reg(spark, sf):
    return _regressor_facts(spark, sf, "Random Forest", True)


@register("ml_gbt_reg", _facts_sql(_REG_SRC, "value"))
def ml_gbt_reg(spark, sf):
    return _regressor_facts(spark, sf, "Gradient Boosting", False)


# ---- comparison of closed-form models, stated in SQL from split to prediction ----
# Length of a document by its number of words, with an order key that both
# engines can compute.

_WORDS = ["n_words"]


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.split("text", " ")).cast("double").alias("n_words"), "n_chars")


def comparison(spark, sf, transform="none"):
    return train_and_compare(_documents(spark, sf), "n_chars", "regression", feature_columns=_WORDS, key_cols=["doc_id"],
                             order=(F.col("doc_id") * 7919) % 10007, target_transform=transform, model_names=["Linear Regression", "Ridge"])


def _cmp_sql(transform="none") -> str:
    """CTEs: d rows with split and fold, fit (one line per model and training
    part; part -1: all folds), cv per-fold scores, board, best, pred of all rows."""
    y = "ln(1 + n_chars)" if transform == "log1p" else "CAST(n_chars AS DOUBLE)"
    back = (lambda e: f"(exp({e}) - 1)") if transform == "log1p" else (lambda e: e)
    line = back("a + b * x")
    return f"""WITH r AS (SELECT doc_id, CAST(len(string_split(text, ' ')) AS DOUBLE) AS x, CAST(n_chars AS DOUBLE) AS raw, {y} AS y,
      row_number() OVER (ORDER BY (doc_id * 7919) % 10007, doc_id) - 1 AS rk, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL),
    q AS (SELECT *, CAST(ceil(0.2 * n) AS BIGINT) AS tn FROM r),
    s AS (SELECT *, n - tn AS m, greatest(2, least(5, (n - tn) // 5)) AS k FROM q),
    d AS (SELECT *, CASE WHEN rk < tn THEN -1 WHEN rk - tn < (m % k) * (m // k + 1) THEN (rk - tn) // (m // k + 1)
      ELSE m % k + (rk - tn - (m % k) * (m // k + 1)) // (m // k) END AS fold FROM s),
    parts AS (SELECT DISTINCT fold AS part FROM d),
    ols AS (SELECT part, regr_slope(y, x) AS b, avg(x) AS mx, avg(y) AS my, count(*) AS c FROM parts JOIN d ON fold >= 0 AND fold <> part GROUP BY part),
    fit AS (SELECT part, 'Linear Regression' AS model, b, my - b * mx AS a FROM ols
      UNION ALL SELECT part, 'Ridge', b * c / (c + {M.RIDGE_ALPHA}), my - b * c / (c + {M.RIDGE_ALPHA}) * mx FROM ols),
    p AS (SELECT part, model, doc_id, raw, {line} AS yhat FROM d JOIN fit ON part = fold),
    sc AS (SELECT part, model, 1 - sum((raw - yhat) ** 2) / (var_pop(raw) * count(*)) AS r2, sqrt(avg((raw - yhat) ** 2)) AS rmse, avg(abs(raw - yhat)) AS mae
      FROM p GROUP BY part, model),
    board AS (SELECT model, count(*) AS cv_folds, avg(r2) AS r2, avg(rmse) AS rmse, avg(mae) AS mae FROM sc WHERE part >= 0 GROUP BY model),
    best AS (SELECT model FROM board ORDER BY r2 DESC, model LIMIT 1) """


_SCORES = ", ".join(f"round({m}, {R}) AS {m}" for m in ("r2", "rmse", "mae"))


def _rounded(df, *lead):
    return df.select(*lead, *[F.round(m, R).alias(m) for m in ("r2", "rmse", "mae")])


def _setup_sql(transform="none"):
    return (_cmp_sql(transform) + "SELECT 'regression' AS task_type, any_value(n) AS rows_used, CAST(1 AS INTEGER) AS feature_count, any_value(m) AS train_rows, any_value(tn) AS test_rows, "
            f"CAST(any_value(k) AS INTEGER) AS cv_folds, (SELECT model FROM best) AS best_model, '{transform}' AS target_transform, 'n_words' AS feature_columns")


@register("ml_leaderboard", _cmp_sql() + f"SELECT model AS \"Model\", CAST(cv_folds AS INTEGER) AS cv_folds, {_SCORES} FROM board")
def ml_leaderboard(spark, sf):
    return _rounded(comparison(spark, sf).leaderboard, "Model", "cv_folds")


@register("sort_leaderboard", _cmp_sql() + "SELECT model AS \"Model\", CAST(row_number() OVER (ORDER BY r2 DESC, model) AS INTEGER) AS place FROM board")
def sort_leaderboard(spark, sf):
    """The place shows the order of the (short) leaderboard's rows."""
    rows = comparison(spark, sf).leaderboard.collect()
    return spark.createDataFrame([(r["Model"], i + 1) for i, r in enumerate(rows)], "Model string, place int")


@register("ml_fit_best", _cmp_sql() + f"SELECT doc_id, raw AS actual, round(yhat, {R}) AS predicted FROM p JOIN best USING (model) WHERE part = -1")
def ml_fit_best(spark, sf):
    return comparison(spark, sf).test_predictions.select("doc_id", "actual", F.round("predicted", R).alias("predicted"))


@register("ml_setup", _setup_sql() + " FROM d")
def ml_setup(spark, sf):
    return comparison(spark, sf).setup


@register("ml_scoring", _cmp_sql() + f"SELECT model, CAST(part AS INTEGER) AS fold, {_SCORES} FROM sc WHERE part >= 0")
def ml_scoring(spark, sf):
    """Per-fold scores of the comparison."""
    return _rounded(comparison(spark, sf).fold_scores, "model", F.col("fold").cast("int").alias("fold"))


@register("ml_log_target", _setup_sql("log1p") + f", (SELECT round(r2, 4) FROM sc JOIN best USING (model) WHERE part = -1) AS test_r2 FROM d")
def ml_log_target(spark, sf):
    a = comparison(spark, sf, "log1p")
    return a.setup.withColumn("test_r2", F.lit(round(float(a.evaluation.first()["r2"]), 4)))


_PREDICT_ALL = (f"SELECT doc_id, round(a + b * CAST(len(string_split(text, ' ')) AS DOUBLE), {R}) AS predicted "
                "FROM documents, fit JOIN best USING (model) WHERE part = -1")


@register("ml_predict", _cmp_sql() + _PREDICT_ALL)
def ml_predict(spark, sf):
    """Every document, used in training or not."""
    a = comparison(spark, sf)
    return predict(a.best_model, _documents(spark, sf).drop("n_chars")).select("doc_id", F.round("predicted", R).alias("predicted"))


@register("ml_compare_classifiers", "WITH r AS (SELECT quality AS cls FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), " + _SIZES_SQL +
          ", k AS (SELECT CAST(greatest(2, least(5, min(m))) AS INTEGER) AS k FROM s) SELECT model AS \"Model\", k AS cv_folds, true AS scores_in_range, true AS ordered "
          "FROM k, (VALUES " + ", ".join(f"('{m}')" for m in M.CLASSIFIERS) + ") AS t(model)")
def ml_compare_classifiers(spark, sf):
    """The whole catalogue of classifiers at full size: folds, score ranges and
    the order of the leaderboard."""
    a = train_and_compare(docs_labelled(spark, sf), "quality", "classification", feature_columns=_DOC_FEATS, key_cols=["doc_id"])
    rows = a.leaderboard.collect()
    ordered = all(x["accuracy"] >= y["accuracy"] for x, y in zip(rows, rows[1:])) and rows[0]["Model"] == a.best_model_name
    return spark.createDataFrame([(r["Model"], r["cv_folds"], 0 <= r["accuracy"] <= 1 and 0 <= r["f1_weighted"] <= 1, ordered) for r in rows],
                                 "Model string, cv_folds int, scores_in_range boolean, ordered boolean")


# ---- all regressors on mixed features ----------------------------------------
# Values by user and type of event, some of both missing.  OLS on a number and
# the levels of a category is one slope within the levels and a mean for each,
# so SQL states its scores from the split through imputing to the folds; for
# the other models it states folds, ranges and order.

_EV_SQL = "CASE WHEN event_id % 50 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 40 <> 0 THEN event_type END AS event_type"
_EV_ORDER = 10007


def _events(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.when(e % 50 != 0, F.col("user_id")).alias("user_id"), F.when(e % 40 != 0, F.col("event_type")).alias("event_type"), "value")


def _regressors_sql(transform: str) -> str:
    y = "ln(1 + value)" if transform == "log1p" else "value"
    back = "exp(my + b * (x - mx)) - 1" if transform == "log1p" else "my + b * (x - mx)"
    return f"""SELECT * FROM (WITH r AS (SELECT event_id, {_EV_SQL}, value AS raw, {y} AS y, row_number() OVER (ORDER BY (event_id * 7919) % {_EV_ORDER}, event_id) - 1 AS rk,
        count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
      q AS (SELECT *, CAST(ceil(0.2 * n) AS BIGINT) AS tn FROM r),
      s AS (SELECT *, n - tn AS m, greatest(2, least(5, (n - tn) // 5)) AS k FROM q),
      d AS (SELECT *, CASE WHEN rk < tn THEN -1 WHEN rk - tn < (m % k) * (m // k + 1) THEN (rk - tn) // (m // k + 1)
        ELSE m % k + (rk - tn - (m % k) * (m // k + 1)) // (m // k) END AS fold FROM s),
      parts AS (SELECT DISTINCT fold AS part FROM d WHERE fold >= 0),
      med AS (SELECT part, median(user_id) AS u FROM parts JOIN d ON fold >= 0 AND fold <> part GROUP BY part),
      cnt AS (SELECT part, event_type AS t, count(*) AS c FROM parts JOIN d ON fold >= 0 AND fold <> part AND event_type IS NOT NULL GROUP BY part, event_type),
      md AS (SELECT part, t FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY c DESC, t) AS i FROM cnt) WHERE i = 1),
      z AS (SELECT part, fold, raw, y, coalesce(user_id, u) AS x, coalesce(event_type, t) AS t FROM d CROSS JOIN parts JOIN med USING (part) JOIN md USING (part) WHERE fold >= 0),
      g AS (SELECT part, t, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM z WHERE fold <> part GROUP BY part, t),
      b AS (SELECT part, sum(sxy) / sum(sxx) AS b FROM g GROUP BY part),
      p AS (SELECT part, raw, {back} AS yhat FROM z JOIN g USING (part, t) JOIN b USING (part) WHERE fold = part),
      sc AS (SELECT part, 1 - sum((raw - yhat) ** 2) / (var_pop(raw) * count(*)) AS r2, sqrt(avg((raw - yhat) ** 2)) AS rmse, avg(abs(raw - yhat)) AS mae FROM p GROUP BY part),
      o AS (SELECT round(avg(r2), 4) AS r2, round(avg(rmse), 3) AS rmse, round(avg(mae), 3) AS mae FROM sc),
      i AS (SELECT any_value(n) AS rows_used, any_value(m) AS train_rows, any_value(tn) AS test_rows, CAST(any_value(k) AS INTEGER) AS cv_folds FROM d)
    SELECT '{transform}' AS transform, model AS "Model", i.*, true AS scores_in_range, true AS ordered,
      CASE WHEN model = 'Linear Regression' THEN r2 END AS r2, CASE WHEN model = 'Linear Regression' THEN rmse END AS rmse, CASE WHEN model = 'Linear Regression' THEN mae END AS mae
    FROM i, o, (VALUES {", ".join(f"('{m}')" for m in M.REGRESSORS)}) AS t(model))"""


@register("ml_compare_regressors", _regressors_sql("none") + " UNION ALL " + _regressors_sql("log1p"))
def ml_compare_regressors(spark, sf):
    """The whole catalogue of regressors, plain and on log1p of the target."""
    def compare(transform):
        return train_and_compare(_events(spark, sf), "value", "regression", feature_columns=["user_id", "event_type"], key_cols=["event_id"],
                                 order=(F.col("event_id") * 7919) % _EV_ORDER, target_transform=transform)

    rows, transforms = [], ("none", "log1p")
    with ThreadPoolExecutor(max_workers=2) as pool:
        both = list(pool.map(compare, transforms))
    for transform, a in zip(transforms, both):
        board, s = a.leaderboard.collect(), a.setup.first()
        ordered = all(x["r2"] >= y["r2"] for x, y in zip(board, board[1:])) and board[0]["Model"] == a.best_model_name
        for r in board:
            ols = r["Model"] == "Linear Regression"
            rows.append((transform, r["Model"], s["rows_used"], s["train_rows"], s["test_rows"], r["cv_folds"], r["r2"] <= 1 and 0 <= r["mae"] <= r["rmse"], ordered,
                         *(round(r[m], d) if ols else None for m, d in (("r2", 4), ("rmse", 3), ("mae", 3)))))
    return spark.createDataFrame(rows, "transform string, Model string, rows_used long, train_rows long, test_rows long, cv_folds int, scores_in_range boolean, ordered boolean, "
                                       "r2 double, rmse double, mae double")


@register("ml_check_classes", "SELECT 'c_mktsegment' AS target, count(DISTINCT c_mktsegment) >= 2 AS ok FROM customer")
def ml_check_classes(spark, sf):
    c = table(spark, sf, "customer")
    return spark.createDataFrame([("c_mktsegment", has_two_classes(c, "c_mktsegment"))], "target string, ok boolean")
