"""Model comparison on seeded tables made for the tests (the reference's
regression sample file is absent, so no attempt is made to guess it)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel

from tablewright.ml import models as M
from tablewright.ml.compare import train_and_compare
from tablewright.ml.split import assign_split_folds
from tablewright.operators.planning import detect_task, feature_presets, recommend_transform


@pytest.fixture(scope="module")
def reg_df(spark):
    rng = np.random.default_rng(7)
    n = 300
    f1, f2 = rng.normal(size=n), rng.normal(size=n)
    cat = rng.choice(["x", "y", "z"], n)
    target = 3 * f1 - 2 * f2 + (cat == "x") * 1.5 + rng.normal(scale=0.1, size=n)
    pdf = pd.DataFrame({"id": np.arange(n), "feature_1": f1, "feature_2": f2, "cat": cat, "target": target})
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def cls_df(spark):
    rng = np.random.default_rng(9)
    n = 240
    seg = rng.choice(["A", "B", "C"], n)
    off = {"A": 0.0, "B": 2.0, "C": 4.0}
    pdf = pd.DataFrame({"id": np.arange(n), "feature_1": [off[s] + rng.normal() for s in seg],
                        "feature_2": rng.normal(size=n), "segment": seg})
    return spark.createDataFrame(pdf)


@pytest.fixture(autouse=True)
def few_trees(monkeypatch):
    monkeypatch.setattr(M, "FOREST_TREES", 10)
    monkeypatch.setattr(M, "BOOST_STAGES", 10)
    monkeypatch.setattr(M, "FOREST_MAX_DEPTH", 8)


def test_detect_task(spark, reg_df, cls_df):
    assert detect_task(cls_df, "segment") == "classification"
    assert detect_task(reg_df, "target") == "regression"


def test_regression_compare_and_predict(spark, reg_df, tmp_path):
    a = train_and_compare(reg_df, "target", "regression", feature_columns=["feature_1", "feature_2", "cat"],
                          key_cols=["id"])
    board = a.leaderboard.collect()
    assert {r["Model"] for r in board} == set(M.REGRESSORS)
    assert a.evaluation.collect()[0]["r2"] > 0.95
    s = a.setup.collect()[0]
    assert s["train_rows"] + s["test_rows"] == 300 and s["feature_count"] == 3
    preds = a.best_model.transform(reg_df.limit(5)).select("predicted").collect()
    assert len(preds) == 5
    path = str(tmp_path / "model")
    a.best_model.write().overwrite().save(path)
    again = PipelineModel.load(path).transform(reg_df).select("id", "predicted").orderBy("id").collect()
    first = a.best_model.transform(reg_df).select("id", "predicted").orderBy("id").collect()
    assert [r["predicted"] for r in again] == pytest.approx([r["predicted"] for r in first])


def test_log_target_and_presets(spark, reg_df):
    from pyspark.sql import functions as F
    shifted = reg_df.withColumn("target", F.col("target") - F.lit(-20.0))
    a = train_and_compare(shifted, "target", "regression", feature_columns=["feature_1", "feature_2"],
                          target_transform="log1p", key_cols=["id"], model_names=["Linear Regression", "Ridge"])
    s = a.setup.collect()[0]
    assert s["target_transform"] == "log1p" and s["feature_count"] == 2
    p = feature_presets(shifted, "target", "regression")
    assert {"All Features", "Numeric Only", "Top Correlated", "Enriched Mix"} <= set(p)
    assert p["Top Correlated"][:2] == ["feature_1", "feature_2"]
    assert recommend_transform(shifted, "target", "regression") in {"none", "log1p"}


def test_classification_compare(spark, cls_df):
    a = train_and_compare(cls_df, "segment", "classification", feature_columns=["feature_1", "feature_2"],
                          key_cols=["id"])
    assert a.evaluation.collect()[0]["accuracy"] > 0.6
    assert a.best_model_name in M.CLASSIFIERS


def test_split_is_stratified_and_folds_balanced(spark, cls_df):
    out, info = assign_split_folds(cls_df, "segment", "classification", tie_cols=["id"])
    pdf = out.toPandas()
    n = len(pdf)
    assert info["test_rows"] == int(np.ceil(0.2 * n)) and info["train_rows"] == n - info["test_rows"]
    for seg, g in pdf.groupby("segment"):
        assert abs((g["_split"] == "test").sum() - 0.2 * len(g)) < 1
        sizes = g[g["_split"] == "train"]["_fold"].value_counts()
        assert sizes.max() - sizes.min() <= 1
    assert info["folds"] == 5


def test_errors(spark, cls_df, reg_df):
    from pyspark.sql import functions as F
    one = cls_df.withColumn("segment", F.lit("A"))
    with pytest.raises(ValueError):
        train_and_compare(one, "segment", "classification", feature_columns=["feature_1"], key_cols=["id"])
    neg = reg_df.withColumn("target", F.lit(-1.0) * F.abs("target") - 1)
    with pytest.raises(ValueError):
        train_and_compare(neg, "target", "regression", target_transform="log1p", key_cols=["id"])


def test_driver_side_helpers(spark, reg_df):
    from tablewright.operators.planning import check_custom_preset, resolve_task, target_lost
    assert resolve_task(reg_df, "target", "classification") == "classification"
    assert resolve_task(reg_df, "target", None) == "regression"
    assert check_custom_preset(reg_df, "target", ["feature_1", "feature_1"]) == ["feature_1"]
    with pytest.raises(ValueError):
        check_custom_preset(reg_df, "target", [])
    assert target_lost(reg_df.drop("target"), "target")


def test_split_is_the_same_on_every_run(spark, cls_df):
    """Also with a key that isn't unique."""
    from pyspark.sql import functions as F
    df = cls_df.withColumn("k", F.col("id") % 7)
    a, ia = assign_split_folds(df, "segment", "classification", tie_cols=["k"])
    b, ib = assign_split_folds(df.repartition(5), "segment", "classification", tie_cols=["k"])
    ra = {r["id"]: (r["_split"], r["_fold"]) for r in a.collect()}
    rb = {r["id"]: (r["_split"], r["_fold"]) for r in b.collect()}
    assert ra == rb and ia == ib


def test_holdout_and_fold_sizes(spark):
    from tablewright.ml.split import holdout_counts
    assert holdout_counts({"A": 79, "B": 81, "C": 80}) == {"A": 16, "B": 16, "C": 16}
    assert sum(holdout_counts({str(i): 3 for i in range(50)}).values()) == 30
    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "id long, y double")
    out, info = assign_split_folds(df, "y", "regression", tie_cols=["id"], folds=5)
    sizes = [r["count"] for r in out.where("_split = 'train'").groupBy("_fold").count().orderBy("_fold").collect()]
    assert info["test_rows"] == 2 and sizes == [2, 2, 1, 1, 1]


def test_two_classes_fit_a_binary_model(spark, cls_df):
    """Coefficients equal Newton's method on the penalised log-likelihood."""
    from pyspark.sql import functions as F
    from tablewright.ml.compare import build_pipeline, scoring_model
    df = cls_df.withColumn("two", F.when(F.col("segment") == "A", "x").otherwise("y")).select("feature_1", "feature_2", "two")
    model = build_pipeline(df, "two", ["feature_1", "feature_2"], "classification", "Logistic Regression").fit(df)
    lr = [s for s in model.stages if hasattr(s, "numClasses")][0]
    assert lr.numClasses == 2
    pdf = df.toPandas()
    x = pdf[["feature_1", "feature_2"]].to_numpy()
    x = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    y, w = (pdf["two"] == "y").to_numpy(float), np.zeros(3)
    pen = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pen, x.T @ (p - y) + pen @ w)
    assert np.allclose([*lr.coefficients, lr.intercept], w, atol=1e-3)
    assert scoring_model(model).transform(df.drop("two")).select("predicted").distinct().count() <= 2


def test_wide_one_hot_uses_the_iterative_solver(spark):
    from tablewright.ml.compare import build_pipeline
    df = spark.createDataFrame([(f"level{i}", float(i % 13), float(i % 7)) for i in range(4200)], "c string, x double, y double")
    for name in ("Linear Regression", "Ridge"):
        model = build_pipeline(df, "y", ["c", "x"], "regression", name).fit(df)
        assert model.transform(df.limit(5)).select("predicted").count() == 5



def test_split_boundaries_among_copies(spark):
    """Exact copies across boundaries, a class that is one row repeated, missed
    brackets, null order values and an order that is text: the sizes are exact."""
    from pyspark.sql import functions as F
    rows = [("a", 1, 0)] * 300 + [("b", i % 3, i) for i in range(101)] + [("c", None, i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "cls string, k int, v int")
    for order in (None, F.col("k"), F.col("k").cast("string"), F.lit(5)):
        out, info = assign_split_folds(df, "cls", "classification", order=order, tie_cols=["k"])
        got = {(r["cls"], r["_split"], r["_fold"]): r["count"] for r in out.groupBy("cls", "_split", "_fold").count().collect()}
        assert out.count() == 451 and info["folds"] == 5 and info["test_rows"] == 91
        assert got["a", "test", None] == 61 and [got["a", "train", f] for f in range(5)] == [48, 48, 48, 48, 47]
        sizes = [got["b", "train", f] for f in range(5)]
        assert sum(sizes) + got["b", "test", None] == 101 and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
        assert sorted(map(str, out.drop("_split", "_fold").collect())) == sorted(map(str, df.collect()))


def test_split_moves_keys_only(spark, monkeypatch):
    """No exchange of the split carries a feature column."""
    import re
    from tablewright.ml import split as S
    plans = []
    monkeypatch.setattr(S, "running_weight", lambda df, *a, f=S.running_weight: (plans.append(df), f(df, *a))[1])
    df = spark.range(5000).selectExpr("id", "id % 3 AS y", "id * 2 AS feature_one", "cast(id AS string) AS feature_two")
    out, info = S.assign_split_folds(df, "y", "classification", tie_cols=["id"])
    assert out.where("_split = 'test'").count() == 1000
    for plan in (p._jdf.queryExecution().executedPlan().toString() for p in [*plans, out]):
        for line in re.findall(r"Exchange (?!SinglePartition)(?:hash|range)partitioning.*", plan):
            assert "feature" not in line
    assert "feature" in out._jdf.queryExecution().executedPlan().toString() and not re.search(r"Exchange (hash|range)", out._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0])
    assert plans and all("feature" not in str(p.columns) for p in plans)


def test_two_class_models_score_in_a_session_that_has_observed(spark, cls_df):
    """Their training summaries hold the session, which can't be sent to tasks
    after an observation."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F
    from tablewright.ml.compare import build_pipeline, scoring_model
    seen = Observation()
    assert spark.range(10).observe(seen, F.count("id").alias("n")).count() == 10 and seen.get == {"n": 10}
    df = cls_df.withColumn("two", F.when(F.col("segment") == "A", "x").otherwise("y")).select("id", "feature_1", "feature_2", "two")
    for name in ("Logistic Regression", "Random Forest"):
        model = build_pipeline(df, "two", ["feature_1", "feature_2"], "classification", name).fit(df)
        assert scoring_model(model).transform(df).where("predicted IS NOT NULL").count() == 240
    a = train_and_compare(df, "two", "classification", feature_columns=["feature_1", "feature_2"], key_cols=["id"], model_names=["Logistic Regression", "Random Forest"])
    assert a.leaderboard.count() == 2 and a.test_predictions.count() == 48


def test_fits_run_on_all_cores(spark, monkeypatch):
    """A table of one partition is spread before it is fitted on, alone and in a comparison."""
    from pyspark.ml.regression import LinearRegression
    from tablewright.ml import compare as C
    monkeypatch.setattr(C, "LEAST_ROWS", 100)
    cores, fitted = spark.sparkContext.defaultParallelism, []
    monkeypatch.setattr(LinearRegression, "_fit", lambda self, df, f=LinearRegression._fit: (fitted.append(df.rdd.glom().map(len).collect()), f(self, df))[1])
    df = spark.range(0, 200 * cores, 1, 1).selectExpr("id", "cast(id % 11 AS double) AS x", "cast(id % 7 AS double) AS y")
    C.build_pipeline(df, "y", ["x"], "regression", "Linear Regression").fit(df)
    train_and_compare(df, "y", "regression", feature_columns=["x"], key_cols=["id"], model_names=["Linear Regression"])
    # alone, five folds and the refit; no core has none or much more than its share
    assert len(fitted) == 7 and all(len(x) == cores and min(x) > 0 and max(x) <= 2 * sum(x) / cores for x in fitted)


def test_tasks_of_a_fit_are_bounded_and_even(spark):
    from tablewright.ml import compare as C
    cores = spark.sparkContext.defaultParallelism
    assert C._tasks(spark, 0) == C._tasks(spark, 1) == 1 and C._tasks(spark, C.LEAST_ROWS + 1) == min(2, cores)
    for rows in (cores * C.LEAST_ROWS, cores * C.ROWS_PER_TASK, cores * C.ROWS_PER_TASK + 1, 10 ** 8):
        n = C._tasks(spark, rows)
        assert n % cores == 0 and rows <= n * C.ROWS_PER_TASK


def test_large_forests_are_fitted_one_at_a_time(spark, reg_df, monkeypatch):
    from threading import Lock
    from pyspark.ml.regression import RandomForestRegressor
    from tablewright.ml import compare as C
    monkeypatch.setattr(C, "FOREST_ROWS", 300)
    lock, seen, at = Lock(), [], [0]

    def fit(self, df, f=RandomForestRegressor._fit):
        with lock:
            at[0] += 1
            seen.append(at[0])
        try:
            return f(self, df)
        finally:
            with lock:
                at[0] -= 1
    monkeypatch.setattr(RandomForestRegressor, "_fit", fit)
    a = train_and_compare(reg_df, "target", "regression", feature_columns=["feature_1", "cat"], key_cols=["id"], model_names=["Random Forest"])
    assert len(seen) == 6 and max(seen) == 1 and a.leaderboard.first()["cv_folds"] == 5


def test_forest_query_is_fitted_on_all_cores(spark, monkeypatch, tmp_path):
    """Documents and labels of one file each are joined into few partitions; the
    forest of ml_rf_cls gets its rows evenly over the cores, each one once."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.sql import functions as F
    from tablewright.ml import compare as C
    from tablewright.queries import all_queries
    monkeypatch.setattr(C, "LEAST_ROWS", 100)
    monkeypatch.setattr(M, "FOREST_TREES", 3)
    cores, fitted = spark.sparkContext.defaultParallelism, []
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, df, f=RandomForestClassifier._fit: (fitted.append(df.rdd.glom().map(len).collect()), f(self, df))[1])
    n = 250 * cores
    rows = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.element_at(F.array(F.lit("de"), F.lit("en")), (F.col("id") % 2 + 1).cast("int")).alias("lang"),
                                          F.lit("web").alias("source"), (F.col("id") * 7919 % 1009).alias("n_chars"), (F.col("id") % 3 == 0).cast("int").alias("quality"))
    rows.drop("quality").write.parquet(f"{tmp_path}/documents.parquet")
    rows.select("doc_id", "quality").write.parquet(f"{tmp_path}/labels.parquet")
    facts = all_queries()["ml_rf_cls"](spark, str(tmp_path)).first()
    assert (facts["train_rows"], facts["test_rows"], facts["scored_rows"]) == (n * 4 // 5, n // 5, n)
    (parts,) = fitted
    assert len(parts) == cores and sum(parts) == n * 4 // 5 and min(parts) > 0 and max(parts) <= 2 * sum(parts) / cores
