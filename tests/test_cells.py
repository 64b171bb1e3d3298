"""Regression trees fitted on cells: Spark's rules, every row drawn and summed up."""

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from tablewright.ml import cells as T
from tablewright.ml import models as M
from tablewright.ml.features import preprocessor

N = 6000


@pytest.fixture(scope="module")
def table(spark):
    """A number with one value very common and some missing, five levels."""
    i = F.col("id")
    rows = spark.range(0, N, 1, 3).select(
        "id", F.when(i % 50 != 0, F.when(i % 10 < 3, 77).otherwise(i * 7919 % 1013)).alias("u"), F.concat(F.lit("t"), i * 31 % 5).alias("t"),
        (i * 7919 % 1013 % 17 + F.when(i * 31 % 5 == 1, i % 7).otherwise(0) + i * 104729 % 211 / 10).cast("double").alias("_label"))
    return preprocessor(rows, ["u", "t"]).fit(rows).transform(rows).select("id", "features", "_label").cache()


def _apart(a, b, table):
    both = a.transform(table).select("id", F.col("prediction").alias("a")).join(b.transform(table).select("id", F.col("prediction").alias("b")), "id")
    r = both.agg(F.count("id").alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("most"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean")).first()
    assert r["n"] == N
    return r


def test_cells_hold_every_row(table):
    c = T.binned(table, N)
    y = table.agg(F.sum("_label").alias("s"), F.sum(F.col("_label") ** 2).alias("q")).first()
    assert c.n.sum() == N and c.s.sum() == pytest.approx(y["s"]) and c.q.sum() == pytest.approx(y["q"]) and len(c.cuts[0]) == 31
    got = c.rows.groupBy("cell").count().sort("cell").collect()
    assert [r["count"] for r in got] == list(c.n)


def test_cuts_by_executors_and_driver_are_the_same(table, monkeypatch):
    here = T.binned(table, N).cuts
    monkeypatch.setattr(T, "MAX_VALUES", 10)
    assert T.binned(table, N).cuts == here


def test_boosting_equals_sparks(table):
    est = GBTRegressor(maxIter=12, maxDepth=3, stepSize=0.1, seed=42, labelCol="_label")
    mine = T.fit(est, T.binned(table, N))
    assert isinstance(mine, GBTRegressionModel) and mine.getNumTrees == 12 and _apart(est.fit(table), mine, table)["most"] < 1e-9


def test_a_whole_tree_equals_sparks(table):
    c = T.binned(table, N)
    made, end = T.grow(c.bins, c.starts, c.n, c.s, c.q, M.FOREST_MAX_DEPTH)
    tree = DecisionTreeRegressor(maxDepth=M.FOREST_MAX_DEPTH, seed=42, labelCol="_label").fit(table)
    assert len(made["id"]) == tree.numNodes
    mine = {(i, round(p, 9)) for i, p in zip(range(len(end)), made["prediction"][end])}
    got = T._keyed(tree.transform(table), "features", c.cuts).groupBy("_cell").agg(F.min("prediction").alias("p"), F.max("prediction").alias("q")).collect()
    at = {tuple(k): i for i, k in enumerate(c.bins.tolist())}
    assert all(r["p"] == r["q"] for r in got) and {(at[tuple(r["_cell"])], round(r["p"], 9)) for r in got} == mine


def test_forest_draws_each_row_poisson_times(table):
    """Each tree has its own draw of about all rows, and the forest is as Spark's."""
    est = RandomForestRegressor(numTrees=60, maxDepth=30, featureSubsetStrategy="all", seed=42, labelCol="_label")
    c = T.binned(table, N)
    mine = T.fit(est, c)
    assert isinstance(mine, RandomForestRegressionModel) and mine.getNumTrees == 60
    rows = np.array([t._call_java("rootNode").impurityStats().count() for t in mine.trees])
    assert len(set(rows)) > 30 and abs(rows.mean() - N) < 5 * (N / 60) ** 0.5 and 0.5 < rows.var() / N < 1.8
    spark, other = est.fit(table), est.copy({est.seed: 7}).fit(table)
    assert _apart(spark, mine, table)["mean"] < 1.5 * _apart(spark, other, table)["mean"]
    assert _apart(mine, T.fit(est, c), table)["most"] < 1e-9


def test_prediction_by_cell_is_the_models(spark, table, tmp_path):
    """Also of rows outside the cells, and after saving."""
    est = RandomForestRegressor(numTrees=5, maxDepth=30, featureSubsetStrategy="all", seed=42, labelCol="_label")
    half = table.where(T.vector_to_array("features")[1] == 0)
    mine = T.fit(est, T.binned(half, half.count()))
    mine.write().save(f"{tmp_path}/forest")
    assert _apart(RandomForestRegressionModel.load(f"{tmp_path}/forest"), mine, table)["most"] < 1e-12


def test_rows_that_share_no_cells_and_odd_values_go_to_spark(spark, table):
    assert T.binned(table.limit(100), 100) is None
    assert T.binned(table.withColumn("_label", F.when(F.col("id") != 5, F.col("_label"))), N) is None
    assert T.binned(table.withColumn("_label", F.when(F.col("id") != 5, F.col("_label")).otherwise(float("nan"))), N) is None


def _events(spark, folder, n):
    i = F.col("id")
    spark.range(0, n, 1, 2).select(i.alias("event_id"), (i * 7919 % 997).alias("user_id"), F.concat(F.lit("t"), i % 5).alias("event_type"), (i * 104729 % 1009 / 10).alias("value")) \
        .write.parquet(f"{folder}/events.parquet")


@pytest.mark.parametrize("name", ["ml_rf_reg", "ml_compare_regressors"])
def test_queries_fit_trees_on_cells(spark, monkeypatch, tmp_path, name):
    """No pass of Spark's trees over the rows; the facts are as before."""
    from tablewright.queries import all_queries
    for kind in (RandomForestRegressor, GBTRegressor):
        monkeypatch.setattr(kind, "_fit", lambda self, df: pytest.fail("fitted row by row"))
    monkeypatch.setattr(M, "FOREST_TREES", 10)
    monkeypatch.setattr(M, "BOOST_STAGES", 10)
    _events(spark, tmp_path, 5000)
    rows = all_queries()[name](spark, str(tmp_path)).collect()
    assert [r["train_rows"] for r in rows] == [4000] * len(rows)
    if name == "ml_rf_reg":
        assert (rows[0]["scored_rows"], rows[0]["in_range_rows"], rows[0]["fits_training"]) == (5000, 5000, True)
    else:
        assert len(rows) == 10 and {r["Model"] for r in rows} == set(M.REGRESSORS) and all(r["scores_in_range"] and r["ordered"] for r in rows)
