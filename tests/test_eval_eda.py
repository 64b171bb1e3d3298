"""Evaluation and EDA tables: totals and hand-computed values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import eda as E
from tablewright.operators import evaluation as V
from tablewright.sources.tables import table
from tests.conftest import SF001


def test_classification_metrics_by_hand(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    m = V.classification_metrics(df, "label", "prediction").collect()[0]
    # per class: a p=1/2 r=1/2; b p=2/3 r=1; c p=0 r=0 ; supports 2, 2, 1
    assert m["accuracy"] == pytest.approx(3 / 5)
    assert m["precision_weighted"] == pytest.approx((0.5 * 2 + 2 / 3 * 2) / 5)
    assert m["recall_weighted"] == pytest.approx((0.5 * 2 + 1.0 * 2) / 5)
    f1b = 2 * (2 / 3) / (2 / 3 + 1)
    assert m["f1_weighted"] == pytest.approx((0.5 * 2 + f1b * 2) / 5)
    conf = V.confusion(df, "label", "prediction")
    assert conf.count() == 9 and conf.agg(F.sum("count")).collect()[0][0] == 5


def test_regression_metrics_constant_actual(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "a double, p double")
    assert V.regression_metrics(df, "a", "p").collect()[0]["r2"] == 1.0
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "a double, p double")
    assert V.regression_metrics(df, "a", "p").collect()[0]["r2"] == 0.0


def test_histogram_counts_sum_to_n_and_match_numpy(spark):
    li = table(spark, SF001, "lineitem")
    h = E.histograms(li, ["l_extendedprice", "l_discount"], 30)
    vals = li.select("l_extendedprice").toPandas()["l_extendedprice"].to_numpy()
    got = [r["count"] for r in h.filter("column = 'l_extendedprice'").orderBy("bin").collect()]
    assert got == list(np.histogram(vals, bins=30)[0])
    assert h.groupBy("column").agg(F.sum("count").alias("n")).filter(F.col("n") != li.count()).count() == 0


def test_constant_column_histogram(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    h = {r["bin"]: r["count"] for r in E.histograms(df, ["v"], 10).collect()}
    assert h[5] == 2 and sum(h.values()) == 2


def test_qcut_bands_drop_repeated_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3]], "v double")
    banded, edges = V.qcut_bands(df, "v", 4)
    assert edges == sorted(set(edges))
    assert banded.filter("band IS NULL").count() == 0


def test_flier_sample_bounded_and_outside(spark):
    li = table(spark, SF001, "lineitem")
    box = E.boxplot(li, ["l_quantity", "l_extendedprice"])
    fl = E.flier_sample(li, box, 5).collect()
    b = {r["column"]: r for r in box.collect()}
    for r in fl:
        bb = b[r["column"]]
        lo, hi = bb["q1"] - 1.5 * (bb["q3"] - bb["q1"]), bb["q3"] + 1.5 * (bb["q3"] - bb["q1"])
        assert r["value"] < lo or r["value"] > hi
    for c in b:
        assert len([r for r in fl if r["column"] == c]) == min(5, b[c]["fliers_lo"] + b[c]["fliers_hi"])


def test_run_eda_all_modules(spark):
    from tablewright.plans.eda_select import MODULES, run_eda
    o = table(spark, SF001, "orders")
    out = run_eda(o, "o_totalprice", MODULES, {"order_by": ["o_orderkey"], "viz_x": "o_orderpriority",
                                              "viz_y": "o_totalprice", "viz_plot_type": "bar"})
    for m in MODULES:
        assert m in out, m
    assert out["Target Deep Dive (scatter)"].agg(F.sum("count")).collect()[0][0] == 2 * o.count()
    assert out["Pairwise Relationships"].count() == 1000
    assert out["Custom Feature Plot"].count() == 5


def test_full_profile(spark):
    """Text dates are profiled as timestamps; duplicates and correlations belong to it."""
    from tablewright.operators.profile import full_profile
    rows = [(1, "2020-01-02", "x", 2.0), (2, "2020-01-03", "y", 4.0), (3, None, "z", 6.0), (3, None, "z", 6.0), (4, "bad", "w", None), (5, "2021-05-06", "x", 10.0),
            (6, "2021-05-07", "v", 12.0), (7, "2021-05-08", "v", 14.0)]
    p = full_profile(spark.createDataFrame(rows, "k long, d string, s string, v double"), ["k"])
    cols = {r["column"]: r for r in p["columns"].collect()}
    assert (cols["d"]["dtype"], cols["d"]["count"], cols["d"]["nulls"]) == ("timestamp", 5, 3) and cols["s"]["dtype"] == "string"
    assert p["duplicates"].collect()[0]["duplicates"] == 1
    r = {(x["a"], x["b"]): x["r"] for x in p["correlations"].collect()}
    assert set(r) == {(a, b) for a in "kv" for b in "kv"} and r["k", "v"] == pytest.approx(1.0) and r["k", "k"] == 1.0


def test_run_eda_says_why_a_module_is_empty(spark):
    from tablewright.plans.eda_select import MODULES, run_eda
    text = spark.createDataFrame([("a",), ("b",)], "s string")
    out = run_eda(text, "missing", MODULES, {"viz_y": "nowhere"})
    assert set(MODULES) <= set(out)
    noted = {m for m, d in out.items() if d.columns == ["note"]}
    assert noted == {"Numeric Distributions", "Outlier Boxplots", "Correlation Heatmap", "Pairwise Relationships", "Target Deep Dive", "Custom Feature Plot"}
    assert "nowhere" in out["Custom Feature Plot"].first()["note"] and "missing" in out["Target Deep Dive"].first()["note"]
    assert run_eda(spark.createDataFrame([(1,)], "n int"), None, ["Categorical Distributions"])["Categorical Distributions"].columns == ["note"]


def test_profile_nan_and_top_values(spark, monkeypatch):
    """NaN is missing; the summary's candidates, settled by the recount, and the
    frequency table give the same rows, also where the summary is too small."""
    from pyspark.sql import functions as F
    from tablewright.operators import profile as P
    small = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (5.0,), (-0.0,), (0.0,)], "v double")
    r = P.column_profile(small).first()
    assert (r["count"], r["nulls"], r["distinct"], r["top_values"]) == (4, 2, 3, "0.0 (2), 1.0 (1), 5.0 (1)")
    df = spark.range(30000).select((F.sqrt("id") / 20).cast("int").alias("heavy"), (F.col("id") % 5000).alias("flat"), F.col("id").cast("string").alias("key"),
                                   F.when(F.col("id") % 3 == 0, F.repeat(F.lit("long "), 300)).otherwise(F.col("id").cast("string")).alias("mixed"), F.lit(None).cast("int").alias("none"))
    got = {r["column"]: (r["distinct"], r["top_values"]) for r in P.column_profile(df, 3).collect()}
    pdf = df.toPandas()
    for c in ("heavy", "flat", "key", "mixed"):
        counts = sorted(pdf[c].astype(str).value_counts().items(), key=lambda x: (-x[1], x[0]))
        assert got[c] == (len(counts), ", ".join(f"{v} ({n})" for v, n in counts[:3]))
    assert got["none"] == (0, "")
    monkeypatch.setattr(P, "TRACKED", 64)
    assert {r["column"]: (r["distinct"], r["top_values"]) for r in P.column_profile(df, 3).collect()} == got


def test_confusion_is_bounded(spark, monkeypatch):
    import pytest
    from tablewright.operators import evaluation as V
    df = spark.createDataFrame([(f"c{i}", f"c{i % 3}") for i in range(12)], "y string, p string")
    assert V.confusion(df, "y", "p").count() == 144
    assert [r["label"] for r in V.sorted_labels(df, "y").orderBy("position").collect()] == sorted(f"c{i}" for i in range(12))
    monkeypatch.setattr(V, "MAX_CONFUSION_CLASSES", 5)
    with pytest.raises(ValueError):
        V.confusion(df, "y", "p")


def test_staged_tables_go(spark):
    """Operators that return figures leave nothing in the shared folder."""
    import os
    from tablewright import staging
    from tablewright.operators import corr, profile, stats
    df = spark.range(3000).selectExpr("cast(id % 50 AS double) AS a", "cast(id * 7 % 400 AS double) AS b", "cast(id AS string) AS c")
    folder = staging._folder(spark).removeprefix("file:")
    staging.staged(df, "kept")
    before = set(os.listdir(folder))
    stats.quantiles(df, ["a", "b"], [0.1, 0.5])
    corr.kendall_matrix(df, ["a", "b"]).collect()
    corr.spearman_matrix(df, ["a", "b"]).collect()
    profile.column_profile(df).collect()
    assert set(os.listdir(folder)) == before
    with staging.scope(spark):
        inner = staging.staged(df, "inner")
        assert inner.count() == 3000
    assert set(os.listdir(folder)) == before
