"""Quantiles, ranks and correlations against numpy / brute force."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import corr as C
from tablewright.operators import kendall as K
from tablewright.operators import stats as S
from tablewright.operators.ranks import running_weight


def _frame(spark, seed=0, n=400):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"x": rng.integers(0, 15, n).astype(float), "y": rng.normal(size=n).round(1),
                        "z": rng.integers(0, 4, n).astype(float)})
    pdf.loc[rng.choice(n, 20, replace=False), "y"] = np.nan
    return spark.createDataFrame(pdf), pdf


def test_quantiles_match_numpy_linear(spark):
    df, pdf = _frame(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = S.quantiles(df, ["x", "y", "z"], probs)
    for c in ["x", "y", "z"]:
        v = pdf[c].dropna().to_numpy()
        for p in probs:
            assert got[c][p] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12)


def test_running_weight_paths_agree(spark):
    df, _ = _frame(spark, seed=3, n=2000)
    freq = S.freq_table(df, ["x", "y", "z"])
    one = {(r["column"], r["value"]): r["_below"] for r in
           running_weight(freq, ["column"], ["value"], "count", n_slices=1).collect()}
    many = {(r["column"], r["value"]): r["_below"] for r in
            running_weight(freq, ["column"], ["value"], "count", n_slices=5).collect()}
    assert one == many


@pytest.mark.parametrize("rows", [1, 10, 100_000])
def test_quantiles_by_digits(spark, monkeypatch, rows):
    """Buckets settled by bits alone, by ordering, and both: signs, zeros of both
    signs, infinities, tiny and huge values, heavy repeats, nulls and NaN."""
    rng = np.random.default_rng(5)
    wild = np.concatenate([rng.normal(size=900) * 10.0 ** rng.integers(-300, 300, 900), np.zeros(300), -np.zeros(50), np.full(400, 7.25),
                           [np.inf, -np.inf, 5e-324, -5e-324, 1.7e308, -1.7e308]])
    pdf = pd.DataFrame({"wild": rng.permutation(wild), "near": 1e9 + rng.integers(0, 5, len(wild)) * 2.0**-20, "one": 3.0, "none": np.nan})
    pdf.loc[rng.choice(len(wild), 77, replace=False), "near"] = np.nan
    monkeypatch.setattr(S, "BUCKET_ROWS", rows)
    probs = [0.0, 0.013, 0.25, 0.5, 0.77, 1.0]
    got = S.quantiles(spark.createDataFrame(pdf), list(pdf.columns), probs)
    assert "none" not in got
    for c in ("wild", "near", "one"):
        v = np.sort(pdf[c].dropna().to_numpy())
        for p in probs:
            k = (len(v) - 1) * p
            a, b = v[int(np.floor(k))], v[int(np.ceil(k))]
            assert got[c][p] == (a if k == np.floor(k) else a + (k - np.floor(k)) * (b - a))


def _brute_tau(x, y):
    s = tx = ty = 0
    n = len(x)
    for i, j in itertools.combinations(range(n), 2):
        s += np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
        tx += x[i] == x[j]
        ty += y[i] == y[j]
    n0 = n * (n - 1) / 2
    return s / np.sqrt((n0 - tx) * (n0 - ty))


@pytest.mark.parametrize("block_rows", [16, 50, 100000])
def test_kendall_blocks_equal_brute_force(spark, monkeypatch, block_rows):
    df, pdf = _frame(spark, seed=11, n=300)
    monkeypatch.setattr(K, "BLOCK_ROWS", block_rows)
    sub = pdf[["x", "z"]].dropna()
    assert C.kendall_pair(df, "x", "z") == pytest.approx(_brute_tau(sub["x"].to_numpy(), sub["z"].to_numpy()), abs=1e-12)
    sub = pdf[["x", "y"]].dropna()
    assert C.kendall_pair(df, "x", "y") == pytest.approx(_brute_tau(sub["x"].to_numpy(), sub["y"].to_numpy()), abs=1e-12)


def test_spearman_and_pearson_match_pandas(spark):
    df, pdf = _frame(spark, seed=2)
    for method, fn in [("spearman", C.spearman_matrix), ("pearson", C.pearson_matrix)]:
        got = {(r["a"], r["b"]): r["r"] for r in fn(df, ["x", "y", "z"]).collect()}
        ref = pdf.corr(method)
        for a in "xyz":
            for b in "xyz":
                assert got[(a, b)] == pytest.approx(ref.loc[a, b], abs=1e-9)


def test_skew_and_modes(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (2.0, "b"), (10.0, "a"), (None, None)], "v double, s string")
    row = df.agg(S.skew_expr(df["v"]).alias("sk")).collect()[0]
    assert row["sk"] == pytest.approx(pd.Series([1.0, 2.0, 2.0, 10.0]).skew())
    assert S.modes(df, ["s"]) == {"s": "a"}
    const = spark.createDataFrame([(3.0,), (3.0,), (3.0,)], "v double")
    assert const.agg(S.skew_expr(const["v"]).alias("s")).collect()[0]["s"] == 0.0


def test_sign_sums_brute_force():
    """Many sets of weighted distinct points in one call."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        sets = []
        for g in range(int(rng.integers(1, 6))):
            m = int(rng.integers(1, 30))
            pts = np.unique(np.stack([rng.integers(0, 5, m), rng.integers(0, 9, m)], 1), axis=0)
            sets.append((pts[:, 0].astype(float), pts[:, 1].astype(float), rng.integers(1, 4, len(pts)).astype(float)))
        brute = [sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) * w[i] * w[j] for i in range(len(x)) for j in range(i)) for x, y, w in sets]
        order = rng.permutation(sum(len(x) for x, _, _ in sets))
        g = np.repeat(np.arange(len(sets)), [len(x) for x, _, _ in sets])[order]
        got = K.sign_sums(g, *[np.concatenate([v[c] for v in sets])[order] for c in range(3)])
        assert got == pytest.approx(brute)


@pytest.mark.parametrize("block_rows", [16, 100000])
def test_kendall_matrix_batched_pairs_with_nulls(spark, monkeypatch, block_rows):
    df, pdf = _frame(spark, seed=21, n=250)
    monkeypatch.setattr(K, "BLOCK_ROWS", block_rows)
    got = {(r["a"], r["b"]): r["r"] for r in C.kendall_matrix(df, ["x", "y", "z"]).collect()}
    for a, b in [("x", "y"), ("x", "z"), ("y", "z")]:
        sub = pdf[[a, b]].dropna()
        ref = _brute_tau(sub[a].to_numpy(), sub[b].to_numpy())
        assert got[(a, b)] == pytest.approx(ref, abs=1e-12)
        assert got[(b, a)] == pytest.approx(ref, abs=1e-12)


def test_kendall_of_a_million_points(spark):
    """Nearly a million distinct points, half of them with one x, in
    blocks of production size, against a merge count on one array."""
    n = 1_000_000
    df = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.lit(500.0)).otherwise((F.xxhash64("id") % 1000000).cast("double")).alias("x"),
        ((F.xxhash64("id", F.lit(7)) % 1000000) + (F.xxhash64("id") % 1000000) / 4).cast("double").alias("y"))
    pdf = df.toPandas().groupby(["x", "y"]).size().reset_index(name="w")
    x, y, w = (pdf[c].to_numpy(float) for c in ("x", "y", "w"))
    s = K.sign_sums(np.zeros(len(x), int), x, y, w)[0]
    pairs = lambda t: float((t * (t - 1) / 2).sum())
    free = [pairs(np.array([w.sum()])) - pairs(pdf.groupby(c)["w"].sum().to_numpy(float)) for c in "xy"]
    assert len(x) > 980_000 and s > 0
    assert K.kendall_pairs(df, [("x", "y")])["x", "y"] == pytest.approx(s / np.sqrt(free[0] * free[1]), rel=1e-9)


def test_kendall_parts_are_bounded(spark):
    """No set is counted above the block size, and twenty thousand points make
    many sets; without rows or on a constant side there is no value."""
    df = spark.range(20000).select((F.xxhash64("id") % 50).cast("double").alias("x"), F.xxhash64("id", F.lit(1)).cast("double").alias("y"))
    points = df.select(F.lit(0).alias("pair"), F.lit("").alias("prob"), F.lit(True).alias("full"), "x", "y", F.lit(1.0).alias("w"))
    parts = K._parts(points, K._sizes(points, K.BLOCK_ROWS).drop("n"))
    sizes = [r["n"] for r in parts.groupBy("prob").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 8 and max(sizes) < K.BLOCK_ROWS
    none = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, None)], "a double, b double, c double")
    assert set(K.kendall_pairs(none, [("a", "b"), ("a", "c")]).values()) == {None}
    assert K.kendall_pairs(none.limit(0), [("a", "b")]) == {("a", "b"): None}


def test_duplicate_count_exact_with_nulls(spark):
    rows = [(1, "a", None), (1, "a", None), (2, None, 1.0), (2, None, 1.0), (2, None, 1.0), (3, "b", 0.0)]
    df = spark.createDataFrame(rows, "k int, s string, v double")
    assert S.duplicate_count(df) == 3
    assert S.duplicate_count(df.dropDuplicates()) == 0


def test_duplicate_count_float_normalisation(spark):
    rows = [(1, "a", 0.0), (1, "a", -0.0), (2, None, float("nan")), (2, None, float("nan")), (3, "b", 1.0)]
    df = spark.createDataFrame(rows, "k int, s string, v double")
    assert S.duplicate_count(df) == 2 == df.count() - df.dropDuplicates().count()


def test_approx_variants_close(spark):
    df, pdf = _frame(spark, seed=8, n=2000)
    u = {r["column"]: r["unique_approx"] for r in S.approx_nunique(df, ["x", "z"]).collect()}
    assert u == {"x": pdf["x"].nunique(), "z": pdf["z"].nunique()}
    q = {r["p"]: r["value_approx"] for r in S.approx_quantiles(df, ["y"], [0.5]).collect()}
    assert abs(q[0.5] - pdf["y"].median()) < 0.2


def test_quantiles_small_buckets(spark, monkeypatch):
    df, pdf = _frame(spark, seed=6, n=3000)
    monkeypatch.setattr(S, "BUCKET_ROWS", 10)
    got = S.quantiles(df, ["x", "y"], [0.1, 0.5, 0.9])
    for c in ["x", "y"]:
        v = pdf[c].dropna().to_numpy()
        for p in [0.1, 0.5, 0.9]:
            assert got[c][p] == pytest.approx(np.quantile(v, p))


def test_nunique_in_the_own_type(spark):
    df = spark.createDataFrame([(2 ** 53 + i, float("nan") if i % 2 else -0.0, None, "a") for i in range(10)] + [(None, 0.0, None, None)], "k long, x double, z string, s string")
    assert {r["column"]: r["unique"] for r in S.nunique(df, ["k", "x", "z", "s"]).collect()} == {"k": 10, "x": 1, "z": 0, "s": 1}


def test_pearson_of_many_columns_is_two_scans(spark):
    """However many pairs: jobs don't grow with the columns; constants, nulls and
    large offsets as numpy has them."""
    from tablewright.operators.corr import pearson_matrix
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 100)) + 1e6
    x[:, 7] = 3.7
    x[rng.random((400, 100)) < 0.1] = np.nan
    cols = [f"c{i}" for i in range(100)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in cols)).repartition(3).cache()
    df.count()
    spark.sparkContext.setJobGroup("pearson", "pearson")
    got = {(r["a"], r["b"]): r["r"] for r in pearson_matrix(df, cols).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("pearson"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 8
    for i, j in [(0, 1), (2, 50), (98, 99), (3, 7)]:
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        want = None if 7 in (i, j) else np.corrcoef(x[both, i], x[both, j])[0, 1]
        assert got[cols[i], cols[j]] == (pytest.approx(want, abs=1e-9) if want is not None else None)
    assert got["c0", "c0"] == 1.0 and got["c7", "c7"] is None
    df.unpersist()
