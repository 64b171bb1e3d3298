"""The Spark ML settings reproduce the reference's objectives: compared with
numpy solutions of the same penalised problems on seeded tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablewright.ml import models as M


def _data(spark, seed, n=400, k=3, binary=False):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, k)) * np.array([1.0, 3.0, 0.5])[:k] + np.array([2.0, -1.0, 0.0])[:k]
    w = np.array([1.5, -0.7, 2.0])[:k]
    z = X @ w + 0.3 + rng.normal(scale=0.5, size=n)
    y = (z > np.median(z)).astype(float) if binary else z
    pdf = pd.DataFrame(X, columns=[f"x{i}" for i in range(k)])
    pdf["y"] = y
    df = VectorAssembler(inputCols=[f"x{i}" for i in range(k)], outputCol="features") \
        .transform(spark.createDataFrame(pdf)).withColumn("_label", F.col("y"))
    return df, X, y


def test_logistic_c1_matches_newton(spark):
    df, X, y = _data(spark, 1, binary=True)
    n = len(y)
    m = M.classifier("Logistic Regression", M.FoldStats(n=n, n_classes=2)).fit(df)
    # minimise 0.5 |w|^2 + sum log-loss (intercept not penalised) by Newton steps
    A = np.hstack([X, np.ones((n, 1))])
    b = np.zeros(A.shape[1])
    pen = np.diag([1.0] * X.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-A @ b))
        g = A.T @ (p - y) + pen @ b
        H = A.T @ (A * (p * (1 - p))[:, None]) + pen
        b -= np.linalg.solve(H, g)
    assert np.allclose(m.coefficients.toArray(), b[:-1], atol=1e-3)
    assert m.intercept == pytest.approx(b[-1], abs=1e-3)


def test_ridge_alpha_matches_closed_form(spark):
    df, X, y = _data(spark, 2)
    n = len(y)
    m = M.regressor("Ridge", M.FoldStats(n=n, label_sd_pop=float(np.std(y)), n_features=3)).fit(df)
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + M.RIDGE_ALPHA * np.eye(3), Xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-6)
    assert m.intercept == pytest.approx(y.mean() - X.mean(0) @ w, abs=1e-6)


def test_lasso_alpha_matches_coordinate_descent(spark):
    df, X, y = _data(spark, 3)
    n = len(y)
    m = M.regressor("Lasso", M.FoldStats(n=n, n_features=3)).fit(df)
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.zeros(3)
    for _ in range(5000):
        for j in range(3):
            r = yc - Xc @ w + Xc[:, j] * w[j]
            rho = Xc[:, j] @ r / n
            w[j] = np.sign(rho) * max(abs(rho) - M.LASSO_ALPHA, 0) / (Xc[:, j] @ Xc[:, j] / n)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-5)


def test_ols_matches_lstsq(spark):
    df, X, y = _data(spark, 4)
    m = M.regressor("Linear Regression", M.FoldStats(n=len(y), n_features=3)).fit(df)
    A = np.hstack([X, np.ones((len(y), 1))])
    b = np.linalg.lstsq(A, y, rcond=None)[0]
    assert np.allclose(m.coefficients.toArray(), b[:-1], atol=1e-8)
    assert m.intercept == pytest.approx(b[-1], abs=1e-8)
