"""The Spark preparation against a plain pandas implementation of the same
documented rules, on random messy tables (values limited to tokens where
pandas' parsers and ours agree: plain numbers, ISO dates, words)."""

import numpy as np
import pandas as pd
import pytest

from tablewright.plans.prep import apply_preparation

WORDS = ["bad", "n/a-ish", "unknown", "x"]


def _table(seed, n=120):
    rng = np.random.default_rng(seed)
    nums = [str(int(v)) if rng.random() > 0.05 else str(rng.choice(WORDS)) for v in rng.integers(0, 500, n)]
    dates = [f"20{rng.integers(10, 24)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
             if rng.random() > 0.04 else str(rng.choice(WORDS)) for _ in range(n)]
    cats = [str(v) for v in rng.choice(["a", "b", "c", "d"], n)]
    amount = rng.lognormal(3, 1, n)
    rows = []
    for i in range(n):
        rows.append((None if rng.random() < 0.1 else nums[i], None if rng.random() < 0.1 else dates[i],
                     None if rng.random() < 0.2 else cats[i], None if rng.random() < 0.15 else float(amount[i]),
                     int(rng.integers(0, 50)), None if rng.random() < 0.6 else "s"))
    rows += rows[: n // 10]  # exact copies
    return rows


def _pandas_prep(pdf, num_t=0.9, date_t=0.9, max_missing=40.0):
    out = pdf.drop_duplicates().reset_index(drop=True)
    for c in [c for c in out.columns if out[c].dtype == object]:
        s = out[c].dropna()
        if len(s) and pd.to_numeric(s, errors="coerce").notna().mean() >= num_t:
            out[c] = pd.to_numeric(out[c], errors="coerce")
    for c in [c for c in out.columns if out[c].dtype == object]:
        s = out[c].dropna()
        if len(s) and pd.to_datetime(s, errors="coerce", format="%Y-%m-%d").notna().mean() >= date_t:
            t = pd.to_datetime(out[c], errors="coerce", format="%Y-%m-%d")
            out[f"{c}_year"], out[f"{c}_month"], out[f"{c}_day"] = t.dt.year, t.dt.month, t.dt.day
            out = out.drop(columns=[c])
    out = out.drop(columns=[c for c in out.columns if out[c].isna().mean() * 100 > max_missing])
    for c in out.columns:
        if out[c].dtype != object and out[c].isna().any():
            out[c] = out[c].astype(float).fillna(out[c].median())
    for c in out.columns:
        if out[c].dtype == object and out[c].isna().any():
            m = out[c].mode(dropna=True)
            out[c] = out[c].fillna(m.iloc[0] if len(m) else "missing")
    for c in out.columns:
        if out[c].dtype != object:
            s = out[c].astype(float)
            q1, q3 = s.quantile(0.25), s.quantile(0.75)
            if q3 - q1 != 0:
                clipped = s.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
                if not clipped.equals(s):
                    out[c] = clipped
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_preparation_equals_pandas_rules(spark, seed):
    rows = _table(seed)
    cols = ["num_text", "date_text", "cat", "amount", "k", "sparse"]
    df = spark.createDataFrame(rows, "num_text string, date_text string, cat string, amount double, k long, sparse string")
    out, rep = apply_preparation(df, drop_duplicates=True, coerce_numeric=True, numeric_threshold=0.9,
                                 expand_dates=True, datetime_threshold=0.9, max_missing_pct=40.0,
                                 impute_numeric=True, impute_categorical=True, clip_outliers=True)
    ref = _pandas_prep(pd.DataFrame(rows, columns=cols))
    got = out.toPandas()
    assert list(got.columns) == list(ref.columns)
    key = list(ref.columns)
    g = got.astype({c: float for c in key if ref[c].dtype != object}).sort_values(key).reset_index(drop=True)
    r = ref.astype({c: float for c in key if ref[c].dtype != object}).sort_values(key).reset_index(drop=True)
    assert len(g) == len(r) == rep["final_rows"]
    for c in key:
        if r[c].dtype == object:
            assert list(g[c]) == list(r[c]), c
        else:
            assert np.allclose(g[c].to_numpy(float), r[c].to_numpy(float), rtol=1e-12, atol=1e-12), c


@pytest.mark.parametrize("seed", [3, 4])
def test_audit_equals_pandas_rules(spark, seed):
    from tablewright.operators.audit import audit_dataset
    rows = _table(seed)
    cols = ["num_text", "date_text", "cat", "amount", "k", "sparse"]
    pdf = pd.DataFrame(rows, columns=cols)
    df = spark.createDataFrame(rows, "num_text string, date_text string, cat string, amount double, k long, sparse string")
    a = audit_dataset(df)
    miss = {r["column"]: (r["missing_count"], r["missing_pct"]) for r in a["missing"].collect()}
    ref_miss = {c: (int(pdf[c].isna().sum()), round(float(pdf[c].isna().mean()) * 100, 2)) for c in cols
                if pdf[c].isna().sum() > 0}
    assert miss == ref_miss
    co = {r["column"]: (r["numeric_parse_pct"], r["datetime_parse_pct"]) for r in a["coercion_candidates"].collect()}
    for c in ["num_text", "date_text", "cat", "sparse"]:
        s = pdf[c].dropna()
        num = round(float(pd.to_numeric(s, errors="coerce").notna().mean()) * 100, 2)
        dat = round(float(pd.to_datetime(s, errors="coerce", format="%Y-%m-%d").notna().mean()) * 100, 2)
        assert co[c] == (num, dat), c
    out = {r["column"]: (r["outliers"], r["outlier_pct"]) for r in a["outliers"].collect()}
    for c in ["amount", "k"]:
        s = pdf[c].dropna().astype(float)
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        n_out = 0 if q3 == q1 else int(((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum())
        assert out[c] == (n_out, round(n_out / len(s) * 100, 2)), c
