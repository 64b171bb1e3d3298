"""The reference's two literal fixtures, rebuilt, plus properties."""

from pyspark.sql import functions as F

from tablewright.operators.audit import audit_dataset
from tablewright.plans.prep import PrepOptions, apply_preparation, fit_preparation, preparation_notes
from tablewright.sources.tables import dirty_orders
from tests.conftest import SF001


def _audit_df(spark):
    return spark.createDataFrame(
        [("1", "2024-01-01", 1.0), ("2", "2024-02-01", None), ("3", None, 3.0), (None, "2024-03-01", 4.0)],
        "num_text string, dates string, value double")


def test_audit_finds_missing_and_type_candidates(spark):
    a = audit_dataset(_audit_df(spark))
    miss = {r["column"]: (r["missing_count"], r["missing_pct"]) for r in a["missing"].collect()}
    assert miss == {"num_text": (1, 25.0), "dates": (1, 25.0), "value": (1, 25.0)}
    coer = {r["column"]: (r["numeric_parse_pct"], r["datetime_parse_pct"]) for r in a["coercion_candidates"].collect()}
    assert coer["num_text"] == (100.0, 0.0)
    assert coer["dates"] == (0.0, 100.0)
    assert [r["column"] for r in a["outliers"].collect()] == ["value"]


def _prep_df(spark):
    rows = [("10", "2024-01-01", "a", 1), ("20", "2024-02-01", None, 1), (None, None, "b", 2), ("40", "2024-03-05", "b", 2)]
    return spark.createDataFrame(rows + rows[:1], "amount string, event_date string, category string, dup long")


def test_preparation_fixture(spark):
    out, rep = apply_preparation(_prep_df(spark), drop_duplicates=True, coerce_numeric=True, numeric_threshold=0.75,
                                 expand_dates=True, datetime_threshold=0.75, max_missing_pct=0.0,
                                 impute_numeric=True, impute_categorical=True, clip_outliers=False)
    assert rep["duplicate_rows_removed"] == 1
    assert rep["columns_coerced_numeric"] == ["amount"]
    assert rep["date_columns_expanded"] == ["event_date"]
    assert "event_date" not in out.columns and out.columns[-3:] == ["event_date_year", "event_date_month", "event_date_day"]
    rows = sorted(out.collect(), key=lambda r: (r["dup"], r["amount"], r["category"]))
    assert sorted(r["amount"] for r in rows) == [10.0, 20.0, 20.0, 40.0]
    parts = sorted((r["event_date_year"], r["event_date_month"], r["event_date_day"]) for r in rows)
    assert parts == [(2024, 1, 1), (2024, 2, 1), (2024, 2, 1), (2024, 3, 5)]
    assert sorted(r["category"] for r in rows) == ["a", "b", "b", "b"]
    assert out.filter(F.col("amount").isNull() | F.col("category").isNull()).count() == 0
    assert rep["final_rows"] == 4 and rep["original_rows"] == 5


def test_dedupe_idempotent_and_no_nulls_after_impute(spark):
    d = dirty_orders(spark, SF001)
    plan = fit_preparation(d, PrepOptions(clip_outliers=True, max_missing_pct=50.0))
    out = plan.transform(d)
    assert out.count() == out.dropDuplicates().count()
    nulls = out.select([F.count_if(F.col(c).isNull()).alias(c) for c in out.columns]).collect()[0].asDict()
    assert all(v == 0 for v in nulls.values()), nulls
    lo, hi = plan.clip["amount"]
    mm = out.agg(F.min("amount"), F.max("amount")).collect()[0]
    assert lo <= mm[0] and mm[1] <= hi
    # plan holds literals only: applying twice gives the same table
    assert plan.transform(d).exceptAll(out).count() == 0


def test_notes_fallback(spark):
    clean = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "c")], "x double, s string")
    notes = [r["note"] for r in preparation_notes(audit_dataset(clean)).collect()]
    assert len(notes) == 1 and notes[0].startswith("No obvious preparation issues")


def test_wide_table_chunks(spark, monkeypatch):
    import tablewright.operators.audit as A
    monkeypatch.setattr(A, "AGG_CHUNK", 6)
    cols = {f"c{i}": (None if i % 3 == 0 else str(i)) for i in range(20)}
    df = spark.createDataFrame([tuple(cols.values()), tuple(f"{i}" for i in range(20))],
                               ", ".join(f"{c} string" for c in cols))
    m = {r["column"]: r["missing_count"] for r in A.missing_table(df).collect()}
    assert len(m) == 20 and m["c0"] == 1 and m["c1"] == 0
    co = {r["column"]: r["numeric_parse_pct"] for r in A.audit_coercion(df).collect()}
    assert len(co) == 20 and co["c1"] == 100.0


def test_empty_and_all_null_columns(spark):
    empty = spark.createDataFrame([], "a string, b double")
    out, rep = apply_preparation(empty, drop_duplicates=True, coerce_numeric=True, numeric_threshold=0.9,
                                 expand_dates=True, datetime_threshold=0.9, max_missing_pct=10.0,
                                 impute_numeric=True, impute_categorical=True, clip_outliers=True)
    assert out.count() == 0 and rep["final_rows"] == 0
    a = audit_dataset(empty)
    assert a["missing"].count() == 0 and a["outliers"].count() == 0
    df = spark.createDataFrame([(None, 1.0, "x"), (None, 2.0, None), (None, 50.0, "y")], "z double, v double, s string")
    out, rep = apply_preparation(df, drop_duplicates=True, coerce_numeric=True, numeric_threshold=0.9,
                                 expand_dates=True, datetime_threshold=0.9, max_missing_pct=0.0,
                                 impute_numeric=True, impute_categorical=True, clip_outliers=False)
    # an all-null numeric column is reported as imputed but stays null
    assert "z" in rep["numeric_columns_imputed"]
    assert out.filter("z IS NOT NULL").count() == 0
    assert out.filter("s IS NULL").count() == 0


def test_audit_ties_keep_schema_order(spark):
    df = spark.createDataFrame([(None, None, 1.0), ("x", "y", 2.0)], "zeta string, alpha string, v double")
    a = audit_dataset(df)
    assert [r["column"] for r in a["missing"].collect()] == ["zeta", "alpha"]
    note = preparation_notes(a).collect()[0]["note"]
    assert "zeta (50.0%)" in note


def _exchanged(spark, df, monkeypatch):
    """Columns of every exchange in the plans that ``distinct_rows`` writes."""
    from tablewright.operators import stats
    seen, write = [], stats.staged

    def spy(frame, label):
        out = write(frame, label)
        seen.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return out
    monkeypatch.setattr(stats, "staged", spy)
    return stats.distinct_rows(df, "test-distinct"), seen


def test_distinct_by_hash_first(spark, monkeypatch):
    """Equal to a plain distinct; rows are grouped by their columns only where a
    hash repeats; columns may bear the names used inside."""
    rows = [(i % 700, None if i % 7 == 0 else f"t{i % 700}", float("nan") if i % 5 == 0 else float(i % 700), "x" * 50) for i in range(1000)]
    df = spark.createDataFrame(rows + [(1, "hot", 0.0, "y")] * 500 + [(1, "hot", -0.0, "y")] * 3, "_h long, _again string, v double, wide string")
    (got, n, kept), plans = _exchanged(spark, df, monkeypatch)
    want = df.distinct()
    assert got.columns == df.columns and (n, kept) == (1503, want.count()) and got.count() == kept
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # written: repeated hashes, all rows beside them (no grouping), copies grouped by all columns
    hashes, tagged, copies = plans
    assert "Aggregate [_groupingexpression" in hashes and "Aggregate" not in tagged and "Aggregate [_h" in copies


def test_distinct_without_copies_shuffles_no_rows(spark, monkeypatch):
    df = spark.range(500).selectExpr("id", "concat('wide ', id) AS w")
    (got, n, kept), plans = _exchanged(spark, df, monkeypatch)
    assert (n, kept, got.count()) == (500, 500, 500) and len(plans) == 2 and "Aggregate" not in plans[1] and "Join" not in plans[1]
    (got, n, kept), _ = _exchanged(spark, df.limit(0), monkeypatch)
    assert (n, kept, got.collect()) == (0, 0, [])
