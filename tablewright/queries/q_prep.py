"""Preparation steps over ``dirty_orders``: each query applies the plan up to
one step; the oracle is a CTE chain with one CTE per step."""

from __future__ import annotations

from tablewright.operators.audit import audit_dataset
from tablewright.plans.prep import PrepOptions, apply_preparation, fit_preparation, preparation_notes
from tablewright.queries import register
from tablewright.queries.sqlhelp import parse_date_sql, parse_num_sql, with_dirty
from tablewright.sources.tables import dirty_orders

OFF = dict(drop_duplicates=False, coerce_numeric=False, expand_dates=False, max_missing_pct=0.0,
           impute_numeric=False, impute_categorical=False, clip_outliers=False)
STEPS = ["drop_duplicates", "coerce_numeric", "expand_dates", "max_missing_pct",
         "impute_numeric", "impute_categorical", "clip_outliers"]


def options_upto(step: str) -> PrepOptions:
    kw = dict(OFF)
    for s in STEPS[:STEPS.index(step) + 1]:
        kw[s] = 50.0 if s == "max_missing_pct" else True
    return PrepOptions(**kw)


def _prepared(spark, sf, step):
    d = dirty_orders(spark, sf)
    out, _ = apply_preparation(d, **options_upto(step).__dict__)
    return out


# --- oracle CTE chain ---------------------------------------------------------
_PART = {"year": "year", "month": "month", "day": "day"}
CHAIN = [
    "d1 AS (SELECT DISTINCT * FROM dirty_orders)",
    f"d2 AS (SELECT o_orderkey, {parse_num_sql('num_text')} AS num_text, date_text, category, amount, sparse, flag FROM d1)",
    "d3 AS (SELECT o_orderkey, num_text, category, amount, sparse, flag, "
    "CAST(year(ts) AS DOUBLE) AS date_text_year, CAST(month(ts) AS DOUBLE) AS date_text_month, "
    f"CAST(day(ts) AS DOUBLE) AS date_text_day FROM (SELECT *, {parse_date_sql('date_text')} AS ts FROM d2))",
    "d4 AS (SELECT * EXCLUDE (sparse) FROM d3)",
    "med AS (SELECT median(num_text) AS m_num, median(amount) AS m_amt, median(date_text_year) AS m_y, "
    "median(date_text_month) AS m_m, median(date_text_day) AS m_d FROM d4)",
    "d5 AS (SELECT o_orderkey, CAST(COALESCE(num_text, m_num) AS DOUBLE) AS num_text, category, "
    "CAST(COALESCE(amount, m_amt) AS DOUBLE) AS amount, flag, "
    "CAST(COALESCE(date_text_year, m_y) AS DOUBLE) AS date_text_year, "
    "CAST(COALESCE(date_text_month, m_m) AS DOUBLE) AS date_text_month, "
    "CAST(COALESCE(date_text_day, m_d) AS DOUBLE) AS date_text_day FROM d4, med)",
    "mode_cat AS (SELECT category AS m_cat FROM d5 WHERE category IS NOT NULL GROUP BY category "
    "ORDER BY count(*) DESC, category LIMIT 1)",
    "d6 AS (SELECT * REPLACE (COALESCE(category, (SELECT m_cat FROM mode_cat)) AS category) FROM d5)",
]
_CLIP_COLS = ["o_orderkey", "num_text", "amount", "date_text_year", "date_text_month", "date_text_day"]
CHAIN += [
    "qq AS (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in _CLIP_COLS) + " FROM d6)",
    "d7 AS (SELECT * REPLACE (" + ", ".join(
        f"CASE WHEN q3_{c} = q1_{c} THEN {c} ELSE "
        f"{'CAST(' if c == 'o_orderkey' else ''}LEAST(GREATEST({c}, q1_{c} - 1.5 * (q3_{c} - q1_{c})), "
        f"q3_{c} + 1.5 * (q3_{c} - q1_{c})){' AS BIGINT)' if c == 'o_orderkey' else ''} END AS {c}"
        for c in _CLIP_COLS) + ") FROM (SELECT d6.*, qq.* FROM d6, qq))",
]
_FINAL_COLS = "o_orderkey, num_text, category, amount, flag, date_text_year, date_text_month, date_text_day"


def _chain_sql(upto: int, select: str) -> str:
    return with_dirty(*CHAIN[:upto]) + select


@register("prep_dedupe", _chain_sql(1, "SELECT * FROM d1"))
def prep_dedupe(spark, sf):
    return _prepared(spark, sf, "drop_duplicates")


@register("drop_duplicates", _chain_sql(1, "SELECT * FROM d1"))
def drop_duplicates(spark, sf):
    return dirty_orders(spark, sf).dropDuplicates()


@register("prep_coerce_numeric", _chain_sql(2, "SELECT * FROM d2"))
def prep_coerce_numeric(spark, sf):
    return _prepared(spark, sf, "coerce_numeric")


@register("prep_expand_dates", _chain_sql(3, "SELECT * FROM d3"))
def prep_expand_dates(spark, sf):
    return _prepared(spark, sf, "expand_dates")


@register("prep_drop_sparse", _chain_sql(4, "SELECT * FROM d4"))
def prep_drop_sparse(spark, sf):
    return _prepared(spark, sf, "max_missing_pct")


@register("prep_impute_numeric", _chain_sql(6, "SELECT * FROM d5"))
def prep_impute_numeric(spark, sf):
    return _prepared(spark, sf, "impute_numeric")


@register("prep_impute_categorical", _chain_sql(8, "SELECT * FROM d6"))
def prep_impute_categorical(spark, sf):
    return _prepared(spark, sf, "impute_categorical")


@register("prep_clip_iqr", _chain_sql(10, f"SELECT {_FINAL_COLS} FROM d7"))
def prep_clip_iqr(spark, sf):
    return _prepared(spark, sf, "clip_outliers")


# report: counts from SQL; each list is the columns a rule selects, in column order
_RATIO = ("ratios AS (SELECT * FROM (VALUES (1, 'num_text'), (2, 'date_text'), (3, 'category'), (4, 'sparse')) t(pos, c)), "
          "r AS (SELECT " + ", ".join(
              f"count({c}) AS n_{c}, count({parse_num_sql(c)}) AS p_{c}, count({parse_date_sql(c)}) AS t_{c}"
              for c in ["num_text", "date_text", "category", "sparse"]) + " FROM d1)")
_LISTS = {
    "columns_coerced_numeric": "(SELECT string_agg(c, ', ' ORDER BY pos) FROM ratios, r WHERE " +
    " OR ".join(f"(c = '{c}' AND p_{c} >= 0.9 * n_{c} AND n_{c} > 0)" for c in ["num_text", "date_text", "category", "sparse"]) + ")",
    "date_columns_expanded": "(SELECT string_agg(c, ', ' ORDER BY pos) FROM ratios, r WHERE " +
    " OR ".join(f"(c = '{c}' AND p_{c} < 0.9 * n_{c} AND t_{c} >= 0.9 * n_{c} AND n_{c} > 0)"
                for c in ["num_text", "date_text", "category", "sparse"]) + ")",
}
_D3_COLS = ["o_orderkey", "num_text", "category", "amount", "sparse", "flag",
            "date_text_year", "date_text_month", "date_text_day"]
_NULLS_D3 = "nd3 AS (SELECT count(*) AS n, " + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS z_{c}" for c in _D3_COLS) + " FROM d3)"
_LISTS["columns_dropped_for_missing"] = "(SELECT string_agg(c, ', ' ORDER BY pos) FROM (VALUES " + ", ".join(
    f"({i}, '{c}')" for i, c in enumerate(_D3_COLS)) + ") t(pos, c), nd3 WHERE " + " OR ".join(
    f"(c = '{c}' AND z_{c} * 100.0 / n > 50)" for c in _D3_COLS) + ")"
_NUM_D4 = ["o_orderkey", "num_text", "amount", "date_text_year", "date_text_month", "date_text_day"]
_LISTS["numeric_columns_imputed"] = "(SELECT string_agg(c, ', ' ORDER BY pos) FROM (VALUES " + ", ".join(
    f"({i}, '{c}')" for i, c in enumerate(_NUM_D4)) + ") t(pos, c), nd3 WHERE " + " OR ".join(
    f"(c = '{c}' AND z_{c} > 0)" for c in _NUM_D4) + ")"
_LISTS["categorical_columns_imputed"] = ("(SELECT string_agg(c, ', ' ORDER BY pos) FROM (VALUES (1, 'category'), (2, 'flag')) t(pos, c), nd3 "
                                         "WHERE (c = 'category' AND z_category > 0) OR (c = 'flag' AND z_flag > 0))")
_CLIP_ORDER = ["o_orderkey", "num_text", "amount", "date_text_year", "date_text_month", "date_text_day"]
_OUT = "outs AS (SELECT " + ", ".join(
    f"count(*) FILTER (WHERE q3_{c} <> q1_{c} AND ({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}))) AS o_{c}"
    for c in _CLIP_ORDER) + " FROM d6, qq)"
_LISTS["outlier_columns_clipped"] = "(SELECT string_agg(c, ', ' ORDER BY pos) FROM (VALUES " + ", ".join(
    f"({i}, '{c}')" for i, c in enumerate(_CLIP_ORDER)) + ") t(pos, c), outs WHERE " + " OR ".join(
    f"(c = '{c}' AND o_{c} > 0)" for c in _CLIP_ORDER) + ")"

_REPORT_SQL = with_dirty(*CHAIN[:9], _RATIO, _NULLS_D3, _OUT) + (
    "SELECT (SELECT count(*) FROM dirty_orders) AS original_rows, CAST(7 AS BIGINT) AS original_cols, "
    "(SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM d1) AS duplicate_rows_removed, "
    "(SELECT count(*) FROM d1) AS final_rows, CAST(8 AS BIGINT) AS final_cols, " +
    ", ".join(f"COALESCE({v}, '') AS {k}" for k, v in _LISTS.items()))


def _full_plan(spark, sf):
    d = dirty_orders(spark, sf)
    return fit_preparation(d, options_upto("clip_outliers"))


@register("prep_report", _REPORT_SQL)
def prep_report(spark, sf):
    r = _full_plan(spark, sf).report
    cols = ["original_rows", "original_cols", "duplicate_rows_removed", "final_rows", "final_cols"]
    lists = ["columns_coerced_numeric", "date_columns_expanded", "columns_dropped_for_missing",
             "numeric_columns_imputed", "categorical_columns_imputed", "outlier_columns_clipped"]
    row = [int(r[c]) for c in cols] + [", ".join(r[k]) for k in lists]
    schema = ", ".join([f"{c} long" for c in cols] + [f"{k} string" for k in lists])
    return spark.createDataFrame([tuple(row)], schema)


@register("prep_summary", "WITH rep AS (" + _REPORT_SQL + ") " + " UNION ALL ".join([
    "SELECT 'Rows' AS change, CAST(original_rows AS VARCHAR) || ' -> ' || CAST(final_rows AS VARCHAR) AS value FROM rep",
    "SELECT 'Columns', CAST(original_cols AS VARCHAR) || ' -> ' || CAST(final_cols AS VARCHAR) FROM rep",
    "SELECT 'Duplicates removed', CAST(duplicate_rows_removed AS VARCHAR) FROM rep",
    "SELECT 'Numeric coercions', COALESCE(NULLIF(columns_coerced_numeric, ''), '-') FROM rep",
    "SELECT 'Date expansions', COALESCE(NULLIF(date_columns_expanded, ''), '-') FROM rep",
    "SELECT 'Dropped high-missing columns', COALESCE(NULLIF(columns_dropped_for_missing, ''), '-') FROM rep",
    "SELECT 'Numeric imputations', COALESCE(NULLIF(numeric_columns_imputed, ''), '-') FROM rep",
    "SELECT 'Categorical imputations', COALESCE(NULLIF(categorical_columns_imputed, ''), '-') FROM rep",
    "SELECT 'Outlier clipping', COALESCE(NULLIF(outlier_columns_clipped, ''), '-') FROM rep"]))
def prep_summary(spark, sf):
    rows = _full_plan(spark, sf).summary_rows()
    return spark.createDataFrame(rows, "change string, value string")


from tablewright.queries.q_audit import _COERCE_SQL, _MISSING_SQL, _Q_CTE, _outlier_branch  # noqa: E402
from tablewright.queries.sqlhelp import DIRTY_NUMERIC, union_all  # noqa: E402
from tablewright.plans.prep import NOTE_DATES, NOTE_NONE, NOTE_NUMERIC, NOTE_OUTLIERS  # noqa: E402

_OUTLIER_SQL = with_dirty(_Q_CTE) + union_all([_outlier_branch(c) for c in DIRTY_NUMERIC])
_NOTES_SQL = (
    f"WITH m AS ({_MISSING_SQL}), c AS ({_COERCE_SQL}), o AS ({_OUTLIER_SQL}), notes AS ("
    "SELECT 1 AS k, 'Missing data exists. Highest missing column: ' || \"column\" || ' (' || "
    "CAST(missing_pct AS VARCHAR) || '%).' AS note FROM (SELECT m.* FROM m JOIN (VALUES " +
    ", ".join(f"('{c}', {i})" for i, c in enumerate(["o_orderkey", "num_text", "date_text", "category", "amount",
                                                      "sparse", "flag"])) +
    ") pos(c, i) ON m.\"column\" = pos.c WHERE missing_count > 0 "
    "ORDER BY missing_pct DESC, missing_count DESC, pos.i LIMIT 1) "
    f"UNION ALL SELECT 2, '{NOTE_NUMERIC}' WHERE EXISTS (SELECT 1 FROM c WHERE numeric_parse_pct >= 80) "
    f"UNION ALL SELECT 3, '{NOTE_DATES}' WHERE EXISTS (SELECT 1 FROM c WHERE datetime_parse_pct >= 80) "
    f"UNION ALL SELECT 4, '{NOTE_OUTLIERS}' WHERE EXISTS (SELECT 1 FROM o WHERE outlier_pct >= 5)) "
    "SELECT row_number() OVER (ORDER BY k) AS position, note FROM (SELECT * FROM notes UNION ALL "
    f"SELECT 5, '{NOTE_NONE}' WHERE NOT EXISTS (SELECT 1 FROM notes))")


@register("prep_notes", _NOTES_SQL)
def prep_notes(spark, sf):
    return preparation_notes(audit_dataset(dirty_orders(spark, sf)))
