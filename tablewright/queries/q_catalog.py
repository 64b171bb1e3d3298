"""Sources and sinks: CSV round trip, dataset catalog, artifacts, EDA tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tablewright.plans.eda_select import run_eda
from tablewright.plans.prep import apply_preparation
from tablewright.queries import register
from tablewright.queries.q_ml import _PREDICT_ALL, R, _cmp_sql, _documents, comparison
from tablewright.session import checkpoint_dir
from tablewright.sources.catalog import Catalog
from tablewright.sources.csv import read_csv, write_csv
from tablewright.sources.tables import table

_T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _scratch(spark, what):
    return f"{checkpoint_dir(spark).rstrip('/')}/tw-{what}-{uuid.uuid4().hex[:8]}"


@register("src_csv", "SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, "
                     "o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') AS o_orderdate, o_orderpriority FROM orders")
def src_csv(spark, sf):
    path = _scratch(spark, "csv")
    write_csv(table(spark, sf, "orders"), path)
    return read_csv(spark, path)


@register("src_csv_messy", "SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_totalprice END AS price, "
                           "CASE WHEN o_orderkey % 3 = 0 THEN 'say \"' || o_orderpriority || '\", twice' WHEN o_orderkey % 3 = 1 THEN 'two' || chr(10) || 'lines' END AS note FROM orders")
def src_csv_messy(spark, sf):
    """Nulls as NA, doubled quotes, commas and line breaks in text; types are
    inferred all the same."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    note = F.when(k == 0, F.concat(F.lit('say "'), "o_orderpriority", F.lit('", twice'))).when(k == 1, F.lit("two\nlines"))
    path = _scratch(spark, "csv")
    write_csv(o.select("o_orderkey", F.when(F.col("o_orderkey") % 20 == 0, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
                       F.coalesce(note, F.lit("NULL")).alias("note")), path)
    return read_csv(spark, path)


@register("src_csv_prepared", """
WITH b AS (SELECT 1234567890123000000 + o_orderkey AS id, CASE WHEN o_orderkey % 20 <> 0 THEN o_totalprice END AS price,
                  CASE WHEN o_orderkey % 3 = 1 THEN 'two' || chr(10) || '"lines"' ELSE o_orderpriority END AS note,
                  CASE WHEN o_orderkey % 25 <> 0 THEN o_orderdate END AS d FROM orders),
m AS (SELECT median(price) AS p, median(year(d)) AS y, median(month(d)) AS mo, median(day(d)) AS dd FROM b)
SELECT id, coalesce(price, p) AS price, note, CAST(coalesce(year(d), y) AS DOUBLE) AS day_year, CAST(coalesce(month(d), mo) AS DOUBLE) AS day_month,
       CAST(coalesce(day(d), dd) AS DOUBLE) AS day_day FROM b, m""")
def src_csv_prepared(spark, sf):
    """A CSV with ids of 19 digits, missing values, ISO dates and quoted line
    breaks, read and prepared with the default options."""
    o = table(spark, sf, "orders")
    path = _scratch(spark, "csv")
    write_csv(o.select((F.lit(1234567890123000000) + F.col("o_orderkey")).alias("id"),
                       F.when(F.col("o_orderkey") % 20 == 0, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
                       F.when(F.col("o_orderkey") % 3 == 1, F.lit('two\n"lines"')).otherwise(F.col("o_orderpriority")).alias("note"),
                       F.when(F.col("o_orderkey") % 25 == 0, "NULL").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day")), path)
    return apply_preparation(read_csv(spark, path))[0]


def _catalog_with_orders(spark, sf):
    cat = Catalog(spark, _scratch(spark, "catalog"))
    o = table(spark, sf, "orders")
    cat.save_dataset(o, "orders.csv", dataset_id="orders-00000001", now=_T0)
    cat.save_dataset(table(spark, sf, "customer"), "customer.csv", dataset_id="customer-00000002",
                     now=_T0 + dt.timedelta(hours=1))
    return cat


@register("save_dataset", "SELECT 'orders-00000001' AS id, 'orders' AS name, count(*) AS rows, 6 AS cols FROM orders "
                          "UNION ALL SELECT 'customer-00000002', 'customer', count(*), 5 FROM customer")
def save_dataset(spark, sf):
    return _catalog_with_orders(spark, sf).list_datasets().select("id", "name", "rows", "cols")


@register("load_dataset", "SELECT * FROM orders")
def load_dataset(spark, sf):
    return _catalog_with_orders(spark, sf).load_dataset("orders-00000001")


@register("list_datasets", "SELECT 'customer-00000002' AS id, 'customer' AS name, count(*) AS rows, 5 AS cols, "
                           "TIMESTAMP '2024-01-01 01:00:00' AS created_at FROM customer UNION ALL "
                           "SELECT 'orders-00000001', 'orders', count(*), 6, TIMESTAMP '2024-01-01 00:00:00' FROM orders")
def list_datasets(spark, sf):
    return _catalog_with_orders(spark, sf).list_datasets().select("id", "name", "rows", "cols", "created_at")


@register("get_dataset", "SELECT 'orders-00000001' AS id, 'orders' AS name, count(*) AS rows, 6 AS cols FROM orders")
def get_dataset(spark, sf):
    return _catalog_with_orders(spark, sf).get_dataset("orders-00000001").select("id", "name", "rows", "cols")


@register("delete_dataset", "SELECT 'customer-00000002' AS id, 'customer' AS name, count(*) AS rows, 5 AS cols FROM customer")
def delete_dataset(spark, sf):
    cat = _catalog_with_orders(spark, sf)
    cat.delete_dataset("orders-00000001", now=_T0 + dt.timedelta(hours=2))
    return cat.list_datasets().select("id", "name", "rows", "cols")


@register("dataset_listing", "SELECT 'orders-00000001' AS id, 'orders' AS name, format('{} x {}', count(*), 6) AS shape FROM orders "
                             "UNION ALL SELECT 'customer-00000002', 'customer', format('{} x {}', count(*), 5) FROM customer")
def dataset_listing(spark, sf):
    return _catalog_with_orders(spark, sf).dataset_listing().select("id", "name", "shape")


_QUALITY_ORDERS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
    f"count(DISTINCT {c}) AS \"unique\" FROM orders"
    for c, t in [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                 ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")])


@register("sink_eda", _QUALITY_ORDERS)
def sink_eda(spark, sf):
    cat = Catalog(spark, _scratch(spark, "reports"))
    o = table(spark, sf, "orders")
    tables = run_eda(o, "o_totalprice", ["Data Quality Summary", "Missingness", "Numeric Distributions"],
                     {"order_by": ["o_orderkey"], "report": True})
    paths = cat.persist_eda(tables, "orders-00000001")
    return spark.read.parquet(paths["Data Quality Summary"])


@register("sink_artifacts", _cmp_sql() + _PREDICT_ALL)
def sink_artifacts(spark, sf):
    """The written winner, loaded again, predicts every document."""
    from pyspark.ml import PipelineModel
    a = comparison(spark, sf)
    cat = Catalog(spark, _scratch(spark, "artifacts"))
    paths = cat.persist_training_artifacts(a, "docs-00000001")
    missing = cat.missing_artifacts("docs-00000001")
    if missing:
        raise RuntimeError(f"artifacts missing: {missing}")
    reloaded = PipelineModel.load(paths["model"])
    return reloaded.transform(_documents(spark, sf).drop("n_chars")).select("doc_id", F.round("predicted", R).alias("predicted"))
