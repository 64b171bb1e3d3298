import datetime as dt
import tempfile

from tablewright.plans.prep import PrepOptions, fit_preparation
from tablewright.sources.catalog import Catalog, slugify
from tablewright.sources.csv import read_csv, unique_names
from tablewright.streaming.apply import prepare_stream
from tests.conftest import SF0001


def test_slug_and_unique_names():
    assert slugify("  My Data (v2).csv ") == "my-data-v2-csv"
    assert slugify("***") == "dataset"
    assert unique_names(["a", "b", "a", "a"]) == ["a", "b", "a.1", "a.2"]


def test_csv_tokens_and_duplicate_headers(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("a,b,a\n1,NA,x\n2,null,\n3,4,None\n")
    df = read_csv(spark, str(p))
    assert df.columns == ["a", "b", "a.1"]
    rows = df.orderBy("a").collect()
    assert rows[0]["b"] is None and rows[1]["b"] is None and rows[2]["a.1"] is None


def test_catalog_round_trip(spark):
    cat = Catalog(spark, tempfile.mkdtemp(prefix="tw-cat-"))
    df = spark.range(10).withColumnRenamed("id", "k")
    i1 = cat.save_dataset(df, "first.csv", now=dt.datetime(2024, 1, 1))
    i2 = cat.save_dataset(df, "second.csv", now=dt.datetime(2024, 1, 2))
    assert [r["id"] for r in cat.list_datasets().collect()] == [i2, i1]
    assert cat.load_dataset(i1).count() == 10
    cat.delete_dataset(i1, now=dt.datetime(2024, 1, 3))
    assert [r["id"] for r in cat.list_datasets().collect()] == [i2]
    try:
        cat.load_dataset(i1)
        raise AssertionError("expected FileNotFoundError")
    except FileNotFoundError:
        pass


def test_prepare_stream(spark):
    from tablewright.sources.tables import dirty_orders
    d = dirty_orders(spark, SF0001)
    plan = fit_preparation(d, PrepOptions())
    stream = spark.readStream.schema(d.schema).parquet(_write(spark, d))
    q = prepare_stream(plan, stream).writeStream.format("memory").queryName("prep_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM prep_out")
    assert got.count() == d.count()
    assert set(got.columns) == set(plan.transform(d).columns)


def _write(spark, df):
    path = tempfile.mkdtemp(prefix="tw-stream-") + "/in"
    df.write.parquet(path)
    return path


def test_csv_short_rows_padded_long_rows_fail(spark, tmp_path):
    import pytest
    p = tmp_path / "short.csv"
    p.write_text("a,b,c\n1,2,3\n4,5\n")
    rows = read_csv(spark, str(p)).orderBy("a").collect()
    assert rows[1]["c"] is None
    q = tmp_path / "long.csv"
    q.write_text("a,b,c\n1,2,3\n4,5,6,7\n")
    with pytest.raises(ValueError):
        read_csv(spark, str(q))


def test_save_uploaded_csv(spark, tmp_path):
    p = tmp_path / "My Upload.csv"
    p.write_text("a,b\n1,x\n2,NA\n")
    cat = Catalog(spark, tempfile.mkdtemp(prefix="tw-cat-"))
    ds = cat.save_uploaded_csv(str(p))
    assert ds.startswith("my-upload-") and len(ds) == len("my-upload-") + 8
    r = cat.get_dataset(ds).collect()[0]
    assert (r["name"], r["rows"], r["cols"]) == ("My Upload", 2, 2)


def test_prepare_stream_with_event_time_dedupe(spark):
    from tablewright.sources.tables import table
    ev = table(spark, SF0001, "events")
    plan = fit_preparation(ev, PrepOptions())
    path = _write(spark, ev.unionByName(ev.limit(20)))  # 20 exact copies in the stream
    stream = spark.readStream.schema(ev.schema).parquet(path)
    q = (prepare_stream(plan, stream, event_time="ts", delay="3650 days")
         .writeStream.format("memory").queryName("prep_events").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM prep_events").count() == ev.count()


def test_csv_types_quotes_and_line_breaks(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('id,x,flag,note,when,none,x\n1,1.5,True,"say ""hi"" now",2024-01-01 10:00:00,NA,a\n2,NA,false,"two\nlines",NA,,b\n3000000000,2.5,NA,"a, b",2024-02-01 00:00:00,,NA\n')
    df = read_csv(spark, str(p), typed_dates=True)
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "flag": "boolean", "note": "string", "when": "timestamp", "none": "double", "x.1": "string"}
    assert dict(read_csv(spark, str(p)).dtypes)["when"] == "string"
    rows = df.orderBy("id").collect()
    assert [r["note"] for r in rows] == ['say "hi" now', "two\nlines", "a, b"]
    assert [r["x"] for r in rows] == [1.5, None, 2.5] and [r["flag"] for r in rows] == [True, False, None]


def test_nan_is_missing(spark):
    from tablewright.operators.audit import audit_missing
    from tablewright.operators.profile import dataset_kpis
    from tablewright.plans.prep import PrepOptions, fit_preparation
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3), (5.0, 4)], "v double, k int")
    assert [tuple(r)[:2] for r in audit_missing(df).collect()] == [("v", 2)]
    assert dataset_kpis(df).first()["missing"] == 2
    plan = fit_preparation(df, PrepOptions())
    assert sorted(r["v"] for r in plan.transform(df).collect()) == [1.0, 3.0, 3.0, 5.0]


def test_timestamp_layouts(spark):
    from pyspark.sql import functions as F
    from tablewright.functions.parse import parse_ts
    want = {"2024-01-01T10:00:00Z": "2024-01-01 10:00:00", "2024-01-01T10:00:00+02:00": "2024-01-01 08:00:00", "2024-01-01T10:00:00.123": "2024-01-01 10:00:00.123",
            "1/2/2024 10:30": "2024-01-02 10:30:00", "2024-1-5": "2024-01-05 00:00:00", "13/2/2024": "2024-02-13 00:00:00", "Jan 5, 2024": "2024-01-05 00:00:00",
            "5 march 2024": "2024-03-05 00:00:00", "20240105": "2024-01-05 00:00:00", "2024": "2024-01-01 00:00:00", "2024-03": "2024-03-01 00:00:00",
            "10:30": None, "now": None, "12": None, "2024-13-45": None, "Foo 5 2024": None}
    df = spark.createDataFrame([(k,) for k in want], "s string")
    got = {r["s"]: r["t"] for r in df.select("s", F.date_format(parse_ts(F.col("s")), "yyyy-MM-dd HH:mm:ss.SSS").alias("t")).collect()}
    assert {k: v and v.removesuffix(".000") for k, v in got.items()} == want


def test_csv_long_integers(spark, tmp_path):
    """Ids of 19 digits stay apart; longer ones are decimals, not doubles."""
    p = tmp_path / "ids.csv"
    ids = [1234567890123456789 - i for i in range(3)]
    p.write_text("id,wide,least,mixed\n" + "".join(f"{i},{i}00000,{-2**63 + k},{i if k else 0.5}\n" for k, i in enumerate(ids)))
    df = read_csv(spark, str(p))
    assert dict(df.dtypes) == {"id": "bigint", "wide": "decimal(38,0)", "least": "bigint", "mixed": "double"}
    assert sorted(r["id"] for r in df.collect()) == sorted(ids) and sorted(int(r["wide"]) for r in df.collect()) == sorted(i * 100000 for i in ids)


def test_csv_dates_are_prepared(spark, tmp_path):
    """ISO dates of a CSV are seen by the audit and expanded by the preparation."""
    from tablewright.operators.audit import audit_dataset
    p = tmp_path / "dates.csv"
    p.write_text("day,v\n" + "".join(f"2024-0{1 + i % 9}-1{i % 10},{i}\n" for i in range(30)))
    df = read_csv(spark, str(p))
    assert [r["column"] for r in audit_dataset(df)["coercion_candidates"].collect()] == ["day"]
    plan = fit_preparation(df, PrepOptions())
    assert plan.report["date_columns_expanded"] == ["day"] and plan.transform(df).columns == ["v", "day_year", "day_month", "day_day"]


def test_csv_quoted_line_breaks_over_splits(spark, tmp_path):
    """Many splits, records across their ends (one longer than several splits),
    stray quotes, CRLF, blank lines and a header with a line break: the rows of
    Spark's reader that takes a file as one task."""
    import random
    rng = random.Random(7)
    quote = lambda t: '"' + t.replace('"', '""') + '"'
    for k, end in enumerate(("\n", "\r\n")):
        folder = tmp_path / f"f{k}"
        folder.mkdir()
        for part in range(3):
            rows = [f'id,"first{end}note",plain']
            for i in range(1500):
                words = " ".join(rng.choice(["x", "it's", 'a "b" c', ",", "\n", "\n\n", '"', "é"]) for _ in range(rng.randrange(12)))
                note = "long\n" * 30000 if (part, i) == (1, 700) else words.strip()
                plain = rng.choice(["5 inch", 'six" pipe', "", "NA", "tail"])
                rows.append(f"{part * 10000 + i},{quote(note) if note else ''},{plain}")
                if i % 97 == 0:
                    rows.append("")
            (folder / f"p{part}.csv").write_text(end.join(rows) + (end if part else ""), newline="")
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        try:
            df = read_csv(spark, str(folder))
            got = sorted(map(tuple, df.collect()))
            assert df.columns == ["id", f"first{end}note", "plain"]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        one = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("lineSep", "\n" if k == 0 else "\r\n").csv(str(folder))
        want = sorted((int(r[0]), r[1], None if r[2] in (None, "NA") else r[2]) for r in one.collect())
        assert len(got) == 4500 and [(a, b, c) for a, b, c in got] == [(a, b, c) for a, b, c in want]
