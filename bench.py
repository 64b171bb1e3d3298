"""Benchmark: headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS]; prints one JSON line.

Each query is forced to completion with a no-op write (the whole plan runs,
nothing is collected); operators that finish with a small driver-side result
run their jobs inside the call.  The first group mirrors the planning probes of
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tablewright import get_spark  # noqa: E402
from tablewright.operators import corr as C  # noqa: E402
from tablewright.operators import stats as S  # noqa: E402
from tablewright.queries import all_queries  # noqa: E402
from tablewright.sources.tables import table  # noqa: E402

LINE8 = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE11 = LINE8 + ["l_returnflag", "l_linestatus", "l_shipdate"]


def probes():
    return {
        "probe_exact_quantile_2x8": lambda spark, sf: S.quantile_table(table(spark, sf, "lineitem"), LINE8, [0.25, 0.75]),
        "probe_pearson_28_pairs": lambda spark, sf: C.pearson_matrix(table(spark, sf, "lineitem"), LINE8),
        "probe_nunique_11": lambda spark, sf: S.nunique(table(spark, sf, "lineitem"), LINE11),
        "probe_duplicate_count": lambda spark, sf: spark.createDataFrame(
            [(S.duplicate_count(table(spark, sf, "lineitem")),)], "d long"),
        "probe_forest_300_depth10": _forest,
    }


def _forest(spark, sf):
    """300 trees, depth 10, three features (the baseline probe used 200 rows;
    this fits every customer row)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    from tablewright.ml.models import TREE_OPTS
    c = table(spark, sf, "customer")
    d = VectorAssembler(inputCols=["c_custkey", "c_nationkey", "c_acctbal"], outputCol="features") \
        .transform(c).withColumn("label", F.col("c_acctbal") * 0.5 + F.col("c_nationkey"))
    m = RandomForestRegressor(numTrees=300, maxDepth=10, seed=42, **TREE_OPTS).fit(d)
    return spark.createDataFrame([(m.getNumTrees,)], "trees int")


HEADLINE = [
    "audit_missing", "audit_coercion", "audit_outliers", "prep_clip_iqr", "prep_report", "dataset_kpis",
    "quantile", "skew", "corr_pearson", "corr_spearman", "corr_kendall", "eda_quality", "eda_histograms",
    "eda_boxplot", "eda_categories", "eda_corr", "eda_target_scatter", "eda_profile", "value_counts",
    "eval_report", "eval_bands", "eval_confusion", "cv_mean", "ml_preprocess", "ml_split", "ml_linreg",
    "ml_ridge", "ml_lasso", "src_csv", "ml_leaderboard",
    "ml_compare_classifiers",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = get_spark(f"local[{cpus}]", int(cpus))
    qs = all_queries()
    todo = {**probes(), **{k: qs[k] for k in HEADLINE}}
    if only:
        todo = {k: v for k, v in todo.items() if k in only}
    # warm up the JVM, code generation and the parquet reader once (not timed)
    table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)), F.avg("l_quantity")) \
        .write.format("noop").mode("overwrite").save()
    times = {}
    for name, fn in todo.items():
        t0 = time.time()
        fn(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_headline_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
