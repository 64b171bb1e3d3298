"""Hold-out evaluation tables, all from aggregates of (label, prediction).

Classification metrics are derived from the (label, prediction) count table
only -- at most classes^2 rows however large the test set is.  Regression
metrics are one aggregate pass.  Support-weighted precision / recall / F1 and
the per-class report follow the usual definitions with zero_division = 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.eda import histograms
from tablewright.operators.ranks import running_weight
from tablewright.operators.stats import quantiles
from tablewright.schema import as_double, q


def _z(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def pair_counts(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """(by..., label, prediction, n) with both sides as text."""
    by = list(by or [])
    return (df.select(*[F.col(q(b)) for b in by],
                      F.col(q(label)).cast("string").alias("label"),
                      F.col(q(prediction)).cast("string").alias("prediction"))
              .groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n")))


def per_class(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., class, tp, support, predicted, precision, recall, f1) over the
    union of true and predicted labels (per group)."""
    by = list(by or [])
    tp = counts.filter(F.col("label") == F.col("prediction")).groupBy(*by, F.col("label").alias("class")) \
        .agg(F.sum("n").alias("tp"))
    sup = counts.groupBy(*by, F.col("label").alias("class")).agg(F.sum("n").alias("support"))
    prd = counts.groupBy(*by, F.col("prediction").alias("class")).agg(F.sum("n").alias("predicted"))
    cls = sup.select(*by, "class").union(prd.select(*by, "class")).distinct()
    keys = [*by, "class"]
    t = (cls.join(tp, keys, "left").join(sup, keys, "left").join(prd, keys, "left")
            .select(*keys, _z(F.col("tp")).alias("tp"), _z(F.col("support")).alias("support"),
                    _z(F.col("predicted")).alias("predicted")))
    p = _z(F.try_divide(F.col("tp"), F.col("predicted")))
    r = _z(F.try_divide(F.col("tp"), F.col("support")))
    t = t.withColumn("precision", p).withColumn("recall", r)
    f1 = _z(F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return t.withColumn("f1", f1)


def classification_metrics(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """One row (per group): accuracy, precision_weighted, recall_weighted, f1_weighted."""
    by = list(by or [])
    pc = per_class(pair_counts(df, label, prediction, by), by)
    tot = F.sum("support")
    return pc.groupBy(*by).agg((F.sum("tp") / tot).alias("accuracy"),
                               (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision_weighted"),
                               (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall_weighted"),
                               (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1_weighted"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(row, precision, recall, f1, support): one row per class, then
    accuracy, macro avg and weighted avg rows."""
    pc = per_class(pair_counts(df, label, prediction))
    classes = pc.select(F.col("class").alias("row"), "precision", "recall", "f1",
                        F.col("support").cast("long").alias("support"))
    tot = F.sum("support")
    acc = pc.agg(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), (F.sum("tp") / tot).alias("f1"),
                 tot.cast("long").alias("support"))
    macro = pc.agg(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.cast("long").alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("row"),
                      (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.cast("long").alias("support"))
    return classes.unionByName(acc).unionByName(macro).unionByName(weighted)


def sorted_labels(df: DataFrame, label: str) -> DataFrame:
    """(position, label): distinct true labels as text, sorted; numbered in
    range slices, however many there are."""
    lab = df.select(F.col(q(label)).cast("string").alias("label")).distinct().withColumn("_g", F.lit(0))
    return running_weight(lab, ["_g"], ["label"]).select((F.col("_below") + 1).cast("long").alias("position"), "label")


#: Classes of a confusion matrix: its grid has as many squared.
MAX_CONFUSION_CLASSES = 1000


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(actual, predicted, count) over sorted true labels x true labels, zeros
    included; predictions outside the true labels are not counted.  More than
    MAX_CONFUSION_CLASSES labels are an error: ``pair_counts`` has their counts
    without the grid."""
    counts = pair_counts(df, label, prediction)
    distinct = df.select(F.col(q(label)).cast("string").alias("l")).distinct()
    known = [r["l"] for r in distinct.limit(MAX_CONFUSION_CLASSES + 1).collect()]
    if len(known) > MAX_CONFUSION_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CONFUSION_CLASSES} classes; a confusion matrix is a grid of all pairs")
    labels = df.sparkSession.createDataFrame([(sorted(x for x in known if x is not None),)], "ls array<string>")
    grid = (labels.select(F.explode("ls").alias("actual"), "ls")
                  .select("actual", F.explode("ls").alias("predicted")))
    return (grid.join(counts, (grid.actual == counts.label) & (grid.predicted == counts.prediction), "left")
                .select("actual", "predicted", _z(F.col("n")).cast("long").alias("count")))


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """One row (per group): r2, rmse, mae (r2 of a constant actual: 1 if
    exact else 0)."""
    by = list(by or [])
    y, p = as_double(df, actual), as_double(df, predicted)
    e = y - p
    one = df.groupBy(*[F.col(q(b)) for b in by]).agg(
        F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"),
        F.count(y).alias("n"), F.avg(F.abs(e)).alias("mae"))
    r2 = (F.when(F.col("sst") == 0, F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
           .otherwise(F.lit(1.0) - F.col("sse") / F.col("sst")))
    return one.select(*by, r2.alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae")


def min_max(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Common axis range of actual and predicted."""
    a, p = as_double(df, actual), as_double(df, predicted)
    return df.agg(F.least(F.min(a), F.min(p)).alias("min_val"), F.greatest(F.max(a), F.max(p)).alias("max_val"))


def residual_hist(df: DataFrame, actual: str, predicted: str, bins: int = 30) -> DataFrame:
    res = df.select((as_double(df, actual) - as_double(df, predicted)).alias("residual"))
    return histograms(res, ["residual"], bins).drop("column")


def qcut_bands(df: DataFrame, col: str, quarters: int = 4) -> tuple[DataFrame, list[float]]:
    """Quantile bands of ``col``: right-closed, lowest value included, repeated
    edges dropped; fewer than two edges -> no band.  Adds band, band_lo, band_hi."""
    probs = [i / quarters for i in range(quarters + 1)]
    qs = quantiles(df, [col], probs).get(col, {})
    edges = sorted(set(qs[p] for p in probs if qs.get(p) is not None))
    v = as_double(df, col)
    if len(edges) < 2:
        return (df.withColumn("band", F.lit(None).cast("int")).withColumn("band_lo", F.lit(None).cast("double"))
                  .withColumn("band_hi", F.lit(None).cast("double"))), edges
    band = None
    for i in range(len(edges) - 2, -1, -1):
        cond = v <= F.lit(edges[i + 1])
        band = F.when(cond, F.lit(i)) if band is None else F.when(cond, F.lit(i)).otherwise(band)
    band = F.when(v.isNotNull() & (v >= F.lit(edges[0])) & (v <= F.lit(edges[-1])), band)
    lo = F.element_at(F.array(*[F.lit(e) for e in edges]), band + 1)
    hi = F.element_at(F.array(*[F.lit(e) for e in edges]), band + 2)
    return df.withColumn("band", band).withColumn("band_lo", lo).withColumn("band_hi", hi), edges


def error_bands(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(band, band_lo, band_hi, rows, mean_actual, mean_predicted, mean_abs_error)
    per quartile band of the actual value; empty bands kept."""
    banded, edges = qcut_bands(df.select(as_double(df, actual).alias("actual"),
                                         as_double(df, predicted).alias("pred")), "actual", 4)
    spark = df.sparkSession
    agg = (banded.filter("band IS NOT NULL").groupBy("band")
                 .agg(F.count(F.lit(1)).alias("rows"), F.avg("actual").alias("mean_actual"),
                      F.avg("pred").alias("mean_predicted"),
                      F.avg(F.abs(F.col("actual") - F.col("pred"))).alias("mean_abs_error")))
    all_bands = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(len(edges) - 1)],
                                      "band int, band_lo double, band_hi double")
    return (all_bands.join(agg, "band", "left")
                     .select("band", "band_lo", "band_hi", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
                             "mean_actual", "mean_predicted", "mean_abs_error"))
