"""Train/test split and cross-validation folds, reproducible and distributed.

Rows are ordered inside their class by a seeded hash of a key (or by a
caller-given expression), then

* test = ceil(0.2 * n) rows, dealt to the classes by their shares with largest
  remainders (ties by class), the first rows of each class; for regression the
  first rows of the table;
* fold = contiguous blocks of the remaining rows in the same order, per class
  for classification (stratified, unshuffled), over all rows for regression;
  the first blocks have one row more where the rows don't divide evenly.

So a class has a few boundaries, and only those are looked for: quantiles
bracket them, rows between brackets are counted and the keys inside brackets are
ranked, for all classes together.  Rows are then tagged by comparing their key
with their class's boundary keys; no exchange carries the rows themselves.

This is the same construction as an unshuffled stratified k-fold over a
shuffled split; it does not reproduce another library's random draws.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.ranks import running_weight
from tablewright.schema import q
from tablewright.staging import scoped

TEST_SIZE = 0.2
SEED = 42


def hash_order(df: DataFrame, key_cols: list[str] | None = None, seed: int = SEED) -> Column:
    cols = key_cols or df.columns
    return F.xxhash64(F.lit(seed), *[F.col(q(c)) for c in cols])


def folds_count(task: str, class_train_counts: dict | None = None, n_train: int = 0) -> int:
    """classification: clamp(smallest class, 2, 5); regression: clamp(n // 5, 2, 5)."""
    if task == "classification":
        mn = min(class_train_counts.values()) if class_train_counts else 2
        return max(2, min(5, int(mn)))
    return max(2, min(5, n_train // 5))


# Classes of a stratified target; more is not a classification target.
MAX_SPLIT_CLASSES = 10_000


def holdout_counts(counts: dict, test_size: float = TEST_SIZE) -> dict:
    """Test rows of each class: ceil(test_size * n) in all, largest remainders."""
    n = sum(counts.values())
    total = math.ceil(test_size * n)
    exact = {c: (total * v // n, total * v % n) for c, v in counts.items()}
    spare = total - sum(f for f, _ in exact.values())
    up = sorted(counts, key=lambda c: (-exact[c][1], str(c)))[:spare]
    return {c: f + (c in up) for c, (f, _) in exact.items()}


#: Quantiles per class that bracket the boundaries.
GRID = 256


def _sizes(counts: dict, task: str, test_size: float, folds: int | None) -> tuple[dict, int, dict]:
    """Test rows of each class, the number of folds, and where each part of a
    class begins: after the test rows and after each fold."""
    if task == "classification" and any(v < 2 for v in counts.values()):
        raise ValueError("a stratified split needs two rows or more of every class")
    test_n = holdout_counts(counts, test_size)
    train_n = {c: counts[c] - test_n[c] for c in counts}
    k = folds or folds_count(task, train_n, sum(train_n.values()))
    begins = {c: [test_n[c] + (m // k) * f + min(f, m % k) for f in range(k)] for c, m in train_n.items()}
    return test_n, k, begins


def _classes(df: DataFrame, target: str, task: str, *more: Column) -> list:
    cls = F.col(q(target)).cast("string") if task == "classification" else F.lit("all")
    rows = df.groupBy(cls.alias("cls")).agg(F.count(F.lit(1)).alias("n"), *more).limit(MAX_SPLIT_CLASSES + 1).collect()
    if len(rows) > MAX_SPLIT_CLASSES:
        raise ValueError(f"{target} has more than {MAX_SPLIT_CLASSES} classes")
    return rows


def split_sizes(df: DataFrame, target: str, task: str, test_size: float = TEST_SIZE, folds: int | None = None) -> dict:
    """{folds, train_rows, test_rows, class_counts} from one count per class."""
    counts = {r["cls"]: r["n"] for r in _classes(df, target, task)}
    test_n, k, _ = _sizes(counts, task, test_size, folds)
    return {"folds": k, "train_rows": sum(counts.values()) - sum(test_n.values()), "test_rows": sum(test_n.values()), "class_counts": counts}


def _brackets(grid: list | None, n: int, begins: list[int]) -> list[tuple]:
    """Ranges of the order value that hold the rows at ``begins``, apart from each
    other; None: no end."""
    if not grid:
        return [(None, None)]
    out: list[list] = []
    for at in begins:
        i = at * GRID // max(n, 1)
        lo, hi = (grid[i - 1] if i > 0 else None), (grid[i + 2] if i + 2 <= GRID else None)
        if out and (out[-1][1] is None or (lo is None or lo <= out[-1][1])):
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [tuple(b) for b in out]


@scoped
def _boundaries(keyed: DataFrame, order_type: T.DataType, brackets: dict, begins: dict) -> list:
    """(cls, part, key, below, begin): the key of the row at which each part of a
    class begins and the rows before that key; ``key`` is null where a bracket
    doesn't hold its boundary.  A few rows a class."""
    spark = keyed.sparkSession
    t = order_type.simpleString()
    rows = [(c, [b[0] for b in brackets[c]], [b[1] for b in brackets[c]], begins[c]) for c in begins]
    edges = F.broadcast(spark.createDataFrame(rows, f"cls string, los array<{t}>, his array<{t}>, begins array<long>"))
    at = F.col("key._ord")
    number = F.size(F.filter("los", lambda x: x.isNull() | (x <= at))) + F.size(F.filter("his", lambda x: x < at))
    binned = keyed.join(edges, keyed["_cls"].eqNullSafe(edges["cls"])).withColumn("bin", number)
    # rows outside the brackets are one number a gap, keys inside are counted each
    counted = binned.groupBy("cls", "bin", F.when(F.col("bin") % 2 == 1, F.col("key")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_weight(counted, ["cls"], ["bin", "key"], "n")
    hit = ranked.join(edges.select("cls", F.posexplode("begins").alias("part", "begin")), "cls")
    return (hit.where((F.col("_below") <= F.col("begin")) & (F.col("begin") < F.col("_below") + F.col("n")))
            .select("cls", (F.col("part") + 1).alias("part"), "key", F.col("_below").alias("below"), "begin").collect())


def assign_split_folds(df: DataFrame, target: str, task: str, order: Column | None = None,
                       tie_cols: list[str] | None = None, test_size: float = TEST_SIZE,
                       folds: int | None = None) -> tuple[DataFrame, dict]:
    """Add ``_split`` ('train'/'test') and ``_fold`` (0..k-1, null on test).

    Returns (tagged DataFrame, info) with info = {folds, train_rows, test_rows,
    class_counts}.  Rows that differ anywhere are ordered by what they hold, the
    same on every run; of exact copies across a boundary any may be on either side.
    The tags are a projection of ``df`` beside a small table of boundaries.
    """
    order = order if order is not None else hash_order(df, tie_cols)
    kind = df.select(order.alias("o")).schema[0].dataType
    numeric = isinstance(kind, (T.IntegralType, T.FractionalType))
    if numeric:
        kind = T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType()
        order = order.cast(kind)
    more = [F.percentile_approx(order, [i / GRID for i in range(GRID + 1)], 10_000).alias("grid")] if numeric else []
    rows = _classes(df, target, task, *more)
    counts = {r["cls"]: r["n"] for r in rows}
    test_n, k, begins = _sizes(counts, task, test_size, folds)
    info = {"folds": k, "train_rows": sum(counts.values()) - sum(test_n.values()), "test_rows": sum(test_n.values()), "class_counts": counts}
    begins = {c: [x for x in b if x < counts[c]] for c, b in begins.items()}
    key = F.struct(order.alias("_ord"), *[F.col(q(c)).alias(f"_tie{i}") for i, c in enumerate(tie_cols or [])],
                   F.xxhash64(*[F.col(q(c)) for c in df.columns]).alias("_row"))
    cls = F.col(q(target)).cast("string") if task == "classification" else F.lit("all")
    keyed = df.select(cls.alias("_cls"), key.alias("key"))
    brackets = {r["cls"]: _brackets(r["grid"] if numeric else None, r["n"], begins[r["cls"]]) for r in rows}
    while True:
        found = _boundaries(keyed, kind, brackets, begins)
        lost = {r["cls"] for r in found if r["key"] is None}
        if not lost:
            break
        brackets |= {c: [(None, None)] for c in lost}
    copied = any(r["below"] < r["begin"] for r in found)
    # at most MAX_SPLIT_CLASSES classes of a few keys each
    found = df.sparkSession.createDataFrame(found, T.StructType([T.StructField("cls", T.StringType()), T.StructField("part", T.IntegerType()), keyed.schema["key"],
                                                                 T.StructField("below", T.LongType()), T.StructField("begin", T.LongType())]))
    parts = found.groupBy(F.col("cls").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("part", "key"))).alias("_parts"))
    tagged = df.withColumn("_cls", cls).withColumn("_key", key)
    part = F.size(F.filter("_parts", lambda b: b["key"] <= F.col("_key")))
    if copied:
        tagged = _copies_apart(tagged, found, parts, part)
    else:
        tagged = tagged.join(F.broadcast(parts), tagged["_cls"].eqNullSafe(parts["_of"]), "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(part))
    out = tagged.select(*[F.col(q(c)) for c in df.columns], F.when(F.col("_part") == 0, "test").otherwise("train").alias("_split"),
                        F.when(F.col("_part") > 0, F.col("_part") - 1).alias("_fold"))
    return out, info


def _copies_apart(tagged: DataFrame, found: DataFrame, parts: DataFrame, part: Column) -> DataFrame:
    """Tags where a boundary lies among copies of one row: these copies are
    numbered, all other rows are tagged by their key."""
    cut = found.groupBy("cls", "key").agg(F.min("below").alias("_first"), F.max("begin").alias("_to")).where("_first < _to").select(F.col("cls").alias("_of"), F.col("key").alias("_at"), "_first")
    begins = found.groupBy(F.col("cls").alias("_of")).agg(F.collect_list("begin").alias("_begins"))
    joined = tagged.join(F.broadcast(parts), tagged["_cls"].eqNullSafe(parts["_of"]), "left").drop("_of")
    same = joined["_cls"].eqNullSafe(cut["_of"]) & joined["_key"].eqNullSafe(cut["_at"])
    rest = joined.join(F.broadcast(cut), same, "left_anti").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(part))
    copies = joined.join(F.broadcast(cut), same).drop("_of", "_at").withColumn("_copy", F.monotonically_increasing_id()).withColumn("_group", F.coalesce("_cls", F.lit("")))
    ranked = running_weight(copies, ["_group", "_key"], ["_copy"])
    ranked = ranked.join(F.broadcast(begins), ranked["_cls"].eqNullSafe(begins["_of"]))
    placed = ranked.withColumn("_part", F.size(F.filter("_begins", lambda b: b <= F.col("_first") + F.col("_below"))))
    return rest.unionByName(placed.select(*rest.columns))
