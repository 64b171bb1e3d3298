"""One-pass statistics over many columns.

Columns are processed together: one ``agg`` over the wide table for counts and
moments, or one long (column, value) table for anything that needs values in
order or by frequency.  Only per-column results (k rows) leave Spark.
"""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tablewright.schema import as_double, is_missing, q
from tablewright.session import ship_by_value
from tablewright.staging import scope, staged

# The counting function of the quantiles runs on executors.
ship_by_value(sys.modules[__name__])

# Aggregate expressions per generated ``agg`` (keeps codegen methods small).
AGG_CHUNK = 120


def agg_chunks(df: DataFrame, exprs: list[Column]) -> dict:
    """Run a long list of aggregate expressions in chunks of ``AGG_CHUNK``;
    returns one merged dict (each chunk is one scan of ``df``)."""
    out: dict = {}
    for i in range(0, len(exprs), AGG_CHUNK):
        row = df.agg(*exprs[i:i + AGG_CHUNK]).collect()[0]
        out.update(row.asDict())
    return out


def long_values(df: DataFrame, cols: list[str], numeric: bool = True,
                keep_null: bool = False) -> DataFrame:
    """Unpivot ``cols`` into (column, value); numeric as double, else as text."""
    if not cols:
        raise ValueError("no columns")
    structs = []
    for c in cols:
        v = as_double(df, c) if numeric else F.col(q(c)).cast("string")
        structs.append(F.struct(F.lit(c).alias("column"), v.alias("value")))
    out = df.select(F.inline(F.array(*structs)))
    return out if keep_null else out.filter(F.col("value").isNotNull())


def freq_table(df: DataFrame, cols: list[str], numeric: bool = True,
               keep_null: bool = False) -> DataFrame:
    """(column, value, count): map-side combined, so a hot value costs one row
    per map task, not one row per occurrence."""
    return (long_values(df, cols, numeric, keep_null)
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))


# Bits that one counting pass settles, the columns it takes at once, and the
# rows up to which a bucket's values are put in order instead.
DIGIT_BITS = 16
DIGIT_COLUMNS = 64
BUCKET_ROWS = 100_000
_SIGN = 1 << 63


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as 64-bit integers in the same order (-0.0 as 0.0)."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(_SIGN))


def _double(key: int) -> float:
    """The double of an ordered integer, no further out than infinity."""
    ends = _ordered(np.array([-np.inf, np.inf]))
    key = min(max(key, int(ends[0])), int(ends[1]))
    bits = key ^ _SIGN if key & _SIGN else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(float)[0])


def _digit_counts(df: DataFrame, columns: list[Column], known: dict[int, list[int]], bits: int) -> dict:
    """{(column, prefix): {digit: rows}} of the next DIGIT_BITS bits of the values
    whose first ``bits`` bits are one of the column's prefixes: one scan, counted
    inside the tasks."""
    asked = {i: np.array(sorted(p), np.uint64) for i, p in known.items()}

    def count(batches):
        import numpy as np
        import pyarrow as pa
        size = 1 << DIGIT_BITS
        sums = {i: np.zeros(len(p) * size, np.int64) for i, p in asked.items()}

        def add(held):
            for i, prefixes in asked.items():
                key = _ordered(np.concatenate([b.column(i).drop_null().to_numpy(zero_copy_only=False) for b in held]))
                if bits:
                    head = key >> np.uint64(64 - bits)
                    at = np.minimum(np.searchsorted(prefixes, head), len(prefixes) - 1)
                    inside = prefixes[at] == head
                    key, at = key[inside], at[inside]
                digit = ((key >> np.uint64(64 - bits - DIGIT_BITS)) & np.uint64(size - 1)).astype(np.int64)
                sums[i] += np.bincount(at * size + digit if bits else digit, minlength=len(sums[i]))

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 18:
                add(held)
                held, rows = [], 0
        if held:
            add(held)
        for i, s in sums.items():
            hit = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), i)), pa.array(hit >> DIGIT_BITS), pa.array(hit & (size - 1)), pa.array(s[hit])], ["c", "p", "d", "n"])

    parts = df.select(*[c.alias(f"x{i}") for i, c in enumerate(columns)]).mapInArrow(count, "c long, p long, d long, n long")
    out: dict = {(i, int(p)): {} for i, ps in asked.items() for p in ps}
    for r in parts.groupBy("c", "p", "d").agg(F.sum("n").alias("n")).collect():
        out[r["c"], int(asked[r["c"]][r["p"]])][r["d"]] = r["n"]
    return out


def _buckets(df: DataFrame, columns: list[Column], probs: list[float]) -> tuple[dict, dict]:
    """({column: n}, {(column, position): (prefix, its bits, rank inside, rows inside)})
    for the one or two positions that each quantile lies between."""
    found = _digit_counts(df, columns, {i: [0] for i in range(len(columns))}, 0)
    n = {i: sum(found[i, 0].values()) for i in range(len(columns))}
    places = {(i, k): (0, 0, k, n[i]) for i in n if n[i] for p in probs for k in {math.floor((n[i] - 1) * p), math.ceil((n[i] - 1) * p)}}
    bits, open_ = 0, list(places)
    while open_:
        for i, k in open_:
            prefix, _, rank, _ = places[i, k]
            for digit, rows in sorted(found[i, prefix].items()):
                if rank < rows:
                    places[i, k] = ((prefix << DIGIT_BITS) | digit, bits + DIGIT_BITS, rank, rows)
                    break
                rank -= rows
        bits += DIGIT_BITS
        open_ = [key for key in open_ if places[key][3] > BUCKET_ROWS and bits < 64]
        if open_:
            known: dict = {}
            for i, k in open_:
                known.setdefault(i, set()).add(places[i, k][0])
            found = _digit_counts(df, columns, {i: sorted(p) for i, p in known.items()}, bits)
    return n, places


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> list[dict]:
    """Exact quantiles with linear interpolation at position (n-1)p of the sorted
    non-null values, as dicts (column, p, n, value); all-null columns give none.

    Radix selection: values are read as integers of the same order, and a pass
    counts the next 16 bits of all columns inside the tasks, so a position is
    followed into one bucket of 65,536 each time.  Buckets of BUCKET_ROWS rows
    at most are put in order (a repeated value once); a bucket of all 64 bits is
    one value.  No shuffle carries the columns themselves, and the number of
    passes, four at most, doesn't depend on the columns.
    """
    out = []
    probs = [float(p) for p in probs]
    for lo in range(0, len(cols), DIGIT_COLUMNS):
        some = cols[lo: lo + DIGIT_COLUMNS]
        columns = [as_double(df, c) for c in some]
        n, places = _buckets(df, columns, probs)
        at = _values_at(df, columns, places)
        for i, c in enumerate(some):
            for p in probs if n[i] else []:
                k = (n[i] - 1) * p
                a, b, frac = at[i, math.floor(k)], at[i, math.ceil(k)], k - math.floor(k)
                out.append({"column": c, "p": p, "n": n[i], "value": a if frac == 0 else a + frac * (b - a)})
    return out


def _values_at(df: DataFrame, columns: list[Column], places: dict) -> dict:
    """{(column, position): value}, from the values inside the open buckets."""
    out, buckets = {}, {}
    for (i, k), (prefix, bits, rank, _) in places.items():
        if bits == 64:
            out[i, k] = _double(prefix)
        else:
            buckets.setdefault((i, prefix, bits), {})[k] = rank
    if not buckets:
        return out
    ids = {b: t for t, b in enumerate(buckets)}
    inside = []
    for (i, prefix, bits), t in ids.items():
        lo, hi = _double(prefix << (64 - bits)), _double(((prefix + 1) << (64 - bits)) - 1)
        inside.append(F.when(columns[i].between(F.lit(lo), F.lit(hi)), F.struct(F.lit(t).alias("id"), columns[i].alias("value"))))
    table = (df.select(F.explode(F.filter(F.array(*inside), lambda x: x.isNotNull())).alias("s")).select("s.*")
             .groupBy("id", "value").agg(F.count(F.lit(1)).alias("count")))
    targets = df.sparkSession.createDataFrame([(ids[b], sorted(set(ks.values()))) for b, ks in buckets.items()], "id int, ranks array<long>")
    upto = F.sum("count").over(Window.partitionBy("id").orderBy("value"))  # a bucket is bounded
    hits = (table.withColumn("upto", upto).join(F.broadcast(targets), "id")
            .select("id", "value", F.explode(F.filter("ranks", lambda r: (F.col("upto") - F.col("count") <= r) & (r < F.col("upto")))).alias("rank")))
    value = {(r["id"], r["rank"]): r["value"] for r in hits.collect()}
    for b, ks in buckets.items():
        for k, rank in ks.items():
            out[b[0], k] = value[ids[b], rank]
    return out


def fence_stats(df: DataFrame, bounds: dict) -> dict:
    """Per column of ``bounds`` (lo, hi): values below lo / above hi, the most
    extreme values inside, and n, in one aggregate."""
    if not bounds:
        return {}
    exprs = []
    for i, (c, (lo, hi)) in enumerate(bounds.items()):
        v = as_double(df, c)
        exprs += [F.count_if(v < F.lit(float(lo))).alias(f"below{i}"), F.count_if(v > F.lit(float(hi))).alias(f"above{i}"),
                  F.min(F.when(v >= F.lit(float(lo)), v)).alias(f"whisker_lo{i}"), F.max(F.when(v <= F.lit(float(hi)), v)).alias(f"whisker_hi{i}"),
                  F.count(v).alias(f"n{i}")]
    row = agg_chunks(df, exprs)
    return {c: {k: row[f"{k}{i}"] for k in ("below", "above", "whisker_lo", "whisker_hi", "n")} for i, c in enumerate(bounds)}


def iqr_fences(qs: dict) -> dict:
    """{column: (Q1 - 1.5 IQR, Q3 + 1.5 IQR)} from {column: {p: value}}."""
    return {c: (v[0.25] - 1.5 * (v[0.75] - v[0.25]), v[0.75] + 1.5 * (v[0.75] - v[0.25])) for c, v in qs.items()}


def quantile_table(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """(column, p, n, value) of ``exact_quantiles`` (pandas ``quantile`` / SQL
    ``quantile_cont``)."""
    return df.sparkSession.createDataFrame(
        [(r["column"], float(r["p"]), int(r["n"]), float(r["value"])) for r in exact_quantiles(df, cols, probs)],
        "column string, p double, n long, value double")


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict:
    """{column: {p: value}} for the non-null values of each column; an all-null
    column is absent."""
    if not cols:
        return {}
    out: dict = {}
    for r in exact_quantiles(df, cols, probs):
        out.setdefault(r["column"], {})[r["p"]] = r["value"]
    return out


def medians(df: DataFrame, cols: list[str]) -> dict:
    return {c: v.get(0.5) for c, v in quantiles(df, cols, [0.5]).items()}


def modes(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent non-null value per column (as text), smallest on ties.

    Frequency table, then one partial-aggregated ``min`` over
    struct(-count, value): no column's values are gathered in one task.
    """
    if not cols:
        return {}
    freq = freq_table(df, cols, numeric=False)
    best = freq.groupBy("column").agg(
        F.min(F.struct((-F.col("count")).alias("nc"), F.col("value").alias("v"))).alias("b"))
    got = {r["column"]: r["v"] for r in best.select("column", "b.v").collect()}
    return {c: got.get(c) for c in cols}


def nunique(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, unique): distinct non-null values per column, compared in the
    column's own type (NaN is missing, -0.0 is 0.0), counted from a (column,
    value) table that is combined map-side, one branch per type."""
    by_type: dict = {}
    for c in cols:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    counts = None
    for kind, same in by_type.items():
        plain = kind not in ("float", "double")
        val = lambda c: F.col(q(c)) if plain else as_double(df, c) + F.lit(0.0)  # noqa: B023, E731
        long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), val(c).alias("value")) for c in same]))).where("value IS NOT NULL")
        part = long.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("unique"))
        counts = part if counts is None else counts.unionByName(part)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(counts, "column", "left").select("column", F.coalesce("unique", F.lit(0)).cast("long").alias("unique"))


def approx_nunique(df: DataFrame, cols: list[str], rsd: float = 0.01) -> DataFrame:
    """(column, unique_approx): HyperLogLog++ estimates in one aggregate pass
    (no shuffle of values).  Opt-in; labelled approximate."""
    one = df.agg(*[F.approx_count_distinct(F.col(q(c)), rsd).alias(f"u{i}") for i, c in enumerate(cols)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"u{i}").alias("unique_approx"))
                                          for i, c in enumerate(cols)])))


def approx_quantiles(df: DataFrame, cols: list[str], probs: list[float], accuracy: int = 10000) -> DataFrame:
    """(column, p, value_approx): ``percentile_approx`` (rank error about
    n / accuracy) in one pass.  Opt-in; labelled approximate."""
    one = df.agg(*[F.percentile_approx(as_double(df, c), [float(p) for p in probs], accuracy).alias(f"q{i}")
                   for i, c in enumerate(cols)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("p"), F.col(f"q{i}")[j].alias("value_approx"))
        for i, c in enumerate(cols) for j, p in enumerate(probs)])))


def skew_expr(c: Column) -> Column:
    """Bias-adjusted sample skewness (pandas ``skew``): null below 3 values,
    0 for a constant column."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    adj = g1 * F.sqrt(n * (n - F.lit(1.0))) / (n - F.lit(2.0))
    return (F.when(n < 3, F.lit(None).cast("double"))
             .when(F.var_pop(c) == 0, F.lit(0.0))
             .otherwise(adj))


def pearson_exprs(a: Column, b: Column) -> Column:
    """Pearson r on pairwise-complete values; null for a constant side."""
    both = a.isNotNull() & b.isNotNull()
    aa = F.when(both, a)
    bb = F.when(both, b)
    return F.try_divide(F.covar_pop(aa, bb), F.stddev_pop(aa) * F.stddev_pop(bb))


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a whole row, with floats normalised the way grouping
    compares them (-0.0 = 0.0, every NaN equal)."""
    from pyspark.sql import types as T
    parts = []
    for f in df.schema.fields:
        c = F.col(q(f.name))
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = (F.when(F.isnan(c), F.lit(float("nan")).cast(f.dataType))
                  .when(c == 0, F.lit(0.0).cast(f.dataType)).otherwise(c))
        parts.append(c)
    return F.xxhash64(*parts)


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _repeated_hashes(df: DataFrame, with_nulls: bool = False):
    """(staged table of the hashes seen more than once, their number, row count,
    null cells).  The figures are observed while the table is written, which
    holds repeated hashes only, so its size tells later joins what they join.
    With ``with_nulls`` each row's null count rides along, so a caller also gets
    the missing-cell total from the same pass."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    if with_nulls:
        per_row = None
        for c in df.columns:
            e = is_missing(df, c).cast("long")
            per_row = e if per_row is None else per_row + e
        aggs.append(F.sum(per_row).alias("_z"))
    seen = Observation()
    hashes = df.groupBy(row_hash(df).alias("_h")).agg(*aggs).observe(
        seen, F.sum("_n").alias("rows"), F.count_if(F.col("_n") > 1).alias("rep"),
        F.sum("_z" if with_nulls else F.lit(0)).alias("z"))
    rep = staged(hashes.filter("_n > 1").select("_h"), "row-hashes")
    tot = seen.get
    return rep, int(tot["rep"] or 0), int(tot["rows"] or 0), int(tot["z"] or 0)


def kpi_counts(df: DataFrame) -> tuple[int, int, int]:
    """(rows, missing cells, duplicate rows) in two scans: the hash pass also
    sums null cells; the second pass groups only rows whose hash repeats."""
    with scope(df.sparkSession):
        rep, n_rep, rows, missing = _repeated_hashes(df, with_nulls=True)
        return rows, missing, _duplicates_among(df, rep, n_rep)


def _duplicates_among(df: DataFrame, rep: DataFrame, n_rep: int) -> int:
    if n_rep == 0:
        return 0
    h = _free(df, "_h")
    cand = df.withColumn(h, row_hash(df)).join(rep.withColumnRenamed("_h", h), h, "left_semi").drop(h)
    row = (cand.groupBy(*[F.col(q(c)) for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
               .agg(F.sum(F.col("n") - F.lit(1)).alias("d")).collect()[0])
    return int(row["d"] or 0)


def duplicate_count(df: DataFrame) -> int:
    """Rows minus distinct rows (nulls compare equal), exact.

    Pass 1 shuffles only a 64-bit hash per row (map-side combined); rows
    whose hash is unique cannot have a copy.  Pass 2 groups, by all columns,
    only the rows whose hash repeats -- copies plus the rare collision -- so
    wide rows are shuffled only when they may be duplicates."""
    with scope(df.sparkSession):
        rep, n_rep, _, _ = _repeated_hashes(df)
        return _duplicates_among(df, rep, n_rep)


def distinct_rows(df: DataFrame, label: str) -> tuple[DataFrame, int, int]:
    """(distinct rows, number of rows, number of distinct rows); the first is
    staged under ``label``.

    As in ``duplicate_count`` a pass over row hashes comes first.  Rows whose
    hash is unique are written as they are read, however wide; only rows whose
    hash repeats are grouped by all columns (combined map-side, so a row copied
    a billion times is one row per task)."""
    h, again = _free(df, "_h"), _free(df, "_again")
    rep, n_rep, rows, _ = _repeated_hashes(df)
    if n_rep == 0:
        return staged(df, label), rows, rows
    rep = rep.select(F.col("_h").alias(h), F.lit(True).alias(again))
    tagged = staged(df.withColumn(h, row_hash(df)).join(rep, h, "left").drop(h), label)
    once = tagged.filter(F.col(again).isNull()).drop(again)
    copies = staged(tagged.filter(F.col(again)).drop(again).dropDuplicates(), f"{label}-copies")
    return once.unionByName(copies), rows, once.count() + copies.count()
