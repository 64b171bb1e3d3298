"""Kendall tau-b of column pairs by recursive two-dimensional decomposition.

What is wanted of a set of weighted points is S, the sum over its pairs of
points of sign(dx) * sign(dy) * the weights.  A set of more than BLOCK_ROWS
points is cut at up to FAN values of x and of y; a cutting value is a block of
its own, so a heavy value never fills a block with others.  Then

    S(points) = S(grid) + sum of S(x block) + sum of S(y block with x by block)

* the *grid*, one point per pair of blocks, has the pairs that differ in both;
* an *x block* has the pairs inside it, with their own x and y;
* a *y block* has the pairs inside it that differ in the block of x, so its x
  is the block number, and it is cut by y only from then on.

Blocks of a single value hold ties only and go.  Each part is again a set of
points, so the same step is repeated on whatever is still too big.  Every open
set of a level, of all pairs, is cut in one set of jobs, and points are copied
twice a level.  Sets of BLOCK_ROWS points at most are counted inside tasks, many
in one numpy call: points in order of x are split by the bits of their y rank,
from the highest, and each level counts the pairs that differ there first.
"""

from __future__ import annotations

import math
import sys
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.schema import as_double
from tablewright.session import ship_by_value
from tablewright.staging import scoped, staged

ship_by_value(sys.modules[__name__])

#: Points of a set that is counted without cutting it.
BLOCK_ROWS = 8192
#: Cutting values of a set and side, at most (a power of two less one).
FAN = 63
#: Rows of the sets that are counted in one numpy call, about.
CALL_ROWS = 1 << 16


def _exclusive(v: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the values before each row, from the row ``start`` on."""
    c = np.cumsum(v) - v
    return c - c[start]


def _starts(new: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _changes(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def sign_sums(g: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """S of each set: ``g`` numbers the sets from 0; points of a set differ in x or y."""
    if not len(g):
        return np.zeros(0)
    sets = int(g.max()) + 1
    o = np.lexsort((y, x, g))
    g, x, y, w = g[o], x[o], y[o], w[o].astype(float)
    # points with one x are in order of y and will be counted as if x differed
    out = -np.bincount(g, w * _exclusive(w, _starts(_changes(g, x))), sets)
    by_y = np.lexsort((y, g))
    distinct = np.cumsum(_changes(g[by_y], y[by_y]))
    rank = np.empty(len(g), np.int64)
    rank[by_y] = distinct - distinct[_starts(_changes(g[by_y]))]
    new = _changes(g)
    for b in reversed(range(int(rank.max()).bit_length())):
        start = _starts(new)
        one = (rank >> b) & 1
        ones_before, zeros_before = _exclusive(w * one, start), _exclusive(w * (1 - one), start)
        out += np.bincount(g, w * np.where(one == 1, zeros_before, -ones_before), sets)
        # zeros of a node first, then its ones, both in order of x
        node = np.cumsum(new) - 1
        place = start + np.where(one == 1, np.bincount(node, 1 - one).astype(np.int64)[node] + _exclusive(one, start), _exclusive(1 - one, start))
        for v in (rank, w, node, one):
            v[place] = v.copy()
        new = _changes(node, one)
    return out


def _count_sets(batches):
    """(pair, s) of the sets in a partition sorted by set."""
    import numpy as np
    import pyarrow as pa

    def heads(t):
        """Whether a row is the first of its set."""
        return _changes(t.column("pair").to_numpy(), t.column("prob").combine_chunks().dictionary_encode().indices.to_numpy())

    def count(t):
        new = heads(t)
        s = sign_sums(np.cumsum(new) - 1, *[t.column(c).to_numpy() for c in ("x", "y", "w")])
        return pa.RecordBatch.from_arrays([pa.array(t.column("pair").to_numpy()[new]), pa.array(s)], ["pair", "s"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CALL_ROWS:
            t = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(heads(t))[-1])  # this set may go on in the next batch
            if last:
                yield count(t.slice(0, last).combine_chunks())
            held, rows = t.slice(last).to_batches(), t.num_rows - last
    if rows:
        yield count(pa.Table.from_batches(held).combine_chunks())


def _with_block(df: DataFrame, value: str, edges: str, out: str) -> DataFrame:
    """``out``: twice the number of edges below the value, plus one if it is an edge."""
    df = df.withColumn(out, F.lit(0))
    step = (FAN + 1) // 2
    while step:
        df = df.withColumn(out, F.col(out) + F.when(F.get(edges, F.col(out) + F.lit(step - 1)) < F.col(value), step).otherwise(0))
        step //= 2
    return df.withColumn(out, F.col(out) * 2 + F.coalesce((F.get(edges, F.col(out)) == F.col(value)).cast("int"), F.lit(0)))


def _sizes(points: DataFrame, block_rows: int) -> DataFrame:
    """Each set with its number of points and, where that is above a block, its
    cutting values: as many as make parts of a quarter of a block, but so few
    that the grid has half as many cells as the set points."""
    probs = [i / (FAN + 1) for i in range(1, FAN + 1)]
    cuts = points.groupBy("pair", "prob").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, probs, 10000).alias(f"e{c}") for c in ("x", "y")])
    m = F.greatest(F.lit(1), F.least(F.lit(FAN), F.ceil(F.col("n") * 4 / block_rows), F.floor(F.sqrt(F.col("n") / 8)))).cast("int")

    def chosen(e: str) -> Column:
        at = lambda j: F.floor(j * (FAN + 1) / (F.col("m") + 1)).cast("int") - 1
        return F.when(F.col("n") > block_rows, F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("m")), lambda j: F.get(e, at(j))))).alias(e)

    return cuts.withColumn("m", m).select("pair", "prob", "n", chosen("ex"), chosen("ey"))


def _parts(points: DataFrame, edges: DataFrame) -> DataFrame:
    """The sets that ``points`` are cut into."""
    blk = _with_block(_with_block(points.join(edges, ["pair", "prob"]), "x", "ex", "bx"), "y", "ey", "by")
    # a set whose x are block numbers already is not cut by x
    blk = blk.withColumn("bx", F.when(F.col("full"), F.col("bx").cast("double")).otherwise(F.col("x")))
    part = lambda name, full, x, y: F.struct(F.concat("prob", *name).alias("prob"), F.lit(full).alias("full"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    parts = F.array(
        part([F.lit("/g")], True, F.col("bx"), F.col("by")),
        F.when(F.col("full") & (F.col("bx") % 2 == 0), part([F.lit("/x"), F.col("bx").cast("int").cast("string")], True, F.col("x"), F.col("y"))),
        F.when(F.col("by") % 2 == 0, part([F.lit("/y"), F.col("by").cast("string")], False, F.col("bx"), F.col("y"))))
    rows = blk.select("pair", "w", F.explode(F.array_compact(parts)).alias("p")).select("pair", "p.*", "w")
    return rows.groupBy("pair", "prob", "full", "x", "y").agg(F.sum("w").alias("w"))


def _sum_signs(points: DataFrame, block_rows: int) -> dict[int, float]:
    """S of each pair's points."""
    total: dict[int, float] = defaultdict(float)
    points = points.select("pair", F.lit("").alias("prob"), F.lit(True).alias("full"), "x", "y", "w")
    while True:
        sizes = staged(_sizes(points, block_rows), "kendall-sizes")
        small, open_ = sizes.agg(F.count_if(F.col("ex").isNull()), F.count_if(F.col("ex").isNotNull())).first()
        edges = sizes.where("ex IS NOT NULL").select("pair", "prob", "ex", "ey")
        if small:
            rest = points.join(edges.select("pair", "prob"), ["pair", "prob"], "left_anti") if open_ else points
            counted = (rest.select("pair", "prob", "x", "y", "w").repartition("pair", "prob").sortWithinPartitions("pair", "prob")
                       .mapInArrow(_count_sets, "pair int, s double"))
            for r in counted.groupBy("pair").agg(F.sum("s").alias("s")).collect():
                total[r["pair"]] += r["s"]
        if not open_:
            return total
        points = staged(_parts(points, edges), "kendall-parts")


@scoped
def kendall_pairs(df: DataFrame, pairs: list[tuple[str, str]], block_rows: int | None = None) -> dict:
    """{pair: tau-b or None} on each pair's complete rows, all pairs in one set of
    jobs.  None: fewer than two complete rows, or a constant side."""
    if not pairs:
        return {}
    block_rows = max(16, block_rows or BLOCK_ROWS)
    structs = [F.struct(F.lit(i).alias("pair"), as_double(df, a).alias("x"), as_double(df, b).alias("y")) for i, (a, b) in enumerate(pairs)]
    points = staged(df.select(F.inline(F.array(*structs))).filter("x IS NOT NULL AND y IS NOT NULL")
                    .groupBy("pair", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")), "kendall-points")
    sides = points.select("pair", F.inline(F.array(F.struct(F.lit("x").alias("side"), F.col("x").alias("value"), "w"),
                                                   F.struct(F.lit("y").alias("side"), F.col("y").alias("value"), "w"))))
    values = sides.groupBy("pair", "side", "value").agg(F.sum("w").alias("t"))
    ties = {(r["pair"], r["side"]): r for r in values.groupBy("pair", "side")
            .agg(F.sum("t").alias("n"), F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("tied")).collect()}
    signs = _sum_signs(points, block_rows) if ties else {}
    out = {}
    for i, p in enumerate(pairs):
        side = ties.get((i, "x"))
        free = [side["n"] * (side["n"] - 1) / 2 - ties[i, s]["tied"] for s in "xy"] if side else [0.0]
        out[p] = signs.get(i, 0.0) / math.sqrt(free[0] * free[1]) if min(free) > 0 else None
    return out
