"""Regression trees fitted on cells: the rows whose features fall into the same bins.

A tree splits between bins only (``maxBins`` a number, two for a one-hot slot),
so it can't tell the rows of a cell apart: their number, sum and sum of squares
of the label are all it needs of them.  The rows are read to find the bins, once
to sum up the cells and, for a forest, once to draw them: each row Poisson(1)
times for each tree, summed up by cell.  Trees are then grown on the sums with
Spark's rules (bins, gain, leaves, steps of boosting) and given back as Spark's
models.  Where rows don't share cells, the estimator fits them itself.

Rows of a cell have the same prediction too: the model is asked once for each
cell it was fitted on, and for rows of other cells one by one, where it is worth
the larger plan.
"""

from __future__ import annotations

import json
import sys
import time
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.ranks import running_weight
from tablewright.session import ship_by_value
from tablewright.staging import scope, staged, staging_path

ship_by_value(sys.modules[__name__])

# Slots of a vector that is binned; cells, and cells times bins, that trees are
# grown on in one task; rows a cell from which summing up is less work.
MAX_SLOTS = 256
MAX_CELLS = 10_000
MAX_PLACES = 5_000_000
LEAST_SHARE = 16
# Distinct values that are sorted on the driver; more are ranked by the executors.
MAX_VALUES = 1 << 17
# Rows drawn from at a time: counts and labels of them stay in a core's cache.
BLOCK = 1 << 16
EPSILON = 2.0 ** -52


@dataclass
class Cells:
    """``bins``: a row of bin numbers for each cell; ``starts``: the first place
    of each slot in a list of all bins, and its end; ``cuts``: the values between
    a number's bins, none for a binary slot; ``rows``: cell and label of each row."""
    bins: np.ndarray
    starts: np.ndarray
    cuts: list
    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    rows: DataFrame


def _kinds(table: DataFrame) -> list[bool] | None:
    """Whether each slot is binary, by the vector's attributes."""
    attrs = table.schema["features"].metadata.get("ml_attr", {})
    found = attrs.get("attrs", {})
    width = attrs.get("num_attrs", 0)
    if not 0 < width <= MAX_SLOTS or "nominal" in found or sum(map(len, found.values())) != width:
        return None
    binary = {a["idx"] for a in found.get("binary", [])}
    return [j in binary for j in range(width)]


def _chain(firsts: list, last: int) -> list[int]:
    """Of the values in order, those above a cut: the first whose middle is above
    a target, the next one where that has its cut already."""
    out: list[int] = []
    for i in firsts:
        at = max(i, out[-1] + 1 if out else 1)
        if at > last:
            break
        out.append(at)
    return out


def _cuts(table: DataFrame, slots: list[int], rows: int, max_bins: int) -> dict | None:
    """Spark's cuts of a number: between all values, if these are ``max_bins`` at
    most, else next to where each share of the rows ends.  Spark looks for them
    in 10,000 rows; here they come from all.  None: a value isn't finite."""
    if not slots:
        return {}
    bins = min(max_bins, rows)
    stride = rows / bins
    targets = [k * stride for k in range(1, bins)]
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("slot"), F.col("a")[j].alias("x")) for j in slots]))
    counts = table.select(vector_to_array("features").alias("a")).select(each.alias("v")).groupBy("v.slot", "v.x").agg(F.count(F.lit(1)).alias("n"))
    few = counts.limit(MAX_VALUES + 1).toArrow()
    out = {}
    if few.num_rows <= MAX_VALUES:
        slot, x, n = (few.column(c).to_numpy() for c in ("slot", "x", "n"))
        if not np.isfinite(x).all():
            return None
        for j in slots:
            own = np.flatnonzero(slot == j)
            own = own[np.argsort(x[own])]
            value, upto = x[own], np.cumsum(n[own])
            last = len(own) - 1
            at = list(range(1, len(own))) if last < bins else _chain(list(1 + np.searchsorted((upto[:-1] + upto[1:]) / 2, targets, side="right")), last)
            out[j] = _middles((value[i - 1], value[i]) for i in at)
        return out
    with scope(table.sparkSession):
        below = running_weight(counts, ["slot"], ["x"], "n").withColumnRenamed("_below", "below").drop("_total")
        ranks = staged(running_weight(below, ["slot"], ["x"]).select("slot", "x", "n", "below", F.col("_below").alias("i")), "values")
        middle = F.col("below") + F.col("n") / 2
        firsts = ranks.groupBy("slot").agg(F.max("i").alias("last"), F.bool_or(F.isnan("x") | F.abs("x").isin(float("inf"))).alias("odd"),
                                           *[F.min(F.when((F.col("i") > 0) & (middle > t), F.col("i"))).alias(f"t{k}") for k, t in enumerate(targets)]).collect()
        if any(r["odd"] for r in firsts):
            return None
        at = {r["slot"]: list(range(1, r["last"] + 1)) if r["last"] < bins else _chain([r["last"] + 1 if r[f"t{k}"] is None else r[f"t{k}"] for k in range(len(targets))], r["last"])
              for r in firsts}
        wanted = [(j, i) for j, a in at.items() for i in sorted({*a, *(i - 1 for i in a)})] or [(-1, -1)]
        asked = table.sparkSession.createDataFrame(pa.table({"slot": pa.array([j for j, _ in wanted], pa.int32()), "i": [i for _, i in wanted]}))
        value = {(r["slot"], r["i"]): r["x"] for r in ranks.join(F.broadcast(asked), ["slot", "i"]).collect()}
    return {j: _middles((value[j, i - 1], value[j, i]) for i in a) for j, a in at.items()}


def _middles(pairs) -> list[float]:
    """One cut where rounding puts two at the same place."""
    return sorted({float((a + b) / 2) for a, b in pairs})


def binned(table: DataFrame, rows: int, max_bins: int = 32) -> Cells | None:
    """The cells of a table of ``features`` and ``_label``; None where rows don't
    share cells, or a value is one that Spark refuses."""
    binary = _kinds(table)
    if binary is None:
        return None
    found = _cuts(table, [j for j, b in enumerate(binary) if not b], rows, max_bins)
    if found is None:
        return None
    cuts = [None if b else found[j] for j, b in enumerate(binary)]
    starts = np.cumsum([0, *(2 if c is None else len(c) + 1 for c in cuts)])
    keyed = _keyed(table.select("features", "_label"), "features", cuts)
    y = F.col("_label")
    sums = keyed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.count(y).alias("known"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    most = min(MAX_CELLS, MAX_PLACES // int(starts[-1]), rows // LEAST_SHARE)
    got = sums.limit(most + 1).toArrow()
    if not 0 < got.num_rows <= most:
        return None
    order = sorted(range(got.num_rows), key=got.column("_cell").to_pylist().__getitem__)
    got = got.take(order)
    n, s, q = (np.asarray(got.column(c).to_numpy(), float) for c in ("n", "s", "q"))
    if got.column("known").to_pylist() != got.column("n").to_pylist() or not np.isfinite(q).all():
        return None
    keys = np.array(got.column("_cell").to_pylist(), np.uint8)
    return Cells(keys, starts, cuts, n, s, q, keyed.join(F.broadcast(_named(table.sparkSession, keys, "cell", pa.array(range(len(keys)), pa.int32()))), "_cell").select("cell", y.cast("double").alias("y")))


def _keyed(df: DataFrame, features: str, cuts: list) -> DataFrame:
    """With ``_cell``: for each slot the number of its cuts below the value."""
    # apart, so that the vector is unpacked once
    slots = df.withColumn("_slots", vector_to_array(features))
    numbers = [j for j, c in enumerate(cuts) if c]
    if numbers:
        # a bucket has its lower end, a bin its upper one
        slots = slots.withColumns({f"_less{j}": -F.col("_slots")[j] for j in numbers})
        slots = Bucketizer(splitsArray=[[-np.inf, *(-t for t in reversed(cuts[j])), np.inf] for j in numbers], inputCols=[f"_less{j}" for j in numbers],
                           outputCols=[f"_bin{j}" for j in numbers], handleInvalid="keep").transform(slots)
    bins = [F.col("_slots")[j] > 0.5 if c is None else len(c) - F.col(f"_bin{j}") if c else F.lit(0) for j, c in enumerate(cuts)]
    return slots.select(*df.columns, F.array(*[b.cast("tinyint") for b in bins]).alias("_cell"))


def _named(spark: SparkSession, keys: np.ndarray, name: str, values: pa.Array) -> DataFrame:
    """A small table of a value for each cell."""
    cells = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel().astype(np.int8)))
    kind = {"cell": "int", "_known": "double"}[name]
    return spark.createDataFrame(pa.Table.from_arrays([cells, values], ["_cell", name]), f"_cell array<tinyint>, {name} {kind}")


def grow(bins: np.ndarray, starts: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray, max_depth: int) -> tuple[dict, np.ndarray]:
    """One regression tree on cells, a level at a time: (columns of its nodes, the
    node each cell ends in).  A node is split where that lowers the variance most,
    the first place on ties, until no split lowers it."""
    width = int(starts[-1])
    slot = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    place = bins + starts[:-1]
    end = np.full(len(n), -1)
    live = np.flatnonzero(n)
    node = np.zeros(len(live), np.int64)
    made, first, size = [], 0, 1
    for depth in range(max_depth + 1):
        total, mean, square = (np.bincount(node, x[live], size) for x in (n, s, q))
        mean, square = mean / total, square / total
        impurity = np.maximum(square - mean * mean, 0.0)
        best, gain = np.zeros(size, np.int64), np.zeros(size)
        if depth < max_depth:
            key = (node[:, None] * width + place[live]).ravel()
            # centred on the node's mean: what one side has the other lacks
            own = s[live] - n[live] * mean[node]
            left, lack = (np.cumsum(np.bincount(key, np.repeat(x, bins.shape[1]), size * width).reshape(size, width), axis=1) for x in (n[live], own))
            left, lack = (x - np.hstack([np.zeros((size, 1)), x])[:, starts[:-1]][:, slot] for x in (left, lack))
            both = left * (total[:, None] - left)
            with np.errstate(divide="ignore", invalid="ignore"):
                gains = np.where(both > 0, lack * lack / both, -1.0)
            best = gains.argmax(axis=1)
            gain = gains[np.arange(size), best]
        # below that, sums of equal labels differ by rounding only
        split = (gain > EPSILON * square) & (impurity >= EPSILON)
        child = np.cumsum(split) - 1
        made.append({"id": first + np.arange(size), "prediction": mean, "impurity": impurity, "n": total, "s": mean * total, "q": square * total, "gain": np.where(split, gain, -1.0),
                     "leftChild": np.where(split, first + size + 2 * child, -1), "rightChild": np.where(split, first + size + 2 * child + 1, -1), "place": np.where(split, best, -1)})
        end[live] = first + node
        on = split[node]
        live, node = live[on], node[on]
        if not len(live):
            break
        at = best[node]
        node = 2 * child[node] + (place[live, slot[at]] > at)
        first, size = first + size, 2 * int(split.sum())
    return {c: np.concatenate([m[c] for m in made]) for c in made[0]}, end


def _nodes(tree: int, made: dict, starts: np.ndarray, cuts: list) -> pa.RecordBatch:
    """A tree's nodes as Spark's models are written, but flat."""
    slot = np.searchsorted(starts, made["place"], side="right") - 1
    values, kinds = [], []
    for f, p in zip(slot, made["place"]):
        cut = None if p < 0 else cuts[f]
        values.append([] if p < 0 else [0.0] if cut is None else [float(cut[p - starts[f]])])
        kinds.append(2 if p >= 0 and cut is None else -1)
    whole = {c: pa.array(made[c].astype(np.int32)) for c in ("id", "leftChild", "rightChild")}
    part = {c: pa.array(made[c].astype(float)) for c in ("prediction", "impurity", "n", "s", "q", "gain")}
    return pa.RecordBatch.from_pydict({"treeID": pa.array(np.full(len(slot), tree, np.int32)), **whole, **part, "featureIndex": pa.array(np.where(made["place"] < 0, -1, slot).astype(np.int32)),
                                       "cut": pa.array(values, pa.list_(pa.float64())), "numCategories": pa.array(kinds, pa.int32())}).select([c.split()[0] for c in _NODE.split(", ")])


_NODE = ("treeID int, id int, leftChild int, rightChild int, prediction double, impurity double, n double, s double, q double, gain double, "
         "featureIndex int, cut array<double>, numCategories int")


def _drawn(batches, trees: int, cells: int, seed: int):
    """The rows of a task, each drawn Poisson(1) times for each tree (so many draws
    of any row as a Poisson number of the rows says), summed up by cell."""
    rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
    sums = np.zeros((3, trees, cells))

    def draw(held):
        cell, y = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("cell", "y"))
        for lo in range(0, len(cell), BLOCK):
            order = lo + np.argsort(cell[lo:lo + BLOCK], kind="stable")
            own, label = cell[order], y[order]
            begin = np.flatnonzero(np.diff(own, prepend=-1))
            have = own[begin]
            for t in range(trees):
                times = np.bincount(rng.integers(0, len(own), rng.poisson(len(own))), minlength=len(own))
                part = times * label
                sums[0, t, have] += np.add.reduceat(times, begin)
                sums[1, t, have] += np.add.reduceat(part, begin)
                sums[2, t, have] += np.add.reduceat(part * label, begin)

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            draw(held)
            held, rows = [], 0
    if rows:
        draw(held)
    for t in range(trees):
        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), *(pa.array([x[t]], pa.list_(pa.float64())) for x in sums)], ["treeID", "n", "s", "q"])


def _forest(cells: Cells, trees: int, max_depth: int, seed: int) -> DataFrame:
    bins, starts, cuts = cells.bins, cells.starts, cells.cuts
    count = len(bins)

    def tree(key, table):
        n, s, q = (np.add.reduce([np.asarray(v.values) for v in table.column(c)]) for c in ("n", "s", "q"))
        return pa.Table.from_batches([_nodes(key[0].as_py(), grow(bins, starts, n, s, q, max_depth)[0], starts, cuts)])

    drawn = cells.rows.mapInArrow(lambda batches: _drawn(batches, trees, count, seed), "treeID int, n array<double>, s array<double>, q array<double>")
    # a given number of tasks: few bytes would be put together, but they are much work
    spread = drawn.repartition(max(1, drawn.sparkSession.sparkContext.defaultParallelism), "treeID")
    return spread.groupBy("treeID").applyInArrow(tree, _NODE)


def boosted(cells: Cells, stages: int, max_depth: int, rate: float) -> list[dict]:
    """Trees of least-squares boosting: the first on the labels, each other on
    twice what the ones before it leave."""
    known, out = np.zeros(len(cells.n)), []
    for k in range(stages):
        n, s, q = cells.n, cells.s, cells.q
        if k:
            s, q = 2 * (s - n * known), 4 * (q - 2 * known * s + n * known * known)
        made, end = grow(cells.bins, cells.starts, n, s, q, max_depth)
        known = known + (rate if k else 1.0) * made["prediction"][end]
        out.append(made)
    return out


class _ByCell:
    """Predictions of the cells that the model was fitted on are looked up."""

    @classmethod
    def of(cls, model, cells: Cells):
        # a value of each bin: its upper cut, or one above the last
        def value(cut, b):
            return float(b) if cut is None else 0.0 if not cut else cut[b] if b < len(cut) else cut[-1] + max(1.0, abs(cut[-1]))
        spark = cells.rows.sparkSession
        rows = [[value(c, b) for c, b in zip(cells.cuts, key)] for key in cells.bins.tolist()]
        asked = spark.createDataFrame(pa.table({"id": pa.array(range(len(rows)), pa.int32()), "a": pa.array(rows, pa.list_(pa.float64()))}), "id int, a array<double>")
        found = model.transform(asked.select("id", array_to_vector("a").alias(model.getFeaturesCol()))).select("id", model.getPredictionCol()).toArrow().sort_by("id")
        out = cls(model._java_obj)
        model._java_obj = None  # a wrapper's end lets its Java model go
        out._transfer_params_from_java()
        out._cuts, out._known = cells.cuts, _named(spark, cells.bins, "_known", found.column(1).combine_chunks())
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found = self.getPredictionCol()
        rows = _keyed(dataset, self.getFeaturesCol(), self._cuts).join(F.broadcast(self._known), "_cell", "left")
        # the model is asked where the first is null
        return super()._transform(rows).withColumn(found, F.coalesce("_known", found)).select(*dataset.columns, found)


class ForestByCell(_ByCell, RandomForestRegressionModel):
    pass


class BoostedByCell(_ByCell, GBTRegressionModel):
    pass


def _as_asked(estimator) -> bool:
    """Whether the estimator has no setting that is not followed here."""
    get = estimator.getOrDefault
    same = get("impurity") == "variance" and get("featureSubsetStrategy") == "all" and get("subsamplingRate") == 1.0 and get("minInstancesPerNode") == 1 \
        and get("minInfoGain") == 0.0 and get("minWeightFractionPerNode") == 0.0 and not estimator.isSet("weightCol")
    if isinstance(estimator, RandomForestRegressor):
        return same and get("bootstrap") and get("numTrees") > 1
    return same and get("lossType") == "squared" and not estimator.isSet("validationIndicatorCol")


def fits(estimator) -> bool:
    return isinstance(estimator, (RandomForestRegressor, GBTRegressor)) and _as_asked(estimator)


def fit(estimator, cells: Cells, by_cell: bool = True):
    """The model of a forest or of boosting, as ``estimator`` is set; its
    predictions are looked up ``by_cell`` or asked of the trees row by row."""
    spark = cells.rows.sparkSession
    get = estimator.getOrDefault
    if isinstance(estimator, RandomForestRegressor):
        trees = get("numTrees")
        nodes = _forest(cells, trees, get("maxDepth"), get("seed"))
        model = _model(spark, estimator, RandomForestRegressionModel, nodes, [1.0] * trees, len(cells.cuts))
        return ForestByCell.of(model, cells) if by_cell else model
    made = boosted(cells, get("maxIter"), get("maxDepth"), get("stepSize"))
    nodes = pa.Table.from_batches([_nodes(t, m, cells.starts, cells.cuts) for t, m in enumerate(made)])
    model = _model(spark, estimator, GBTRegressionModel, spark.createDataFrame(nodes, _NODE), [1.0] + [get("stepSize")] * (len(made) - 1), len(cells.cuts))
    return BoostedByCell.of(model, cells) if by_cell else model


def _model(spark: SparkSession, estimator, kind, nodes: DataFrame, weights: list[float], width: int):
    """Spark's model of the nodes, by the files it is saved as."""
    name = lambda c: f"org.apache.spark.ml.regression.{c}"
    head = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    params = lambda m: {p.name: v for p, v in m.items()}
    own = {p.name: v for p, v in estimator._paramMap.items() if p.name in ("labelCol", "featuresCol", "maxDepth", "seed")}
    metadata = json.dumps({"class": name(kind.__name__), **head, "uid": estimator.uid, "paramMap": params(estimator._paramMap), "defaultParamMap": params(estimator._defaultParamMap),
                           "numFeatures": width, "numTrees": len(weights)})
    each = [(t, json.dumps({"class": name("DecisionTreeRegressionModel"), **head, "uid": f"dtr_{uuid.uuid4().hex[:12]}", "paramMap": own, "defaultParamMap": {}}), w) for t, w in enumerate(weights)]
    data = nodes.select("treeID", F.struct("id", "prediction", "impurity", F.array("n", "s", "q").alias("impurityStats"), F.col("n").cast("long").alias("rawCount"), "gain", "leftChild", "rightChild",
                                           F.struct("featureIndex", F.col("cut").alias("leftCategoriesOrThreshold"), "numCategories").alias("split")).alias("nodeData"))
    with scope(spark):
        path = staging_path(spark, "trees")
        spark.createDataFrame(pa.table({"value": [metadata]})).coalesce(1).write.text(f"{path}/metadata")
        spark.createDataFrame(pa.table({"_1": pa.array([t for t, _, _ in each], pa.int32()), "_2": [m for _, m, _ in each], "_3": [w for _, _, w in each]})).coalesce(1).write.parquet(f"{path}/treesMetadata")
        data.write.parquet(f"{path}/data")
        return kind.load(path)


__all__ = ["Cells", "binned", "boosted", "fit", "fits", "grow"]
