"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector x of list c is coded by the signs of P(x - c)/|x - c|, P a random
rotation: packed bits, the residual's length, and the code's own inner product
with the residual direction.  A query's inner product with x is estimated from
those alone; the estimate's error is at most ``EPS`` standard deviations of the
random rotation with high probability.  Only rows whose upper bound reaches
what the query needs are reranked on their original vectors, in double
precision.

Lists surround centroids (k-means on a bounded sample).  A query first searches
the one list with the best bound; its k-th best score there is what a row must
reach to matter.  Then it goes to every other list that can hold such a row:
the inner product with the centroid plus the query's length times the list's
radius bounds what a list can give, so lists are left out by proof, at any
number of rows.  Lists are bundled, large bundles and the queries that visit
them are cut into blocks, so a task holds one block of each however large a
list is.  Equal vectors are one code with its smallest ids: k + 1 of them are
enough for any answer, an exact reduction.

Vectors that are null, zero, or hold null or non-finite components, or whose
length is not the commonest, take no part; nor do rows without an id.  Rows
that repeat an id keep both vectors.  Ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import empty, stage, with_id

#: Vectors for the k-means fit (and at most 64 MB of them), list size aimed at,
#: most lists, rows and queries in a block.
SAMPLE, LIST_ROWS, MOST_LISTS, BLOCK_ROWS, BLOCK_QUERIES = 20_000, 2048, 4096, 16384, 2048
EPS = 2.5


def fit_lists(sample: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Centroids by a few rounds of Lloyd's k-means."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    c = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(8):
        near = np.argmax(sample @ c.T - 0.5 * (c * c).sum(1), axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        n = np.bincount(near, minlength=lists)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centroid: np.ndarray, p: np.ndarray):
    """Packed signs, residual lengths and the codes' inner products with the
    residual directions."""
    r = x - centroid
    length = np.sqrt((r * r).sum(1))
    o = (r @ p.T) / np.maximum(length, 1e-300)[:, None]
    bits = o > 0
    own = np.abs(o).sum(1) / math.sqrt(x.shape[1])
    return np.packbits(bits, axis=1), length, own


def upper_factors(codes: np.ndarray, length: np.ndarray, own: np.ndarray, dim: int, eps: float) -> np.ndarray:
    """Rows x (dim + 1): the product with (rotated query, its length) is the
    estimated inner product with the residual plus its error bound."""
    safe = np.maximum(own, 1e-12)
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) * (length / safe / math.sqrt(dim)).astype(np.float32)[:, None]
    spread = eps * length * np.sqrt(np.maximum(1 - own * own, 0)) / safe / math.sqrt(max(dim - 1, 1))
    return np.column_stack([signs, spread.astype(np.float32)])


def _coder(model):
    def run(batches):
        m = model.value
        c, p = m["centroids"], m["rotation"]
        half = 0.5 * (c * c).sum(1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                b = batch.slice(lo, 4096)
                v = b.column(b.schema.get_field_index("embedding"))
                x = np.asarray(v.flatten(), np.float64).reshape(-1, c.shape[1])
                near = np.argmax(x @ c.T - half, axis=1)
                codes, length, own = encode(x, c[near], p)
                yield pa.RecordBatch.from_arrays([
                    pa.array(near, pa.int32()), b.column(b.schema.get_field_index("k1")), b.column(b.schema.get_field_index("k2")),
                    b.column(b.schema.get_field_index("ids")), pa.array([r.tobytes() for r in x], pa.binary()),
                    pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(length), pa.array(own)],
                    ["list", "k1", "k2", "ids", "vector", "code", "length", "own"])
    return run


def _vectors(batch, dim: int) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index("embedding")).flatten(), np.float64).reshape(-1, dim)


def _router(model, bundle_of: np.ndarray):
    """The bundles a query visits.  A query without ``home`` (-1) goes to the list
    with the best bound, any other to the bundles where some other list's bound
    reaches ``need``."""
    def run(batches):
        m = model.value
        c, radius = m["centroids"], m["radius"]
        bundles = int(bundle_of.max()) + 1
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                x = _vectors(b, c.shape[1])
                bound = x @ c.T + np.sqrt((x * x).sum(1))[:, None] * radius[None, :]
                home, need = np.array(b.column(b.schema.get_field_index("home"))), np.array(b.column(b.schema.get_field_index("need")))
                if (home < 0).all():
                    home = bound.argmax(1)
                    at, go = np.arange(len(x)), bundle_of[home]
                else:
                    visits = bound >= (need - 1e-9 * np.abs(need))[:, None]
                    visits[np.arange(len(x)), home] = False
                    at, ls = np.nonzero(visits)
                    both = np.unique(at * bundles + bundle_of[ls])
                    at, go = both // bundles, both % bundles
                keys = [b.column(b.schema.get_field_index(k)).take(pa.array(at)) for k in ("k1", "k2")]
                raw = pa.array([r.tobytes() for r in x], pa.binary()).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(go, pa.int32()), *keys, raw, pa.array(home[at], pa.int32()), pa.array(need[at])],
                                                 ["bundle", "k1", "k2", "vector", "home", "need"])
    return run


def _searcher(model, k: int, eps: float, first: bool):
    """One block of rows against one block of queries: the best ``k`` rows of
    each query that reach what it needs."""
    def run(key, rows, queries):
        import pandas as pd
        m = model.value
        p, centroids, radius = m["rotation"], m["centroids"], m["radius"]
        dim = p.shape[0]
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(rows) and len(queries):
            x = np.frombuffer(b"".join(rows["vector"]), np.float64).reshape(-1, dim)
            q = np.frombuffer(b"".join(queries["vector"]), np.float64).reshape(-1, dim)
            codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
            of, length, own = rows["list"].to_numpy(), rows["length"].to_numpy(), rows["own"].to_numpy()
            home, need = queries["home"].to_numpy(), queries["need"].to_numpy()
            qlen = np.sqrt((q * q).sum(1))
            rotated = np.column_stack([q @ p.T, qlen]).astype(np.float32)
            for c in np.unique(of):
                xs = np.flatnonzero(of == c)
                middle = q @ centroids[c]
                qs = np.flatnonzero((home == c) if first else (home != c) & (middle + qlen * radius[c] >= need - 1e-9 * np.abs(need)))
                factors = upper_factors(codes[xs], length[xs], own[xs], dim, eps)
                for lo in range(0, len(qs), 512):
                    some = qs[lo: lo + 512]
                    upper = rotated[some] @ factors.T
                    if first:
                        # what k rows reach at least, by their lower bounds
                        low = upper - 2 * qlen[some, None].astype(np.float32) * factors[:, -1]
                        n = min(k, len(xs))
                        cut = np.partition(low, len(xs) - n, axis=1)[:, len(xs) - n]
                    else:
                        cut = (need - middle)[some]
                    slack = 1e-4 * (np.abs(cut) + qlen[some])
                    qi, xi = np.nonzero(upper >= (cut - slack).astype(np.float32)[:, None])
                    qi, xi = some[qi], xs[xi]
                    score = np.einsum("ij,ij->i", q[qi], x[xi])
                    keep = score >= need[qi]
                    parts.append((qi[keep], xi[keep], score[keep]))
        qi, xi, score = (np.concatenate(v) for v in zip(*parts))
        ids = rows["ids"].tolist()
        smallest = np.array([i[0] for i in ids], np.int64)
        order = np.lexsort((smallest[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        qi, xi, score = qi[keep], xi[keep], score[keep]
        return pd.DataFrame({"k1": queries["k1"].to_numpy()[qi], "k2": queries["k2"].to_numpy()[qi], "score": score, "ids": [ids[i] for i in xi]})
    return run


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, embedding array<double>, k1, k2) of the rows that take part; k1 and
    k2 are two hashes of the vector."""
    with_id(with_id(df, id_col), vector_col)
    v = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("embedding", lambda x: x == 0)
    v = v.where(F.col("id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~F.coalesce(bad, F.lit(True)) & ~zero)
    return v.withColumn("embedding", F.transform("embedding", lambda x: x + 0.0)).withColumns(
        {"k1": F.xxhash64(F.lit(1), "embedding"), "k2": F.xxhash64(F.lit(2), "embedding")})


def _bundles(sizes: np.ndarray) -> np.ndarray:
    """The bundle of each list: runs of lists of about BLOCK_ROWS rows."""
    return ((np.cumsum(sizes) - sizes) // BLOCK_ROWS).astype(np.int64)


def _search(coded: DataFrame, asked: DataFrame, sizes: dict[int, int], model, k: int, eps: float, first: bool) -> DataFrame:
    """Rows and the queries routed to their bundles, block against block."""
    spark = coded.sparkSession
    # a bundle each: as many numbers as there are bundles of lists
    visits = {r["bundle"]: r["count"] for r in asked.groupBy("bundle").count().collect()}
    shape = [(b, math.ceil(n / BLOCK_ROWS), math.ceil(visits[b] / BLOCK_QUERIES)) for b, n in sizes.items() if visits.get(b)]
    shape = F.broadcast(spark.createDataFrame(shape or [(-1, 1, 1)], "bundle int, rb int, qb int"))
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rows = coded.join(shape, "bundle").withColumn("r", F.pmod("k1", F.col("rb")).cast("int")).withColumn("q", span("qb")).select(
        "bundle", "r", "q", "list", "ids", "vector", "code", "length", "own")
    ask = asked.join(shape, "bundle").withColumn("q", F.pmod("k2", F.col("qb")).cast("int")).withColumn("r", span("rb")).select(
        "bundle", "r", "q", "k1", "k2", "vector", "home", "need")
    return rows.groupBy("bundle", "r", "q").cogroup(ask.groupBy("bundle", "r", "q")).applyInPandas(
        _searcher(model, k, eps, first), "k1 long, k2 long, score double, ids array<long>")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), F.col("vec_id"))
    return (found.select("k1", "k2", "score", F.explode("ids").alias("vec_id"))
            .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn"))


def nearest(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            list_rows: int = LIST_ROWS, eps: float = EPS, seed: int = 5) -> DataFrame:
    """For each row with ``is_query`` (a condition on ``id``) its ``k`` nearest
    others by inner product: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    v = valid_vectors(df, id_col, vector_col)
    common = v.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not common:
        return empty(spark, "query_id long, rank int, vec_id long, score double")
    dim = common[0]["dim"]
    v = v.where(F.size("embedding") == dim)

    # one row per distinct vector, with its k + 1 smallest ids
    w = Window.partitionBy("k1", "k2").orderBy("id")
    few = v.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1)
    distinct = few.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("embedding").alias("embedding"))
    distinct = stage(distinct.select("k1", "k2", "ids", "embedding"), "ann-distinct")
    asked = stage(v.where(is_query).select("id", "k1", "k2"), "ann-asked")

    take = max(1, min(SAMPLE, (64 << 20) // (8 * dim)))
    sample = np.array([r[0] for r in distinct.orderBy("k1", "k2").limit(take).select("embedding").collect()])
    lists = max(1, min(MOST_LISTS, math.ceil(distinct.count() / list_rows)))
    model = {"centroids": fit_lists(sample, lists, seed), "rotation": rotation(dim, seed + 1)}
    fitted = spark.sparkContext.broadcast(model)
    coded = stage(distinct.mapInArrow(_coder(fitted), "list int, k1 long, k2 long, ids array<long>, vector binary, code binary, length double, own double"), "ann-codes")

    # one row per list, MOST_LISTS at most
    sizes, radius = np.zeros(len(model["centroids"]), np.int64), np.full(len(model["centroids"]), -np.inf)
    for r in coded.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("far")).collect():
        sizes[r["list"]], radius[r["list"]] = r["n"], r["far"]
    bundle_of = _bundles(sizes)
    bundle_rows = {int(b): int(sizes[bundle_of == b].sum()) for b in np.unique(bundle_of)}
    coded = coded.withColumn("bundle", F.element_at(F.lit([int(b) for b in bundle_of]), F.col("list") + 1).cast("int"))
    shared = spark.sparkContext.broadcast(model | {"radius": radius})
    routes = "bundle int, k1 long, k2 long, vector binary, home int, need double"

    vectors = distinct.join(asked.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "embedding")
    start = vectors.withColumns({"home": F.lit(-1), "need": F.lit(float("-inf"))})
    routed = stage(start.mapInArrow(_router(shared, bundle_of), routes), "ann-home")
    near = stage(_top(_search(coded, routed, bundle_rows, shared, k + 1, eps, True), k + 1), "ann-near")
    need = near.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).select(
        "k1", "k2", F.when(F.col("n") > k, F.col("least")).otherwise(float("-inf")).alias("need"))
    again = vectors.join(routed.select("k1", "k2", "home"), ["k1", "k2"]).join(need, ["k1", "k2"], "left").withColumn("need", F.coalesce("need", F.lit(float("-inf"))))
    others = stage(again.select("k1", "k2", "embedding", "home", "need").mapInArrow(_router(shared, bundle_of), routes), "ann-others")
    far = _search(coded, others, bundle_rows, shared, k + 1, eps, False)

    # k + 1 for each distinct query vector, as it may be among its own results
    both = near.select("k1", "k2", "score", F.array("vec_id").alias("ids")).unionByName(far)
    best = stage(_top(both, k + 1), "ann-best")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), F.col("vec_id")))
    out = asked.join(best, ["k1", "k2"]).where("id <> vec_id").withColumn("rank", rank)
    return out.where(F.col("rank") <= k).select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
