"""Connected components of an edge table, distributed.

Each round every vertex hooks to its smallest neighbour if that is smaller than
itself (one map-side combined minimum per vertex, so a hub costs a row per map
task), the pointers are shortened until every vertex points at a root, and the
edges are rewritten between roots.  Only local minima stay as roots, so at
least every second vertex with an edge goes in each round.  Every round starts
from tables written to the shared folder; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stage


def _flatten(parent: DataFrame) -> DataFrame:
    """Pointer jumping: (v, p) until every p is a root."""
    while True:
        up = parent.select(F.col("v").alias("_u"), F.col("p").alias("_pp"))
        nxt = stage(parent.join(up, F.col("p") == F.col("_u"), "left").select(
            "v", F.coalesce("_pp", "p").alias("p"), F.col("_pp").isNotNull().alias("moved")), "cc-jump")
        moved = nxt.where("moved").limit(1).count()
        parent = nxt.select("v", "p")
        if not moved:
            return parent


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long), in either direction, repeats allowed; rows
    with a null end or u = v say nothing.  Returns (v, comp) for every vertex
    of an edge whose component's smallest vertex is another; all others are
    their own component."""
    edges = stage(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                  .where("u IS NOT NULL AND v IS NOT NULL AND u < v").distinct(), "cc-edges")
    label = None
    while edges.limit(1).count():
        # u < v in every row, so a vertex has a smaller neighbour only in the role v
        parent = _flatten(stage(edges.groupBy("v").agg(F.min("u").alias("p")), "cc-hook"))
        up_u = parent.select(F.col("v").alias("_x"), F.col("p").alias("_pu"))
        up_v = parent.select(F.col("v").alias("_y"), F.col("p").alias("_pv"))
        if label is None:
            label = parent
        else:
            moved = label.join(up_u, F.col("p") == F.col("_x"), "left").select("v", F.coalesce("_pu", "p").alias("p"))
            label = stage(moved.unionByName(parent.join(label.select("v"), "v", "left_anti")), "cc-label")
        half = edges.join(up_u, F.col("u") == F.col("_x"), "left").select(F.coalesce("_pu", "u").alias("u"), "v")
        both = half.join(up_v, F.col("v") == F.col("_y"), "left").select("u", F.coalesce("_pv", "v").alias("v"))
        edges = stage(both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                      .where("u < v").distinct(), "cc-edges")
    if label is None:
        return edges.select("v", F.col("u").alias("comp"))
    return label.select("v", F.col("p").alias("comp"))
