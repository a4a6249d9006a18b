"""Consolidating pairwise matches into groups (problem 1).

Seed-tree pruning.  Every round, each vertex links itself and its neighbours to the minimum of its
neighbourhood; a vertex that is nobody's minimum drops out of the graph and hangs below the minimum
it saw, in a propagation forest.  Only minima stay, so the graph shrinks geometrically.  When no edge
is left, the seed of each tree (the smallest id of its group) flows down the forest, last dropped
vertices first.

Per round two aggregations (with partial aggregation, so hubs are reduced before the shuffle) and two
equi-joins, whose hot keys adaptive execution splits.  No vertex's neighbours are ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.tables import Scratch


def connected_groups(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """``pairs`` (columns ``a`` and ``b``, any orderable type) to (id, group_id), distinct ids.

    group_id is the smallest id of the group.  Pairs with a null end are ignored, as are loops (an id
    that occurs only in loops or with null ends does not come out); repeated pairs and both directions
    count once.  An empty input gives an empty result.  Other columns of ``pairs`` are ignored,
    whatever their names.
    """
    scratch = Scratch(pairs.sparkSession)
    ends = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    ends = ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges, path = scratch.cut(ends)
    forest: list[DataFrame] = []
    while not edges.isEmpty():
        if len(forest) == max_rounds:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
        both = edges.union(edges.select("v", "u"))
        minima = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        # every vertex points to the minimum of each neighbourhood it is in
        points = (
            both.join(minima, "u").select(F.col("v").alias("s"), "m").union(minima.select("u", "m")).distinct()
        )
        points, points_path = scratch.cut(points)
        least = points.groupBy("s").agg(F.min("m").alias("p"), F.max(F.col("m") == F.col("s")).alias("stays"))
        dropped, _ = scratch.cut(least.where("not stays").select("s", "p"))
        forest.append(dropped)
        kept = points.join(least.select("s", "p"), "s").where("m <> p")
        kept = kept.select(F.least("m", "p").alias("u"), F.greatest("m", "p").alias("v")).distinct()
        edges, next_path = scratch.cut(kept)
        scratch.drop(path)
        scratch.drop(points_path)
        path = next_path
    schema = ends.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    if not forest:
        return schema.limit(0)
    labels: DataFrame | None = None
    for k, level in enumerate(reversed(forest)):
        if labels is None:
            here = level.select(F.col("s").alias("id"), F.col("p").alias("group_id"))
        else:
            known = labels.select(F.col("id").alias("p"), "group_id")
            here = level.join(known, "p", "left").select(
                F.col("s").alias("id"), F.coalesce("group_id", "p").alias("group_id")
            )
        labels = here if labels is None else labels.union(here)
        if k and k < len(forest) - 1:
            labels, _ = scratch.cut(labels)
    seeds = labels.select("group_id").distinct().select(F.col("group_id").alias("id"), "group_id")
    return labels.union(seeds)
