"""Bounded graph traversal by unrolled joins.

Trails may repeat nodes but no edge; the depth is at most ten, so the plan is unrolled and every hop is one equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sorrel.functions.scalars import clamp_depth
from sorrel.plans.runtime import cut, is_empty


def trails(edges: DataFrame, starts: DataFrame | None, depth: int) -> DataFrame:
    """``edges``: edge_key, src, dst; ``starts``: start. start, node, depth of each trail of 1 to ``depth`` edges, distinct."""
    e = edges.select("edge_key", "src", "dst")
    front = e.join(starts.select(F.col("start").alias("src")), "src", "left_semi") if starts is not None else e
    front = front.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("edge_key").alias("used"))
    out = front.select("start", "node", F.lit(1).alias("depth")).distinct()
    hop = e.select(F.col("edge_key").alias("k"), F.col("src").alias("node"), "dst")
    for d in range(2, clamp_depth(depth) + 1):
        front = front.join(hop, "node").where(~F.array_contains("used", F.col("k"))).select("start", F.col("dst").alias("node"), F.concat("used", F.array("k")).alias("used"))
        out = out.unionAll(front.select("start", "node", F.lit(d).alias("depth")).distinct())
    return out


def shortest_paths(edges: DataFrame, pairs: DataFrame | None, depth: int) -> DataFrame:
    """start, node, depth, path: one shortest path for each pair within ``depth``; among equals the smallest node sequence.

    Layer by layer, nodes already reached leave the frontier, and so do starts whose pairs are all found; a pair of equal ends
    has no path.
    """
    e = edges.select("src", "dst").where("src <> dst").distinct()
    starts = pairs.select("start").distinct() if pairs is not None else e.select(F.col("src").alias("start")).distinct()
    seen = starts.select("start", F.col("start").alias("node"), F.array("start").alias("path"), F.lit(0).alias("depth"))
    front = seen = cut(seen)
    for d in range(1, clamp_depth(depth) + 1):
        nxt = front.join(e.withColumnRenamed("src", "node"), "node").select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        nxt = nxt.join(seen.select("start", "node"), ["start", "node"], "left_anti").groupBy("start", "node").agg(F.min("path").alias("path"))
        front = cut(nxt.withColumn("depth", F.lit(d)))
        if is_empty(front):
            break
        seen = seen.unionAll(front)
        if pairs is not None:
            missing = cut(pairs.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start").distinct())
            if is_empty(missing):
                break
            front = front.join(missing, "start", "left_semi")
    out = seen.where("depth > 0")
    return out.join(pairs, ["start", "node"], "left_semi") if pairs is not None else out


def unreferenced(symbols: DataFrame, targets: DataFrame, key: str = "key") -> DataFrame:
    """Symbols that no row of ``targets`` (column target_key) names."""
    return symbols.join(targets.select(F.col("target_key").alias(key)), key, "left_anti")
