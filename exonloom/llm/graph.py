"""Connected components of an undirected graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from exonloom.session import cut_lineage


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """``edges`` stored, with their number and a hash of all of them; both are counted while they are written."""
    seen = Observation()
    hashed = F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))
    out = cut_lineage(edges.observe(seen, F.count(F.lit(1)).alias("n"), hashed.alias("h")))
    return out, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the component is its least node.

    Every round lets each node hand its least neighbour to its larger neighbours, then to its smaller
    ones, so a round needs two joins on the node, and the number of rounds grows with the logarithm of
    the longest path.  Each round is written to the shared checkpoint folder: a lost executor costs a
    read.  Nulls, loops and repeated edges are dropped first; without edges the result is empty.
    """
    now, before = _stored(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    for _ in range(most_rounds if before[0] else 0):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, after = _stored(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return now.groupBy("v").agg(F.max("u").alias("_")).select(F.col("v").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    )


def extended(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """The components under further ``edges(u, v)`` of nodes whose components so far are ``groups(node, component)``.

    Every edge is moved to the components of its ends first, so that only what joins components takes rounds.
    """
    of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}c"))
    ends = edges.join(of("u"), "u", "left").join(of("v"), "v", "left")
    found = cut_lineage(components(ends.select(F.coalesce("uc", "u").alias("u"), F.coalesce("vc", "v").alias("v"))))
    fresh = found.join(groups, "node", "left_anti").select("node", F.col("node").alias("component"))
    renamed = found.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return groups.union(fresh).join(renamed, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
