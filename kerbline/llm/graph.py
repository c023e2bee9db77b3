"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread_join

#: Rounds are logarithmic in the longest path; so many are never needed.
ROUNDS = 99


def _large(e: DataFrame, n: int, scratch: Scratch, name: str) -> DataFrame:
    """Every larger neighbour of u moves to the smallest node next to u. A node with very many neighbours is the hub
    of a star; its edges are dealt over several tasks."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), name)
    return spread_join(both.where("v > u"), low.select("u", "m"), ["u"], low, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """u and its smaller neighbours move to the smallest of them. Edges come in as u > v; the largest node of a star
    may have very many, which are dealt over several tasks."""
    low = scratch.save(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), name)
    moved = spread_join(e, low.select("u", "m"), ["u"], low, low.agg(F.sum("n")).first()[0] or 0).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "edges") -> DataFrame:
    """edges(u, v), any order, loops allowed -> (node, component): component is the smallest node reachable.

    Nodes without an edge to another node are left out. Each round is two joins on a node with its aggregated
    minimum; minima are combined before the shuffle, and a hub's edges are dealt over several tasks. Rounds grow with
    the logarithm of the longest path; it is over when the edges are the same set as before (number and 128 bits of
    hashes), and after ROUNDS that aren't it raises.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.save(e, f"{name}-0")
    seen = None
    for k in range(1, ROUNDS + 1):
        stats = tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())
        if stats[0] == 0 or stats == seen:
            break
        seen = stats
        large = scratch.save(_large(e, stats[0], scratch, f"{name}-low-{k}"), f"{name}-large-{k}")
        e = scratch.save(_small(large, scratch, f"{name}-least-{k}"), f"{name}-{k}")
        for done in ("low", "large", "least"):
            scratch.drop(f"{name}-{done}-{k}")
        if k > 1:
            scratch.drop(f"{name}-{k - 2}")
    else:
        raise RuntimeError(f"components of {name} after {ROUNDS} rounds still change")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
