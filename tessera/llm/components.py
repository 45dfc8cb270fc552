"""Connected components of a graph of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch

ROUNDS = 50


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for each node of links(a, b): the smallest node reachable.

    Each round hangs every node below the smallest node that it knows of, so chains
    shorten by half or more; each round's links are a table in the shared folder. Loops
    are dropped, repeated links count once, and no links give no rows.
    """
    at = scratch.keep(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"
    )
    state = _fingerprint(at)
    for i in range(1, ROUNDS):
        if not state[0]:
            break
        both = at.union(at.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # Every larger neighbour of u goes below the least of u and its neighbours.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Then every smaller neighbour of a node, and the node itself, below the least one.
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        after = scratch.keep(small.where("a <> b").distinct(), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        at, before, state = after, state, _fingerprint(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    roots = at.select("b").distinct()
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select(F.col("b").alias("node"), F.col("b").alias("component"))
    )


def _fingerprint(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
