"""Connected components of an edge table by alternating large-star and small-star steps, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantle.llm.common import dropped, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b); component is the smallest node reachable.

    Loops and nulls are ignored. Every step takes a minimum per node before it joins, so that a node with many
    neighbours is pre-aggregated and its join side can be split; each step's edges are written to the shared folder. The last
    ones, which the result reads, go with dropped(result).
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = _state(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        last, now = now, written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(last)
        after = _state(now)
        if after == before:
            break
        before = after
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct()).distinct()
    out.written_path = now.written_path
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v") % 1_000_003)).first())
