"""Build lifecycle: pending items, status, projections, truncation and padding of sequences, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.select(key), key, "left_anti")


def status(rows: DataFrame) -> DataFrame:
    """items, completed, failed, status, from boolean columns completed and failed."""
    n, done = F.count("*"), F.count_if("completed")
    return rows.agg(n.alias("items"), done.alias("completed"), F.count_if("failed").alias("failed"), F.when(n == done, "complete").otherwise("partial").alias("status"))


def projections(work: DataFrame, targets: tuple[int, ...] = (1000, 2000)) -> DataFrame:
    """Throughput of (items, frames, seconds), and the seconds that more items would take."""
    more = [(F.lit(n) * F.col("seconds") / F.col("items")).alias(f"seconds_{n}") for n in targets]
    return work.select("items", "frames", "seconds", (F.col("items") / F.col("seconds")).alias("items_per_second"), *more)


def _placed(rows: DataFrame, by: str, order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("long") - 1
    return rows.withColumn("pos", place).withColumn("n", F.count("*").over(Window.partitionBy(by)))


def truncated(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """rows under each rule that keeps at most so many of a group: head, tail, uniform (column rule)."""
    p, n = F.col("pos"), F.col("n")
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.when((i == most - 1) & F.lit(most > 1), n - 1).otherwise(F.floor(i * ((n - 1) / F.lit(float(max(most - 1, 1)))))))
    rules = F.array(F.when(p < most, "head"), F.when(p >= n - most, "tail"), F.when((n <= most) | F.array_contains(even, p), "uniform"))
    return _placed(rows, by, order).withColumn("rule", F.explode(F.array_compact(rules))).select("rule", by, order)


def frame_order(rows: DataFrame, by: str, order: str, kind: str, seed: int = 0) -> DataFrame:
    """rows with pos in the same, reverse or a seeded random order of each group."""
    if kind == "random":
        place = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(F.col(by), F.col(order), F.lit(seed)), order)).cast("long") - 1
        return rows.withColumn("pos", place)
    placed = _placed(rows, by, order)
    return placed.select(by, order, (F.col("n") - 1 - F.col("pos") if kind == "reverse" else F.col("pos")).alias("pos"))


def padded_positions(rows: DataFrame, by: str, value: str, most: int, order: str | None = None) -> DataFrame:
    """For each group, positions 0 to most - 1 with the value there by order (the value's own, unless told) or null, and
    a mask."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order or value).alias("at"), F.col(value).alias("x"))))
    out = rows.groupBy(by).agg(F.transform(F.slice(pairs, 1, most), lambda s: s["x"]).alias("all"))
    out = out.select(by, F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pos"), "all")
    there = (F.col("pos") < F.size("all")).cast("long")
    return out.select(by, F.col("pos").cast("long").alias("pos"), F.get("all", F.col("pos")).alias(value), there.alias("mask"))


def learning_rate(kind: str, x: Column, warmup: float) -> Column:
    """Factor at progress x from 0 to 1: linear warm-up, then cosine, constant or linear decay."""
    after = {"cosine": 0.5 * (1 + F.cos(F.lit(math.pi) * x)), "constant": F.lit(1.0), "linear": F.greatest((x - 1) / F.lit(warmup - 1), F.lit(0.0))}[kind]
    return F.when(x < warmup, x / warmup).otherwise(after)
