"""Splits and captions: first-wins de-duplication, matching, claims, shaping, cut-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each non-empty trimmed key: the first by order. The minimum is taken before the shuffle."""
    others = [c for c in rows.columns if c != key]
    named = rows.withColumn(key, F.trim(key)).where(F.col(key) != "")
    best = named.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("first"))
    return best.select(key, "first.*")


def matched(wanted: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """wanted with found: whether files has its key."""
    return wanted.join(files.select(key).distinct().withColumn("hit", F.lit(True)), key, "left").withColumn("found", F.coalesce("hit", F.lit(False))).drop("hit")


def missing(wanted: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return wanted.join(files.select(key), key, "left_anti")


def claimed_once(rows: DataFrame, file: str, order: str) -> DataFrame:
    """Of the rows that claim one file, the first by order."""
    return first_wins(rows, file, order)


def range_number(value: Column, bounds: list[str], kind: str) -> Column:
    """How many of the ascending bounds (JSON of that type) are at most value, by binary search over one constant array: as
    many comparisons a row as their number has binary digits, and an expression of the same size for any number."""
    if not bounds:
        return F.lit(0)
    known = F.from_json(F.lit(f"[{','.join(bounds)}]"), f"array<{kind}>")

    def halved(range_: Column, _: Column) -> Column:
        low, high = range_["low"], range_["high"]
        middle = F.shiftright(low + high, 1)
        above = F.get(known, middle) <= value
        found = F.struct(F.when(above, middle + 1).otherwise(low).alias("low"), F.when(above, high).otherwise(middle).alias("high"))
        return F.when(low < high, found).otherwise(range_)

    steps = F.array_repeat(F.lit(0), len(bounds).bit_length())
    whole = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(steps, whole, halved, lambda r: r["low"])


def _running(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the running total of value by order, this row included, without a window over all rows in one task.

    Rows are ranged by bounds of a sample, taken once; totals of the ranges, one row each, give the offsets. Both uses of
    the rows put a row into the same range, since its range follows from the bounds alone.
    """
    share = 20_000 / max(1, rows.count())
    place = F.struct(*order)
    sample = rows.select(*order, F.to_json(place).alias("__place")).where(F.rand(17) < share).orderBy(*order).select("__place").collect()  # about 20,000 rows at any size
    n = max(1, min(len(sample) // 50, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    part = range_number(place, [sample[k * len(sample) // n][0] for k in range(1, n)], rows.select(place.alias("p")).schema["p"].dataType.simpleString())
    ranged = rows.withColumn("__part", part).withColumn("__value", value)
    totals = ranged.groupBy("__part").agg(F.sum("__value").alias("__total"))
    # one row a range
    offsets = totals.withColumn("__offset", F.coalesce(F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("__value").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.withColumn("__within", within).join(F.broadcast(offsets.select("__part", "__offset")), "__part")
    return out.withColumn(name, (F.col("__within") + F.col("__offset")).cast("long")).drop("__part", "__value", "__within", "__offset")


def reindexed(rows: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """rows with row_index from 0 by order, gapless; order has no ties."""
    if limit is not None:
        if limit < 1:
            raise ValueError("limit must be at least 1")
        best = rows.orderBy(order).limit(limit)
        return best.withColumn("row_index", (F.row_number().over(Window.orderBy(order)) - 1).cast("long"))
    return _running(rows, [order], F.lit(1), "row_index").withColumn("row_index", F.col("row_index") - 1)


def ordered_list(rows: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """(by, name): the values of each group in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).alias("x"))))
    return rows.groupBy(by).agg(F.transform(pairs, lambda s: s["x"]).alias(name))


def paragraph(rows: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    lists = ordered_list(rows, by, order, value, name)
    return lists.select(by, F.array_join(name, " ").alias(name))


def cut_offs(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, cut_off): running number of sentences, group after group."""
    return _running(rows.groupBy(by).agg(F.count("*").alias("n")), [by], F.col("n"), "cut_off")


def picked(rows: DataFrame, by: str, order: str, pick: Column) -> DataFrame:
    """Of each group, the row at place pick modulo its size, in order."""
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).withColumn("size", F.count("*").over(Window.partitionBy(by)))
    return numbered.where(F.col("place") == F.pmod(pick, F.col("size"))).drop("place", "size")
