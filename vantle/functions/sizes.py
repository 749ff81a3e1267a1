"""Storage sizes: budgets, readable byte counts, capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantle.functions.vectors import bytes_per_vector

#: Bytes of each unit, decimal and binary; the units of readable sizes.
UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40}
READABLE = ("B", "KiB", "MiB", "GiB", "TiB")
#: Bytes of the header of a .npy file of an ordinary shape.
NPY_HEADER = 128
#: Bytes of a component of a vector file.
ITEM_BYTES = {"float32": 4, "float16": 2, "int8": 1, "binary": 1, "bool": 1, "float64": 8}
#: Fixed value: a size is a number and, in any case, a unit.
BUDGET = r"^\s*([0-9]*\.?[0-9]+)\s*([a-zA-Z]*)\s*$"


def _budget(text: Column) -> tuple[Column, Column, Column]:
    """Whether text is a size, bytes of its unit, and bytes in all; the unit is null where it is unknown."""
    factors = F.create_map(*(F.lit(x) for name, n in UNITS.items() for x in (name, float(n))))
    unit = F.try_element_at(factors, F.lower(F.regexp_extract(text, BUDGET, 2)))
    return text.rlike(BUDGET), unit, F.floor(F.regexp_extract(text, BUDGET, 1).try_cast("double") * unit).cast("long")


def parse_budget(text: Column) -> Column:
    """Bytes of "2 GiB" and the like; null where the text is no number with a known unit, or below 1 byte."""
    total = _budget(text)[2]
    return F.when(total >= 1, total)


def checked_budget(text: Column) -> Column:
    """parse_budget that fails, with the reason, where that gives null."""
    is_number, size, total = _budget(text)
    quoted = F.concat(F.lit("'"), F.coalesce(text, F.lit("")), F.lit("'"))
    fail = lambda why: F.raise_error(F.concat(F.lit(why), quoted)).cast("long")
    return F.when(~F.coalesce(is_number, F.lit(False)), fail("no size: ")).when(size.isNull(), fail("unknown unit in ")).when(total < 1, fail("less than one byte: ")).otherwise(total)


def readable(size: Column) -> Column:
    """Two decimals and the largest binary unit that leaves at least 1; terabytes beyond."""
    out = F.concat(F.format_string("%.2f", F.bround(size.cast("double"), 2)), F.lit(" B"))
    for i, unit in enumerate(READABLE):
        if i:
            out = F.when(F.abs(size) >= 1024**i, F.concat(F.format_string("%.2f", F.bround(size / float(1024**i), 2)), F.lit(f" {unit}"))).otherwise(out)
    return out


def npy_bytes(count: Column, dimension: Column, item: int) -> Column:
    return (count * dimension * item + NPY_HEADER).cast("long")


def estimated(counts: DataFrame, dimension: int = 512, kind: str = "float32") -> DataFrame:
    """Of each count (column count): raw bytes of its vectors and bytes of their file."""
    if dimension < 1:
        raise ValueError("dimension must be at least 1")
    n = F.when(F.col("count") >= 1, F.col("count")).otherwise(F.raise_error(F.lit("count must be at least 1")).cast("long"))
    size, file = n * dimension * ITEM_BYTES[kind], npy_bytes(n, F.lit(dimension), ITEM_BYTES[kind])
    return counts.select("count", F.lit(dimension).alias("dimension"), F.lit(kind).alias("dtype"), size.cast("long").alias("raw_vector_bytes"), file.alias("estimated_npy_bytes"), readable(file).alias("human_npy_size"))


def capacity(budget: Column, vector_bytes: Column, metadata: Column) -> Column:
    """Items that a budget holds."""
    return F.floor(budget / (vector_bytes + metadata)).cast("long")


def capacity_report(packings: DataFrame, budget: Column, metadata: Column, dimension: int = 512) -> DataFrame:
    """Of each packing (column packing, others stay): bytes an item, items that the budget holds, bytes of 1000 and 2000 items, and
    what share of the budget, in percent, 2000 items take."""
    each = bytes_per_vector(F.lit(dimension), F.col("packing")) + metadata
    for_n = lambda n: F.bround(each * n).cast("long").alias(f"bytes_for_{n}")
    known = F.when(budget >= 1, budget).otherwise(F.raise_error(F.lit("the budget must be at least one byte")).cast("long"))
    most = F.floor(known / each).cast("long")
    return packings.select(
        "*", each.cast("double").alias("bytes_per_item"), most.alias("max_items"), F.format_number(most, 0).alias("max_items_human"), for_n(1000), for_n(2000), (each * 2000 / budget * 100).cast("double").alias("percent_of_budget_at_2000")
    )
