"""Sharding by a minimax contiguous partition of atomic groups, natively.

Groups are the rows of equal text, in the order of a 63-bit hash of the text. The smallest feasible shard capacity is
binary-searched, each capacity checked greedily, and the order is cut there. The check runs on sums of bytes by blocks
of the order, at most a fixed number of them: blocks that may hold a cut for a capacity still in question are split
further by one aggregation, until the greedy cuts of the capacity are exact. Greedy filling leaves what is missing to the
last shard; a cut moves forward to an even share of what is left wherever the rest still fits the capacity. A group that
alone is larger than such a share is a shard by itself, and comes first, so that it raises no other shard's capacity.
All work on rows is DataFrame functions; a shard follows from the hash and the cuts alone.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantle.llm.common import sized, written

SHARDS = 40
#: Bytes a row counts for besides its text.
ROW_BYTES = 16
KEY_BITS = 63
#: Blocks of the order at first, and at most about so many more from one aggregation, as powers of two.
FIRST_BITS, MORE_BITS = 14, 16


class Block(NamedTuple):
    """Neighbouring groups: keys that share their first bits. A single key can't be cut."""

    first: int
    bits: int
    bytes: int
    single: bool


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key and row of every row; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )


def _sums(rows: DataFrame, bits: int) -> DataFrame:
    prefix = F.shiftright("key", KEY_BITS - bits)
    return rows.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("bytes"), (F.min("key") == F.max("key")).alias("single")).select(F.lit(bits).alias("bits"), "*")


def _blocks(sums: DataFrame) -> list[Block]:
    return [Block(r["prefix"] << (KEY_BITS - r["bits"]), r["bits"], r["bytes"], r["single"]) for r in sums.collect()]


def _split(rows: DataFrame, blocks: list[Block], unsure: list[Block]) -> list[Block]:
    """blocks with the unsure ones in smaller pieces."""
    finer = max(2, MORE_BITS - len(unsure).bit_length())
    parts = []
    for bits in sorted({b.bits for b in unsure}):
        prefixes = [b.first >> (KEY_BITS - bits) for b in unsure if b.bits == bits]
        parts.append(_sums(rows.where(F.shiftright("key", KEY_BITS - bits).isin(prefixes)), min(KEY_BITS, bits + finer)))
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.unionByName(part)
    gone = set(unsure)
    return sorted([b for b in blocks if b not in gone] + _blocks(sums))


def alone(blocks: list[Block], shards: int) -> list[Block]:
    """Single groups that are larger than an even share of what is left beside those before."""
    left, found = sum(b.bytes for b in blocks), []
    for b in sorted((b for b in blocks if b.single), key=lambda b: (-b.bytes, b.first)):
        if b.bytes * (shards - len(found)) <= left:
            break
        found.append(b)
        left -= b.bytes
    return found


def greedy(ends: list[int], blocks: list[Block], shards: int, capacity: int, inside: bool, at: int = 0) -> list[int]:
    """Where shards filled one after the other end, at most so many. inside: blocks of several groups may be cut anywhere,
    which no true partition betters; else none is cut, which a true partition can always do."""
    out = []
    for _ in range(shards):
        if at >= ends[-1]:
            break
        full = at + capacity
        k = bisect_right(ends, full) - 1
        cut = full if inside and k < len(blocks) and not blocks[k].single else ends[k]
        at = max(at, min(cut, ends[-1]))
        out.append(at)
    return out


def least(ends: list[int], blocks: list[Block], shards: int, inside: bool, low: int) -> int:
    """The smallest capacity, low at least, with which the shards hold everything."""
    high = max(low, ends[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy(ends, blocks, shards, middle, inside)[-1:] == [ends[-1]]:
            high = middle
        else:
            low = middle + 1
    return low


def even(ends: list[int], blocks: list[Block], shards: int, capacity: int) -> list[int]:
    """Ends of the shards: each the first of an even share of what is left, where the rest then fits the capacity."""
    at, out = 0, []
    for left in range(shards - 1, 0, -1):
        share = at + (ends[-1] - at) / (left + 1)
        most = bisect_right(ends, at + capacity) - 1
        low = bisect_right(ends, share) - 1
        low += low < most and ends[low + 1] - share < share - ends[low]
        high = max(low, most)
        while low < high:
            middle = (low + high) // 2
            if greedy(ends, blocks, left, capacity, False, ends[middle])[-1:] in ([], [ends[-1]]):
                high = middle
            else:
                low = middle + 1
        at = ends[low]
        out.append(at)
    return out


def partition(rows: DataFrame, shards: int) -> tuple[list[int], list[int], int]:
    """Keys of groups that are shards by themselves, first keys of the other shards but the first, and the capacity."""
    blocks = sorted(_blocks(_sums(rows, FIRST_BITS)))
    while blocks:
        own = alone(blocks, shards)
        rest, n = sorted(set(blocks) - set(own)), shards - len(own)
        ends = [0, *accumulate(b.bytes for b in rest)]
        unsure = [b for b in rest if not b.single and b.bytes * n > ends[-1]]
        if not unsure:
            low = least(ends, rest, n, True, -(-ends[-1] // n))
            high = least(ends, rest, n, False, low)
            nearest, farthest = greedy(ends, rest, n, low, False), greedy(ends, rest, n, high, True)
            farthest += [ends[-1]] * (len(nearest) - len(farthest))
            between = {k for a, z in zip(nearest, farthest) for k in range(bisect_right(ends, a) - 1, min(len(rest), bisect_right(ends, z))) if ends[k] < z}
            unsure = [rest[k] for k in sorted(between) if not rest[k].single]
            if not unsure:
                cuts = [rest[bisect_right(ends, a) - 1].first for a in even(ends, rest, n, high) if a < ends[-1]]
                return [b.first if b.bits == KEY_BITS else _key(rows, b) for b in sorted(own)], cuts, high
        blocks = _split(rows, blocks, unsure)
    return [], [], 0


def _key(rows: DataFrame, block: Block) -> int:
    """The one key of a single block."""
    return rows.where(F.shiftright("key", KEY_BITS - block.bits) == block.first >> (KEY_BITS - block.bits)).agg(F.min("key")).first()[0]


def _place(key: Column, cuts: list[int], first: int) -> Column:
    """first + the number of cuts at or below key, by halving."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    return F.when(key < cuts[middle], _place(key, cuts[:middle], first)).otherwise(_place(key, cuts[middle + 1 :], first + middle + 1))


def numbered(placed: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard, in the order of row. Rows are counted by the task that wrote them, and the
    counts before are summed in two levels, so that no window holds a shard's rows."""
    placed = placed.withColumn("part", F.shiftright("row", 33))
    cells = written(placed.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("block", F.shiftright("part", 10)), "cells")
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = cells.groupBy("shard", "block").agg(F.sum("n").alias("n")).select("shard", "block", before("shard", "block").alias("wide"))
    near = cells.select("shard", "block", "part", before("shard", "block", "part").alias("near"))
    starts = written(near.join(wide, ["shard", "block"]).select("shard", "part", (F.col("near") + F.col("wide")).alias("start")), "starts")
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    return placed.withColumn("own", own).join(sized(starts), ["shard", "part"]).withColumn("slot", F.col("start") + F.col("own") - 1)


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs.

    All rows of one text share a shard; null and empty texts are one group. Every row is placed, also with a null or
    repeated id. With fewer groups than shards the last shards stay empty. The largest shard is as small as the order
    allows, but for groups that are larger alone. Only doc_id and text are read. An empty table gives an empty one.
    """
    rows = written(keyed(docs), "keyed")
    own, cuts, _ = partition(rows, shards)
    key = F.col("key")
    shard = _place(key, cuts, len(own))
    if own:
        shard = F.coalesce(*(F.when(key == k, F.lit(i)) for i, k in enumerate(own)), shard)
    out = numbered(rows.withColumn("shard", shard.cast("int")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
