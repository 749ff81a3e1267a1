"""Frame, clip and group-of-pictures arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spread_places(n: Column, most: Column) -> Column:
    """Of n places, at most so many, evenly spaced, the first and last among them; one is the first."""
    step = (n - 1) / F.greatest(most - 1, F.lit(1))
    place = lambda i: F.when(n <= most, i).when((i == most - 1) & (most > 1), n - 1).otherwise(F.floor(i * step).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.least(n, most) - 1), place)


def sampled_frames(count: Column, fps: Column, rate: Column, most: Column) -> Column:
    """Indices of frames at a fixed rate: every max(fps / rate, 1)-th, floored, then spread to most. A step is 1 at least, so
    no index comes twice."""
    step = F.greatest(fps.cast("double") / rate, F.lit(1.0))
    places = spread_places(F.ceil(count / step).cast("int"), most.cast("int"))
    picked = F.transform(places, lambda i: F.least(F.floor(i * step).cast("long"), count - 1))
    return F.when(count <= 0, F.array().cast("array<bigint>")).otherwise(picked)


def per_second_frames(count: Column, fps: Column, rate: Column, start: Column, end: Column) -> Column:
    """Indices of rate frames of each second from start to end, both included, before the clip's last frame; none where
    the bounds are out of order or a number isn't positive."""
    safe = F.greatest(rate, F.lit(1))
    step = F.greatest(F.floor(fps / safe).cast("int"), F.lit(1))
    last = F.least(F.ceil(F.lit(1.0) * fps / step).cast("int"), safe) - 1
    within = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: i * step)
    until = F.least(end, F.ceil(count / fps).cast("int"))
    each = F.flatten(F.transform(F.sequence(start, F.greatest(until, start)), lambda s: F.transform(within, lambda o: (s * fps + o).cast("long"))))
    good = (until >= start) & (rate >= 1) & (fps > 0) & (count > 0)
    return F.when(good, F.filter(each, lambda i: i < count)).otherwise(F.expr("cast(array() as array<bigint>)"))


def clip_bounds(start: Column, end: Column) -> tuple[Column, Column]:
    """Bounds made sane: at least 0, in order, and a second apart where they are equal."""
    a, b = F.greatest(start, F.lit(0)), F.greatest(end, F.lit(0))
    low, high = F.least(a, b), F.greatest(a, b)
    return low, F.when(low == high, high + 1).otherwise(high)


def gop_count(frames: Column, size: int) -> Column:
    return F.when(frames > 0, F.ceil(frames / size)).otherwise(0).cast("long")


def gop_length(frames: Column, size: int, number: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(size), frames - number * size)).cast("long")


def key_positions(length: Column) -> Column:
    """The place of a group's whole frame: its first; none in an empty group."""
    return F.when(length > 0, F.array(F.lit(0))).otherwise(F.expr("cast(array() as array<int>)"))


def delta_positions(length: Column, wanted: int) -> Column:
    """Positions of so many delta frames of a group, evenly over 1 to its last; all where there are fewer."""
    n, none = length.cast("int") - 1, F.expr("cast(array() as array<int>)")
    if wanted < 1:
        return none
    if wanted == 1:
        picked = F.array(F.lit(1))
    else:
        place = lambda i: F.when(i == wanted - 1, n).otherwise(1 + F.floor(i * ((n - 1) / F.lit(float(wanted - 1)))).cast("int"))
        picked = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), place)
    return F.when(n < 1, none).when(n <= wanted, F.sequence(F.lit(1), n)).otherwise(picked)


def resized(height: Column, width: Column, target: int) -> tuple[Column, Column]:
    """Sizes with the short edge at target, the other rounded half to even."""
    scale = F.lit(float(target)) / F.least(height, width)
    size = lambda x: F.greatest(F.lit(target), F.rint(x * scale).cast("int")).cast("long")
    return size(height), size(width)


def crop_offset(size: Column, target: int) -> Column:
    return F.floor((size - target) / 2).cast("long")


def pixels(values: Column, mean: Column, std: Column) -> Column:
    """Bytes of one channel as numbers from 0 to 1, less the mean, over the deviation."""
    return F.transform(values, lambda x: (x / F.lit(255.0) - mean) / std)
