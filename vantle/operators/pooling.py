"""From frames to one vector: means over positions, with masks and over modalities.

Sums of whole vectors are made in the tasks that read the frames, so one row a group and task is shuffled, whatever the
vectors' dimension; the sums meet in one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vantle.functions.vectors import normalized

#: Components of the sums that a task holds before it sends them on.
HELD = 4 << 20


def vector_sums(frames: DataFrame, by: str, vector: Column, weight: Column | None = None) -> DataFrame:
    """(by, sums, weight): each group's weighted sum of its vectors, and the sum of the weights (1 unless given).

    Null vectors count for nothing, null weights as 0; a null key is a group. Vectors of one group must be of one length
    and without null components.
    """
    kind = frames.schema[by].dataType
    rows = frames.select(F.col(by).alias("by"), vector.cast("array<double>").alias("vector"), F.coalesce((F.lit(1.0) if weight is None else weight).cast("double"), F.lit(0.0)).alias("weight"))

    def out_of(held: dict) -> pa.RecordBatch:
        keys, sums, weights = held.keys(), [v for v, _ in held.values()], [w for _, w in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(keys, to_arrow_type(kind)), pa.array([v.tolist() for v in sums], pa.list_(pa.float64())), pa.array(weights, pa.float64())], names=["by", "sums", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            keys, vectors, weights = batch.column(0).dictionary_encode(null_encoding="encode"), batch.column(1), batch.column(2).to_numpy()
            here = ~vectors.is_null().to_numpy(zero_copy_only=False)
            lengths, flat = vectors.value_lengths().fill_null(-1).to_numpy(), vectors.flatten()
            if flat.null_count:
                raise ValueError("vectors hold null components")
            codes, values = keys.indices.to_numpy(), flat.to_numpy()
            starts = np.cumsum(np.where(here, lengths, 0)) - np.where(here, lengths, 0)
            for code in np.unique(codes[here]):
                own = np.flatnonzero(here & (codes == code)) if len(keys.dictionary) > 1 else np.flatnonzero(here)
                n = lengths[own[0]]
                if (lengths[own] != n).any():
                    raise ValueError("vectors differ in length")
                matrix = values[starts[own][:, None] + np.arange(n)]
                total, w = weights[own] @ matrix, weights[own].sum()
                key = keys.dictionary[int(code)].as_py()
                before = held.get(key)
                if before is not None and len(before[0]) != n:
                    raise ValueError("vectors differ in length")
                held[key] = (total, w) if before is None else (before[0] + total, before[1] + w)
            if sum(len(v) for v, _ in held.values()) > HELD:
                yield out_of(held)
                held = {}
        if held:
            yield out_of(held)

    part = f"by {kind.simpleString()}, sums array<double>, weight double"
    sums = rows.mapInArrow(run, part).groupBy("by").agg(F.collect_list("sums").alias("all"), F.sum("weight").alias("weight"))
    unlike = F.raise_error(F.lit("vectors differ in length")).cast("array<double>")
    add = lambda x, y: F.when(F.size(x) != F.size(y), unlike).otherwise(F.zip_with(x, y, lambda p, q: p + q))
    total = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), add)
    return sums.select(F.col("by").alias(by), total.alias("sums"), "weight")


def _mean() -> Column:
    """Sums over weights, or over 1 if these sum to 0."""
    return F.transform("sums", lambda x: x / F.when(F.col("weight") == 0, 1.0).otherwise(F.col("weight")))


def mean_vector(frames: DataFrame, by: str, vector: Column) -> DataFrame:
    """(by, vector): the mean of each group's vectors."""
    return vector_sums(frames, by, vector).select(by, _mean().alias("vector"))


def mean_pool(frames: DataFrame, by: str, column: str = "embedding") -> DataFrame:
    """(by, vector): frames normalized, averaged, normalized."""
    return mean_vector(frames, by, normalized(column)).select(by, normalized("vector").alias("vector"))


def masked_mean(frames: DataFrame, by: str, mask: Column, column: str = "embedding") -> DataFrame:
    """(by, vector): sums over frames with a mask of 1, over their number, or over 1 if there is none."""
    return vector_sums(frames, by, F.col(column), mask).select(by, _mean().alias("vector"))


def masked_text_mean(tokens: DataFrame, by: str, order: str, mask: Column, column: str = "embedding") -> DataFrame:
    """masked_mean without the first token of each group by order, which marks the start."""
    first = tokens.groupBy(by).agg(F.min(order).alias("__first"))
    rest = tokens.join(first, by).withColumn("__mask", F.when(F.col(order) == F.col("__first"), 0.0).otherwise(mask))
    return masked_mean(rest, by, F.col("__mask"), column)


def fused(modalities: list[DataFrame], by: str, column: str = "embedding") -> DataFrame:
    """(by, vector): one masked mean over the modalities' sequences laid end to end (columns by, column, mask)."""
    return masked_mean(reduce(DataFrame.unionByName, [m.select(by, column, "mask") for m in modalities]), by, F.col("mask"), column)


def pooled(name: str):
    """A registered pooling as an aggregate over frame vectors, for groupBy().agg(): pooled("meanP")("embedding").

    All frames of a group meet in one call, as a pooling may need them; means of any number of frames are mean_pool's.
    """
    from vantle.operators.encoders import get_pooling

    get_pooling(name)  # an unknown name fails here, not in a task

    @F.arrow_udf("array<float>")
    def pool(v: pa.Array) -> float:
        rows = v.drop_null()
        if not len(rows):
            return None
        return get_pooling(name)(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)).astype(np.float32).tolist()

    return pool
