"""Vector columns: norms, products, packings; arithmetic is in double.

Norms and products are built-in expressions. Packings are kernels over the flat buffers of whole Arrow batches: a nested
expression would find a vector's largest magnitude once a component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the least step of a 32-bit float at 1, the floor of a norm.
EPS32 = 1.1920928955078125e-07
#: Fixed value: the least normal 32-bit float, the floor of a scale.
TINY32 = 1.1754943508222875e-38
PACKINGS = ("float32", "float16", "int8", "binary")


def dot(a, b) -> Column:
    """Inner product, summed in order; vectors of unlike lengths fail, a null one gives null."""
    unlike = F.raise_error(F.lit("vectors differ in length")).cast("double")
    return F.when(F.size(a) != F.size(b), unlike).otherwise(_dot(a, b))


def _dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(_dot(v, v))


def normalized(v, floor: bool = True) -> Column:
    """v over its length; with a floor zero vectors stay zero, without one they become NaN."""
    length = F.greatest(norm(v), F.lit(EPS32)) if floor else norm(v)
    # beside the components, so that it is computed once and not once a component
    return F.zip_with(v, F.array_repeat(length, F.size(v)), lambda x, n: x.cast("double") / n)


def all_finite(v) -> Column:
    """Whether the vector and all its components are there and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    return F.coalesce(F.forall(v, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def is_unit(v) -> Column:
    """Whether the length is 1 within the tolerances 1e-4 and 1e-5 of it."""
    return F.abs(norm(v) - 1) <= 1e-4 + 1e-5


class _Flat:
    """A batch's vectors as one buffer: components, which of them are null, and each vector's length (null: 0)."""

    def __init__(self, vectors: pa.Array):
        self.vectors, values = vectors, vectors.flatten()
        self.null = values.is_null().to_numpy(zero_copy_only=False)
        self.values = values.to_numpy(zero_copy_only=False)
        self.lengths = vectors.value_lengths().fill_null(0).to_numpy().astype(np.int64)

    def largest(self) -> np.ndarray:
        """Each vector's largest magnitude as a 32-bit float, without null components; NaN where it has no other."""
        out, sizes = np.full(len(self.lengths), np.nan, np.float32), self.lengths
        some = sizes > 0
        if some.any():
            size = np.where(self.null, -1, np.abs(self.values.astype(np.float32)))
            out[some] = np.maximum.reduceat(size, (np.cumsum(sizes) - sizes)[some])
            out[out < 0] = np.nan
        return out

    def as_lists(self, values: np.ndarray, kind: pa.DataType, lengths: np.ndarray | None = None, null: np.ndarray | None = None) -> pa.Array:
        """New components in lists, of the vectors' lengths unless others are given; null vectors stay null."""
        offsets = np.concatenate(([0], np.cumsum(self.lengths if lengths is None else lengths))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind, mask=null), mask=self.vectors.is_null())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def pack_half(v: pa.Array) -> pa.Array:
    """Components rounded to 16-bit floats, half to even; magnitudes from 65520 on become infinite. Null ones stay null."""
    flat = _Flat(v)
    with np.errstate(over="ignore"):
        return flat.as_lists(flat.values.astype(np.float64).astype(np.float16).astype(np.float64), pa.float64(), null=flat.null)


@F.arrow_udf(T.FloatType())
def int8_scale(v: pa.Array) -> pa.Array:
    """The step of a packed vector: its largest magnitude over 127; null without a component."""
    largest = _Flat(v).largest()
    return pa.array((largest.astype(np.float64) / 127).astype(np.float32), mask=np.isnan(largest))


@F.arrow_udf(T.ArrayType(T.ByteType()))
def pack_int8(v: pa.Array) -> pa.Array:
    """Symmetric 8-bit codes, half to even, within -127 and 127; null components stay null."""
    flat = _Flat(v)
    top = np.repeat(np.fmax(flat.largest(), np.float32(TINY32)).astype(np.float64), flat.lengths)
    code = np.rint(((flat.values.astype(np.float64) / top).astype(np.float32) * np.float32(127)).astype(np.float64))
    return flat.as_lists(np.nan_to_num(np.clip(code, -127, 127)).astype(np.int8), pa.int8(), null=flat.null)


def unpack_int8(codes, scale) -> Column:
    return F.transform(codes, lambda q: q.cast("double") * F.col(scale).cast("double"))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def pack_bits(v: pa.Array) -> pa.Array:
    """One bit a component, set where it is above 0; the first is a byte's highest, the last byte is filled with 0. A null
    component's bit is 0, a NaN's 1, as NaN is the largest number."""
    flat = _Flat(v)
    sizes = -(-flat.lengths // 8)
    own = np.repeat(np.cumsum(8 * sizes) - 8 * sizes - (np.cumsum(flat.lengths) - flat.lengths), flat.lengths)
    bits = np.zeros(int(8 * sizes.sum()), np.uint8)
    bits[np.arange(len(own)) + own] = ~flat.null & ((flat.values > 0) | (flat.values != flat.values))
    return flat.as_lists(np.packbits(bits).astype(np.int32), pa.int32(), sizes)


def unpack_bits(packed, dimension: int) -> Column:
    """1 and -1 for the bits of the first components; bytes that aren't there count as 0."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def unpacked(v: pa.Array) -> pa.Array:
        flat = _Flat(v)
        sizes, most = flat.lengths, -(-dimension // 8)
        place = np.arange(len(flat.values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        table = np.zeros((len(sizes), most), np.uint8)
        kept = (place < most) & ~flat.null
        table[np.repeat(np.arange(len(sizes)), sizes)[kept], place[kept]] = flat.values[kept].astype(np.int64).astype(np.uint8)
        bits = np.unpackbits(table, axis=1)[:, :dimension].astype(np.int32)
        n = np.where(v.is_null().to_numpy(zero_copy_only=False), 0, dimension)
        return flat.as_lists((2 * bits - 1)[n > 0].ravel(), pa.int32(), n)

    return unpacked(packed)


def hamming(a, b) -> Column:
    """Bits in which two packed vectors differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def bytes_per_vector(dimension: Column, packing: Column) -> Column:
    """Stored bytes of one vector, with its scale where it has one."""
    sizes = {"float32": dimension * 4, "float16": dimension * 2, "int8": dimension + 4, "binary": F.ceil(dimension / 8)}
    out = F.raise_error(F.concat(F.lit("unknown packing "), packing)).cast("long")
    for name, size in sizes.items():
        out = F.when(packing == name, size.cast("long")).otherwise(out)
    return out
