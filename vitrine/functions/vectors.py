"""Column functions over dense vectors; sums are in double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def linear_maps(vec: Column, weights, bias=0.0) -> Column:
    """array<double> of weights @ vec + bias for fixed weight rows; null for a null vector.

    Array lambdas are interpreted element by element in Spark, so products with known weights
    go through Arrow: one matrix product per batch, all weight rows at once.
    """
    w = np.atleast_2d(np.asarray(weights, dtype=float)).T
    b = np.broadcast_to(np.asarray(bias, dtype=float), (w.shape[1],))

    @F.arrow_udf("array<double>")
    def product(v: pa.Array) -> pa.Array:
        valid = np.asarray(v.is_valid())
        x = v.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, w.shape[0])
        out = x @ w + b
        lists = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * w.shape[1], out.ravel())
        return lists.take(pa.array(np.cumsum(valid) - 1, mask=~valid)) if v.null_count else lists

    return product(vec)


def scaled(vec: Column, shift, factor) -> Column:
    """array<double> of (vec - shift) * factor, element by element, one Arrow batch at a time; null for a null vector."""
    s, f = np.asarray(shift, dtype=float), np.asarray(factor, dtype=float)

    @F.arrow_udf("array<double>")
    def moved(v: pa.Array) -> pa.Array:
        valid = np.asarray(v.is_valid())
        x = v.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(s))
        out = (x - s) * f
        lists = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * len(s), out.ravel())
        return lists.take(pa.array(np.cumsum(valid) - 1, mask=~valid)) if v.null_count else lists

    return moved(vec)


def take_indices(vec: Column, indices: list[int]) -> Column:
    """The elements at fixed positions, in that order."""
    return F.transform(F.array(*[F.lit(i) for i in indices]), lambda i: F.get(vec, i))
