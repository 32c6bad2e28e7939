"""Vector columns as ARRAY<DOUBLE>, handled by higher-order functions."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_doubles(vector: Column) -> Column:
    return F.transform(vector, lambda v: v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v
    )


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def pair_features(a: Column, b: Column) -> Column:
    """[a, b, |a-b|, a*b] of two equally long vectors."""
    return F.concat(
        a,
        b,
        F.zip_with(a, b, lambda x, y: F.abs(x - y)),
        F.zip_with(a, b, lambda x, y: x * y),
    )


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark rounds doubles: half up on the shortest decimal text."""
    scale = 10.0**digits
    y = np.abs(x) * scale
    out = np.copysign(np.floor(y + 0.5), x) / scale + 0.0
    # Close to a half, or too large for exact steps: by the decimal text.
    for i in np.flatnonzero((np.abs(y - np.floor(y) - 0.5) < 1e-6) | (y > 1e9)):
        v = float(x[i])
        if np.isfinite(v):
            out[i] = float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0 if abs(v) < 1e15 else v
        else:
            out[i] = v
    return out


def _pair_vector(digits: int):
    def made(a: pa.Array, b: pa.Array) -> pa.Array:
        """Pairs of equally long vectors without nulls in one pass over flat arrays; null for others."""
        n = np.asarray(a.value_lengths().fill_null(-1)), np.asarray(b.value_lengths().fill_null(-2))
        rows = np.flatnonzero(n[0] == n[1])
        both = [v.take(pa.array(rows)) for v in (a, b)]
        flat = [v.flatten() for v in both]
        if flat[0].null_count or flat[1].null_count:
            return pa.nulls(len(a), pa.list_(pa.float64()))
        x, y = (np.asarray(v).astype(np.float64) for v in flat)
        width = n[0][rows].astype(np.int64)
        # Places of |a - b| in the joined vectors; those of a * b come ``width`` later.
        place = np.arange(len(x)) + np.repeat(np.cumsum(width) - width, width)
        joined = np.empty(2 * len(x))
        joined[place] = np.abs(x - y)
        joined[place + np.repeat(width, width)] = x * y
        starts = np.zeros(len(a) + 1, dtype=np.int32)
        starts[rows + 1] = 2 * width
        missing = np.ones(len(a), dtype=bool)
        missing[rows] = False
        offsets = pa.array(np.cumsum(starts), pa.int32())
        values = pa.array(_half_up(joined, digits))
        return pa.ListArray.from_arrays(offsets, values, mask=pa.array(missing))

    return made


def pair_vector(a: Column, b: Column, digits: int = 4) -> Column:
    """[|a-b|, a*b], rounded: in numpy for vectors of equal length, by expressions for all others."""
    fast = F.arrow_udf(_pair_vector(digits), T.ArrayType(T.DoubleType()))
    x, y = as_doubles(a), as_doubles(b)
    z = F.concat(F.zip_with(x, y, lambda p, q: F.abs(p - q)), F.zip_with(x, y, lambda p, q: p * q))
    return F.coalesce(fast(a, b), F.transform(z, lambda v: F.round(v, digits)))


def linear_score(features: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    """Logit of a linear model."""
    return dot(features, F.array(*[F.lit(float(w)) for w in weights])) + F.lit(float(bias))


def one_hot(index: Column, size: Column | int) -> Column:
    """Identity-matrix row; all zeros for an index outside 0..size-1."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.transform(
        F.when(size > 0, F.sequence(F.lit(0), (size - 1).cast("int"))).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.when(i == index, F.lit(1.0)).otherwise(F.lit(0.0)),
    )


# The functions that run in Python tasks travel with them, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
