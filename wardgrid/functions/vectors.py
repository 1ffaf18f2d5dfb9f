"""Embedding vectors as array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fit_length(vector: Column, size: int) -> Column:
    """Pad with zeros or cut to `size` elements."""
    padded = F.concat(vector.cast("array<double>"), F.array_repeat(F.lit(0.0), size))
    return F.slice(padded, 1, size)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def unit_vector(vector: Column, size: int = 1024) -> Column:
    """Fitted to `size` and L2-normalised; a norm of at most 1e-8 leaves it unchanged."""
    fitted = fit_length(vector, size)
    length = norm(fitted)
    return F.when(length > 1e-8, F.transform(fitted, lambda x: x / length)).otherwise(fitted)


def mean_activation(vector: Column) -> Column:
    total = F.aggregate(vector.cast("array<double>"), F.lit(0.0), lambda a, x: a + F.abs(x))
    return total / F.size(vector)
