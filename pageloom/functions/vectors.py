"""Vector columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(value)).cast("float") for value in values])


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two float arrays, computed in double precision."""
    squares = F.zip_with(
        a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, square: total + square))


def has_dim(embedding: Column, dim: int) -> Column:
    """True for a vector of ``dim`` entries, none of them null."""
    whole = (F.size(embedding) == dim) & ~F.exists(embedding, lambda x: x.isNull())
    return F.coalesce(whole, F.lit(False))


def require_dim(vectors: DataFrame, dim: int) -> DataFrame:
    """The same rows; reading one with a vector of another shape fails the job."""
    checked = F.when(has_dim(F.col("embedding"), dim), F.col("embedding")).otherwise(
        F.raise_error(F.lit(f"embedding is not a vector of {dim} numbers")).cast("array<float>")
    )
    return vectors.withColumn("embedding", checked)


def split_by_dim(vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)`` rows."""
    good = has_dim(F.col("embedding"), dim)
    return vectors.where(good), vectors.where(~good)
