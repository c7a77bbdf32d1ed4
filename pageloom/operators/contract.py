"""What rows of the index have to be like, and where the others go.

A row that breaks the contract is no reason to end a job with millions of good ones, and it must not
slip in either: sinks and builds split their rows into accepted ones and rejected ones with
the first reason that applies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REJECTED_SCHEMA = "rejected_from string, id long, path string, reason string"


@dataclass(frozen=True)
class Contract:
    """``dim`` is the length of all vectors; ``categories`` the known ones (``''`` has to be named too). None: any."""

    dim: int | None = None
    categories: tuple | None = None


def document_reason(contract: Contract) -> Column:
    """Why a document is rejected; null if it is not."""
    reason = (
        F.when(F.col("id").isNull(), "no_id")
        .when(F.coalesce(F.col("path"), F.lit("")) == "", "no_path")
        .when(F.col("text").isNull(), "no_text")
        .when(F.col("category").isNull(), "no_category")
    )
    if contract.categories is not None:
        reason = reason.when(~F.col("category").isin(list(contract.categories)), "unknown_category")
    return reason


def vector_reason(contract: Contract) -> Column:
    """Why a vector is rejected; null if it is not."""
    embedding = F.col("embedding")
    reason = (
        F.when(F.col("doc_id").isNull(), "no_id")
        .when(embedding.isNull(), "no_vector")
        .when(F.exists(embedding, lambda x: x.isNull()), "null_number")
        .when(F.exists(embedding, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
    )
    return reason if contract.dim is None else reason.when(F.size(embedding) != contract.dim, "wrong_dimension")


def split_documents(documents: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``."""
    reason = document_reason(contract)
    rejected = documents.where(reason.isNotNull()).select(F.lit("documents").alias("rejected_from"), "id", "path", reason.alias("reason"))
    return documents.where(reason.isNull()), rejected


def split_vectors(vectors: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``."""
    reason = vector_reason(contract)
    none = F.lit(None).cast("string").alias("path")
    rejected = vectors.where(reason.isNotNull()).select(F.lit("vectors").alias("rejected_from"), F.col("doc_id").alias("id"), none, reason.alias("reason"))
    return vectors.where(reason.isNull()), rejected
