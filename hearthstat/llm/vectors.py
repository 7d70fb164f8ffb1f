"""Vectors: which take part, their cosine, and equal ones as one."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not NULL, all components finite, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, added up from the first component on."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, z: acc + z)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def distinct_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """One row per different usable vector: rep (smallest id), copies, vector. Grouping starts on the map side."""
    rows = df.where(F.col(vec_id).isNotNull() & usable(F.col(vector)))
    return rows.groupBy(F.col(vector).alias("vector")).agg(F.min(F.col(vec_id).cast("long")).alias("rep"), F.count(F.lit(1)).alias("copies"))


def matrix(lists: pa.Array, kind: type = np.float64) -> np.ndarray:
    """An Arrow array of equally long lists as a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def units(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component, so that no square leaves the range of doubles."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))
