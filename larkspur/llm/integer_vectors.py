"""Vectors as integers: which rows take part, and numpy arrays of their components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Greatest integer component: squared distances of vectors of up to 4,096 components stay below 2 to the 63rd.
LIMIT = 1 << 24


def finite(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def kept(vectors: DataFrame, id_col: str, vector_col: str, *others: Column) -> DataFrame:
    """(vec_id, vector, others): the rows whose vector is :func:`finite`, in double precision."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), *others)
    return rows.where(finite(F.col("vector")))


def floored(lists: pa.ListArray, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length, a row each; beyond ``LIMIT`` either way it stays there."""
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    return np.clip(np.floor(scale * flat), -LIMIT, LIMIT).astype(np.int64).reshape(len(lists), -1)


def narrow(x: np.ndarray) -> np.ndarray:
    """``x`` in the narrowest signed type that holds it."""
    return x.astype(next(t for t in (np.int8, np.int16, np.int32) if not x.size or (np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max)))


def exact_type(*arrays: np.ndarray) -> type:
    """float64 where sums of products of differences of these integers are exact in it, else int64."""
    widest = max([1, *(int(np.abs(a).max()) for a in arrays if a.size)])
    return np.float64 if (2 * widest) ** 2 * 4 * max(a.shape[-1] for a in arrays) < 1 << 53 else np.int64


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(row, centre): exact squared Euclidean distances of integer vectors."""
    kind = exact_type(x, centres)
    x, centres = x.astype(kind), centres.astype(kind)
    return (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None] - 2 * (x @ centres.T)
