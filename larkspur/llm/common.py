"""Pieces shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def held_out(id_col: str = "doc_id") -> Column:
    """Fold of a row: crc32 of its id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Memo(dict):
    """A bounded cache: ``make(key)`` on a miss, emptied when ``limit`` entries are held."""

    def __init__(self, make: Callable[[str], Any], limit: int = 400_000) -> None:
        super().__init__()
        self._make, self._limit = make, limit

    def __missing__(self, key: str) -> Any:
        if len(self) >= self._limit:
            self.clear()
        value = self[key] = self._make(key)
        return value


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``chars`` bytes of ``column`` (one row at least).

    Whole rows only: a longer text makes a batch of its own.
    """
    for batch in batches:
        rows = max(1, int(batch.num_rows * chars / max(1, batch.column(column).nbytes)))
        begin = 0
        while begin < batch.num_rows:
            part = batch.slice(begin, rows)
            while part.num_rows > 1 and part.column(column).nbytes > 2 * chars:
                part = part.slice(0, part.num_rows // 2)
            yield part
            begin += part.num_rows


def pieces_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lists of strings as (piece number of each element, where each list begins and the last ends, distinct pieces).

    Work on a text's pieces then happens once for each distinct piece of the batch.
    """
    coded = lists.flatten().dictionary_encode()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    return np.asarray(coded.indices), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), coded.dictionary


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """:func:`pieces_of` the texts cut at white space; an empty piece may stand at either end."""
    return pieces_of(pc.utf8_split_whitespace(pc.fill_null(texts, "")))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one or more columns) between consecutive bounds; empty ranges give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[bounds[1:]] - total[bounds[:-1]]


def hashed_sample(df: DataFrame, group: str, per_group: int, key: Column, *, groups: int = 500, size: Column | None = None, most: int = 0) -> DataFrame:
    """About ``per_group`` rows of each of the ``groups`` most frequent values of ``group``, the same on every run.

    One count per group sets the share of hash values kept, so a group of any size
    contributes a bounded number of rows without a sort or a window over it. With ``size`` the share is also small enough
    that the rows of a group have about an even part of ``most`` in all.
    """
    spread = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    total = F.sum(F.lit(0) if size is None else size)
    counts = {r[0]: (r[1], r[2]) for r in df.groupBy(group).agg(F.count(F.lit(1)).alias("count"), total.alias("total")).orderBy(F.desc("count"), group).limit(groups).collect()}
    if not counts:
        return df.limit(0)
    shares = []
    for value, (n, total) in counts.items():
        share = min(per_group / n, most / len(counts) / total) if size is not None and total else per_group / n
        shares.append((value, min(1 << 30, int((1 << 30) * share) + 1)))
    told = df.sparkSession.createDataFrame(shares, StructType([StructField("_group", df.schema[group].dataType), StructField("_share", LongType())]))
    # At most ``groups`` rows.
    kept = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col(group).alias("_of"), spread.alias("_at")).join(F.broadcast(told), F.col("_of").eqNullSafe(F.col("_group")))
    return kept.where("_at < _share").select("_row.*")


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession
