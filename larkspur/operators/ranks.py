"""Ranks within groups of any size, without a group meeting in one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.sources.tables import materialise

#: ``monotonically_increasing_id`` holds the partition above this many bits, the place in it below.
_PLACE_BITS = 33


def ranked(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with the place (from 1) of each row in its group by ``order``, as row_number over the group would give it.

    The rows are dealt by range of (group, order), cut at sampled places, and sorted in each range; what a row's rank
    needs besides its place in the range are the rows of all ranges before (one number a range) and the
    first place of its group (one a group). So a group with most rows is as many tasks' work as any other
    rows. Ties in ``order`` are broken as they come. Null group values are a group; without ``group`` the
    whole table is one; an empty table gives no rows.
    """
    spread = rows.repartitionByRange(*map(F.col, group), *order).sortWithinPartitions(*map(F.col, group), *order)
    written = materialise(spread.withColumn("_place", F.monotonically_increasing_id()))
    of_range = F.shiftright("_place", _PLACE_BITS)
    before, ranges = 0, []
    for number, n in sorted((r[0], r[1]) for r in written.groupBy(of_range).count().collect()):  # a row a range
        ranges.append((number, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(ranges, "_range long, _before long")
    # A row a range, whose number the session's shuffle partitions bound.
    placed = written.withColumn("_range", of_range).join(F.broadcast(offsets), "_range")
    placed = placed.withColumn("_at", F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))).drop("_place", "_range", "_before")
    if not group:
        return placed.select(*rows.columns, (F.col("_at") + 1).cast("int").alias(name))
    firsts = materialise(placed.groupBy(*(F.col(c).alias(f"_of_{k}") for k, c in enumerate(group))).agg(F.min("_at").alias("_first")))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{k}")) for k, c in enumerate(group)))
    return placed.join(firsts, same).select(*rows.columns, (F.col("_at") - F.col("_first") + 1).cast("int").alias(name))
