"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.sources.tables import materialise

#: Fixed value: what separates words (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one block of a prefix sum holds on average, or the root of all rows if that is more: so many blocks meet in one task.
BLOCK_ROWS = 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], budget: float, most: float) -> DataFrame:
    """Target words by source from (source, source_size): shares of ``budget`` x all words.

    Weights repeat over the sources in code-point order, null last. A share above ``most`` x
    its source's words stops there and the rest goes to the others by weight, until none is
    above: sources are filled in the order of words per weight, so whether a source is capped
    follows from sums over that order (the first source left open sees the highest level). A budget that all caps together cannot hold leaves
    every source at its cap. The table has a row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double"))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = weighed.withColumn("level", left / weight_left).withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    first_open = F.max(F.when(F.col("open"), F.col("level"))).over(Window.partitionBy())
    return level.withColumn("target", F.when(F.coalesce(first_open * F.col("weight") < F.col("cap"), F.lit(False)), first_open * F.col("weight")).otherwise(F.col("cap"))).select("source", "source_size", "weight", "target")


def running_total(df: DataFrame, group: list[str], block: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of the group before each row, in ``order``.

    ``block`` numbers ranges of the order, so a group of any size is dealt over many tasks:
    one sum per block, a running sum over the blocks alone, then one within each block.
    """
    keys = [*group, block]
    blocks = df.groupBy(*keys).agg(F.sum(value).alias("_block_sum"))
    earlier = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*(F.col(k).alias(f"_{k}") for k in keys), F.coalesce(F.sum("_block_sum").over(earlier), F.lit(0)).alias("_base"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(blocks, same).withColumn(name, F.col("_base") + F.col("_inside")).drop("_base", "_inside", *(f"_{k}" for k in keys))


def mix_passes(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), *, budget: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """The passes over documents that queue: row_id, doc_id, source, size, source_size, target, pass, taken.

    Each source's documents are shuffled by the md5 of their id, or of a hash of the text where
    there is none, so that rows without an id spread too, and queue as often as ``most``
    allows. Words queued by the end of a pass over a document, divided by the source's target,
    are its virtual finish time; all passes are ranged by it over the sources and cut where the
    sum of all targets is reached. The last pass may be cut, so ``taken`` is at most ``size``.
    A document that never queues keeps pass 0 with taken 0. Sums run in blocks of a hash range
    or time range, so a source with most rows is dealt over many tasks. Only ids, sources and
    sizes are shuffled; the texts are read once. ``row_id`` tells repeated rows apart; it is
    ``row_col`` where that is given, unique by row.
    """
    by_text = F.xxhash64(F.col(text_col)).cast("string")
    place = F.md5(F.coalesce(F.col(id_col).cast("long").cast("string"), by_text).cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), place.alias("place"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row_id"))
    rows = materialise(rows)
    by_source = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")))
    counts = by_source.select(F.col("source").alias("_s"), "_rows")
    targets = source_targets(by_source.drop("_rows"), weights, budget, most)
    targets = targets.join(counts, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_source"), "source_size", "target", "_rows")
    total, count = targets.agg(F.floor(F.sum("target")), F.sum("_rows")).first()
    blocks = (count or 0) // max(BLOCK_ROWS, isqrt(count or 0))
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    part = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("_at", F.floor(F.coalesce(part, F.lit(0.0)) * (F.col("_rows") / F.greatest(F.lit(float(BLOCK_ROWS)), F.sqrt("_rows")) + 1)))
    ranked = [F.col("place"), F.col("doc_id"), F.col("size"), F.col("row_id")]
    rows = running_total(rows, ["source"], "_at", ranked, F.col("size"), "queued").drop("_at", "_rows")
    start = F.col("queued") + F.col("pass") * F.col("source_size")
    rows = rows.select("*", F.explode(F.array(*map(F.lit, range(int(-(-most // 1)))))).alias("pass"))
    rows = rows.withColumn("finish", (start + F.col("size")) / F.when(F.col("target") > 0, F.col("target")))
    rows = rows.where((F.col("pass") == 0) | (start < F.col("target")) & (F.col("size") > 0))
    # What starts at its source's target or later finishes after the cut; it waits behind time 1.
    rows = rows.withColumn("_time", F.floor(F.least(F.coalesce("finish", F.lit(1.0)), F.lit(1.0)) * (blocks + 1)))
    order = [F.col("finish").asc_nulls_last(), F.col("source").asc_nulls_last(), *ranked, F.col("pass")]
    rows = rows.withColumn("queues", F.when(start < F.col("target"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    waits = F.when(F.col("queues") > 0, F.lit(-1)).otherwise(F.pmod(F.xxhash64("row_id"), F.lit(blocks + 1)))
    rows = rows.withColumn("_time", F.when(F.col("queues") > 0, F.col("_time")).otherwise(blocks + 2 + waits))
    rows = running_total(rows, [], "_time", order, F.col("queues"), "before")
    taken = F.greatest(F.lit(0), F.least(F.col("queues"), F.lit(total or 0) - F.col("before")))
    return rows.select("row_id", "doc_id", "source", "size", "source_size", "target", "pass", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), **how) -> DataFrame:
    """Per document what the mix takes: doc_id, size, source_size, target, taken (repeats counted).

    A null text has size 0 and takes nothing; a null source is the last source; a row
    without an id is shuffled by its text; repeated rows queue one by one; an empty table gives no rows; other columns
    are ignored. Takes are whole but for one document at the cut.
    """
    passes = mix_passes(docs, weights, **how)
    return passes.groupBy("row_id", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).drop("row_id")


#: The same mix in DuckDB's SQL, for distinct doc_ids.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS place,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM d GROUP BY source),
f AS (SELECT *, 2.0::DOUBLE * n AS cap,
        (sum(n) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * n) OVER (ORDER BY 2.0::DOUBLE * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY 2.0::DOUBLE * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s),
g AS (SELECT *, max(CASE WHEN cap > lv * w THEN lv END) OVER () AS final FROM f),
t AS (SELECT source, n, CASE WHEN coalesce(final * w < cap, false) THEN final * w ELSE cap END AS target FROM g),
q AS (SELECT d.*, CAST(t.n AS BIGINT) AS source_size, t.target,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS queued
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT q.*, pass, queued + pass * source_size AS start FROM q CROSS JOIN (VALUES (0), (1)) AS v(pass)),
k AS (SELECT *, CAST(start + size AS DOUBLE) / target AS finish FROM p WHERE start < target AND size > 0),
b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, source NULLS LAST, place, pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
x AS (SELECT doc_id, sum(greatest(0, least(size, (SELECT CAST(floor(sum(target)) AS BIGINT) FROM t) - before))) AS taken FROM b GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(x.taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN x USING (doc_id)
"""
