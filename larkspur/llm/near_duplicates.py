"""Near duplicates by ProbMinHash, banding and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import slices, words_of
from larkspur.operators.graph import connected_components
from larkspur.sources.tables import discard, materialise

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of runs of ``width`` lower-case words, repeats included, and each text's bounds.

    A text with fewer words has one shingle of them all; one without words has none.
    """
    number, bounds, words = words_of(pc.utf8_lower(pc.fill_null(texts, "")))
    names = words.to_pylist()
    own = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in names], dtype=np.uint64)
    solid = np.array([bool(w) for w in names], dtype=bool)[number] if len(names) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[solid]
    h = own[number[solid]] if len(number) else np.zeros(0, np.uint64)
    sizes = np.bincount(owner, minlength=len(bounds) - 1)
    ends = np.cumsum(sizes)
    # A run stops early where its text does.
    last = np.repeat(ends, sizes)
    place = np.arange(len(h))
    run = np.zeros(len(h), dtype=np.uint64)
    for j in range(width):
        at = place + j
        inside = at < last
        run = np.where(inside, mixed(run * _GOLD + h[np.minimum(at, max(len(h) - 1, 0))] + np.uint64(j)) if len(h) else run, run)
    begins = np.repeat(ends - sizes, sizes)
    keep = (place + width <= last) | (place == begins)
    return run[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(bounds) - 1))]).astype(np.int64)


def probminhash(elements: np.ndarray, bounds: np.ndarray, registers: int, weights: np.ndarray | None = None) -> np.ndarray:
    """(set, register): the element that arrives first at each register; 0 for an empty set.

    Every element is a Poisson process with its weight as rate (1 by default, when repeats do not
    count); each arrival falls on a register drawn from the element's own random numbers, so two
    weighted sets agree at a register with the probability Jaccard similarity. An element ends
    as soon as its next arrival is later than all its set's registers have seen; arrivals are drawn
    in rounds over all elements of the batch that are still alive.
    """
    sets = len(bounds) - 1
    seen, winner = np.full(sets * registers, np.inf), np.zeros(sets * registers, dtype=np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    element, rate = elements, None if weights is None else weights.astype(np.float64)
    time = np.zeros(len(element))
    limit = np.full(sets, np.inf)
    rounds = 0
    while len(element):
        rounds += 1
        draw = mixed(element + np.uint64(rounds * int(_GOLD) % (1 << 64)))
        gap = -np.log(((draw >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53)
        time = time + (gap if rate is None else gap / rate)
        alive = time < limit[owner]
        if not alive.all():
            element, owner, time, draw = element[alive], owner[alive], time[alive], draw[alive]
            rate = None if rate is None else rate[alive]
        slot = owner * registers + (mixed(draw ^ _GOLD) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(seen, slot, time)
        first = time == seen[slot]
        winner[slot[first]] = element[first]
        if rounds < 8 or rounds % 4 == 0:
            limit = seen.reshape(sets, registers).max(axis=1)
    return winner.reshape(sets, registers)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets from their registers."""
    return float((a == b).mean())


def band_hashes(registers: np.ndarray, rows: int) -> np.ndarray:
    parts = registers.reshape(len(registers), -1, rows)
    key = np.zeros(parts.shape[:2], dtype=np.uint64)
    for j in range(rows):
        key = mixed(key * _GOLD + parts[:, :, j] + np.uint64(j))
    return key + np.arange(parts.shape[1], dtype=np.uint64)[None] * _GOLD


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, a, b, text): the text, empty for null, with two hashes, and a key that is the id or, for null, the least long."""
    text, doc_id = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"))
    return rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), "text")


def sketches(docs: DataFrame, *, bands: int, rows: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(row, key, doc_id, a, b, bands), written: one pass over the texts, nothing shuffled. ``row`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, chars=2_000_000):
            found, bounds = shingles(batch.column("text"), width)
            keys = band_hashes(probminhash(found, bounds, bands * rows), rows).astype(np.int64)
            flat = pa.array(keys.ravel())
            some = np.diff(bounds) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)), flat.filter(pa.array(np.repeat(some, bands))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "doc_id", "a", "b")), lists], names=["key", "doc_id", "a", "b", "bands"])

    marks = keyed_texts(docs, id_col, text_col).mapInArrow(run, "key long, doc_id long, a long, b long, bands array<long>")
    return materialise(marks.withColumn("row", F.monotonically_increasing_id()))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(rep, grams): the sorted distinct shingles of (rep, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, chars=2_000_000):
            found, bounds = shingles(batch.column("text"), width)
            sets = [np.unique(found[a:b]).view(np.int64) for a, b in zip(bounds, bounds[1:], strict=False)]
            sizes = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))], names=["rep", "grams"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, grams array<long>")


def across_classes(member: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """Pairs (x, y) of texts with one leader but different classes that can be linked all the same.

    ``member`` has (rep, leader, linked, component), ``grams`` the shingles of all texts. With D the
    shingles that only one of a text and its leader has, and n a text's number of shingles, x and y
    are linked if and only if |Dx & Dy| >= (|Dx| + |Dy| - share * (nx + ny)) / 2, share being
    (1 - similarity) / (1 + similarity). One of the two is not linked to the leader, which makes that
    bound positive and gives each text a least overlap with any partner; so only a prefix of D, in
    order of rarity among the leader's texts, is joined, and a match counts only if what is left of
    both sets from there can reach the pair's bound.
    """
    share = (1 - similarity) / (1 + similarity)
    own = grams.select(F.col("rep"), F.col("grams").alias("gx"))
    led = grams.select(F.col("rep").alias("leader"), F.col("grams").alias("gy"))
    apart = F.concat(F.array_except("gx", "gy"), F.array_except("gy", "gx"))
    sets = member.join(own, "rep").join(led, "leader").select("rep", "leader", "linked", "component", F.size("gx").alias("n"), F.size("gy").alias("n_leader"), apart.alias("apart"))
    sets = sets.withColumn("d", F.size("apart"))
    least = F.when(F.col("linked"), F.col("d") + share * (F.col("n_leader") - F.col("n"))).otherwise(F.col("d") - share * (F.col("n_leader") + F.col("n"))) / 2
    need = F.greatest(F.ceil(least - 1e-9).cast("int"), F.lit(1))
    apart = materialise(sets.select("leader", "rep", "component", "n", "d", (F.col("d") - need + 1).alias("upto"), F.explode("apart").alias("gram")))
    often = apart.groupBy("leader", "gram").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("leader", "rep").orderBy("often", "gram")
    ranked = apart.join(often, ["leader", "gram"]).withColumn("at", F.row_number().over(order) - 1)
    rows = materialise(ranked.where("at < upto and often > 1").select("leader", "gram", "rep", "component", "n", "d", "at"))
    fields = ("rep", "component", "n", "d", "at")
    one = rows.select("leader", "gram", *(F.col(c).alias(f"{c}_1") for c in fields))
    two = rows.select("leader", "gram", *(F.col(c).alias(f"{c}_2") for c in fields))
    reach = F.least(F.col("d_1") - F.col("at_1"), F.col("d_2") - F.col("at_2"))
    may = (F.col("component_1") < F.col("component_2")) & (2 * reach + 1e-9 >= F.col("d_1") + F.col("d_2") - share * (F.col("n_1") + F.col("n_2")))
    return one.join(two, ["leader", "gram"]).where(may).select(F.col("rep_1").alias("x"), F.col("rep_2").alias("y")).distinct()


def numbered(docs: DataFrame) -> DataFrame:
    """``docs``, written, with a row id _row that stays the same at every reading."""
    return materialise(docs.withColumn("_row", F.monotonically_increasing_id()))


def repeated_rows(marks: DataFrame) -> DataFrame:
    """(key, a, b), written: of rows that are there several times with one id and one text."""
    return materialise(marks.groupBy("key", "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))


def row_classes(docs: DataFrame, *, similarity: float = 0.8, width: int = 5, bands: int = 32, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(a written row for each row of ``docs``: row, key, doc_id, a, b, rep, copy_of, component; :func:`repeated_rows`).

    ``rep`` is the row that stands for an equal text: of the least id, nulls last, then the least row;
    ``copy_of`` is its id. ``component`` is a row that names the class. See :func:`near_duplicate_classes`.
    """
    marks = sketches(docs, bands=bands, rows=rows, width=width, id_col=id_col, text_col=text_col)
    again = repeated_rows(marks)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    # Written before it is joined back, and without the texts that have no copy: a join right on an
    # aggregate is not split where most rows are copies of one text.
    copies = marks.groupBy("a", "b").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = materialise(copies.select("a", "b", F.col("first.row").alias("rep"), F.col("first.doc_id").alias("copy_of")))
    ids = marks.drop("bands").join(copies, ["a", "b"], "left")
    copy_of = F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("copy_of"))
    ids = materialise(ids.select("row", "key", "doc_id", "a", "b", F.coalesce("rep", "row").alias("rep"), copy_of.alias("copy_of")))
    reps = marks.select("row", "doc_id", "bands").join(ids.where("row = rep").select("row"), "row", "left_semi")
    members = materialise(reps.select(F.col("row").alias("rep"), "doc_id", F.explode("bands").alias("bucket")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rep"))["rep"]
    buckets = members.groupBy("bucket").agg(least.alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = materialise(members.drop("doc_id").join(buckets, "bucket"))
    wanted = members.select("rep").distinct().join(ids.where("row = rep").select("rep", "key", "a", "b"), "rep")
    texts = keyed_texts(docs, id_col, text_col).drop("doc_id").join(wanted.hint("shuffle_hash"), ["a", "b", "key"]).select("rep", "text")
    grams = materialise(shingle_sets(texts, width))
    if again.limit(1).count():
        grams = materialise(grams.dropDuplicates(["rep"]))

    def verified(pairs: DataFrame) -> DataFrame:
        left = grams.select(F.col("rep").alias("x"), F.col("grams").alias("gx"))
        right = grams.select(F.col("rep").alias("y"), F.col("grams").alias("gy"))
        met = pairs.join(left, "x").join(right, "y")
        both = F.size(F.array_intersect("gx", "gy"))
        return met.select("x", "y", (both / (F.size("gx") + F.size("gy") - both)).alias("likeness"))

    star = materialise(verified(members.where("rep <> leader").select(F.col("rep").alias("x"), F.col("leader").alias("y")).distinct()))
    linked = star.where(F.col("likeness") >= similarity).select("x", "y")
    classes = connected_components(linked, "x", "y")
    member = star.select(F.col("x").alias("rep"), F.col("y").alias("leader"), (F.col("likeness") >= similarity).alias("linked"))
    member = materialise(member.join(classes.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    heads = member.select("leader").distinct().join(classes.withColumnRenamed("node", "leader"), "leader", "left").select("leader", F.coalesce("component", "leader").alias("component"))
    several = member.select("leader", "component").unionByName(heads).groupBy("leader").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    several = materialise(several.select("leader"))
    more = materialise(verified(across_classes(member.join(several, "leader"), grams, similarity)).where(F.col("likeness") >= similarity).select("x", "y"))
    if more.limit(1).count():
        classes = connected_components(linked.unionByName(more), "x", "y")
    named = ids.join(classes.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = materialise(named)
    for used in (marks, copies, ids, members, grams, star, member, several, more, classes):
        discard(used)
    return named, again


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, copy_of (least id with an equal text), class_id (least id of its class).

    Two texts are linked if their sets of ``width``-word shingles have a Jaccard similarity of
    ``similarity`` or more, and classes are what links connect. Shingles weigh 1 here, for which the
    probability Jaccard of the sketches is the Jaccard similarity. A linked pair shares one of
    the bands but for a chance of (1 - similarity**rows)**bands, 6e-5 at 0.8.

    Equal texts go on as one. In each bucket all texts are verified against the bucket's least id,
    its leader. Where a leader's texts are then in several classes, pairs across classes are
    verified that can still be linked (see :func:`across_classes`). So no shared bucket loses a
    link, and a group of near copies costs one comparison per text. Only texts in buckets of two
    and more are read again. Texts are told apart by row, so ids may be null or on many rows with
    different texts; ``copy_of`` and ``class_id`` are null only where no row of theirs has an id.
    Null and empty texts are equal copies of each other. An empty table gives no rows; other
    columns are ignored.
    """
    found, _ = row_classes(docs, id_col=id_col, text_col=text_col, **how)
    # A class of one text has that text's least id.
    linked = materialise(found.where("component <> rep").select("component").distinct())
    # Written before it is summed up: under an aggregate the join is not split for the class with most rows.
    several = materialise(found.join(linked, "component", "left_semi").select("component", "copy_of"))
    least = materialise(several.groupBy("component").agg(F.min("copy_of").alias("class_id")))
    return found.join(least, "component", "left").select("doc_id", "copy_of", F.coalesce("class_id", "copy_of").alias("class_id"))


def one_of_each_class(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of ``docs`` of each class: of the least id, nulls last, then of the least hash of the text; all columns stay.

    Of rows that are there several times with that id and text the one with the least hash of all columns stays.
    """
    found, again = row_classes(docs, id_col=id_col, text_col=text_col, **how)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "a", "b"))
    kept = materialise(found.groupBy("component").agg(first.alias("f")).select(F.col("f.key").alias("_key"), F.col("f.a").alias("_a"), F.col("f.b").alias("_b")))
    text, at = F.coalesce(F.col(text_col).cast("string"), F.lit("")), ["_key", "_a", "_b"]
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole"), key.alias("_key"), F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b"))
    rows = rows.join(kept, at, "left_semi")
    if again.limit(1).count():
        several = again.toDF(*at)
        one = rows.join(several, at, "left_semi").groupBy(*at).agg(F.min_by("_whole", F.xxhash64(F.to_json("_whole"))).alias("_whole"))
        rows = rows.join(several, at, "left_anti").select("_whole").unionByName(one.select("_whole"))
    return rows.select("_whole.*")
