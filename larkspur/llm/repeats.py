"""Removal of repeated byte strings by winnowed positions and doubled hashes over synchronised positions.

Ranks of all prefixes of all positions would be many times the text. Only positions that a text's
own content selects are ranked: in every string of the threshold's length, the place with the least
hash of a short prefix. Equal strings select the same place, so a repeated string has a place
whose rank is repeated, and each round drops what has become unique:

1. rank by the first prefix (hashes doubled from 1 byte up in each text), unique places drop;
2. rank by the pair of that rank and everything that any string selecting the place covers:
   places of equal rank are repeated wholly and are done;
3. places that remain lie at the ends of repeats, and are compared with one place of each rank of
   round 2: byte by byte in both directions where the prefix's group is small, else by counting
   strings, in one task up to 20,000 places and over the cluster beyond.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import slices
from larkspur.llm.prefix_doubling import joined as _joined
from larkspur.llm.prefix_doubling import prefix_hashes, repeated_ranges
from larkspur.sources.tables import discard, materialise

PLACES = "array<struct<rank:long,span:long,at:long,back:int,ahead:int,same:int>>"
RANGES = "array<struct<begin:long,end:long>>"


@dataclass(frozen=True)
class Shape:
    """``length``: of the strings; ``prefix``: of the selecting prefix; ``base``: of the hashes that spans are made of.

    A text longer than ``piece`` is ranked in pieces that overlap. Of the places of one prefix up to
    ``small_group`` are compared pair by pair, and up to ``whole_group`` meet in one task at all. None
    of the three changes the result.
    """

    length: int
    piece: int = 1 << 20
    small_group: int = 64
    whole_group: int = 20_000

    @property
    def prefix(self) -> int:
        return max(1, self.length // 4)

    @property
    def base(self) -> int:
        return 1 << (self.length.bit_length() - 1)


def selected_places(texts: list[bytes], shape: Shape) -> tuple[np.ndarray, ...]:
    """(text, rank, span, at, back, ahead) of the selected places of all texts.

    Strings that begin ``back`` to ``ahead`` bytes before the place select it.
    """
    length, window = shape.length, shape.length - shape.prefix + 1
    parts, owners, offsets = [], [], []
    for k, text in enumerate(texts):
        for begin in range(0, len(text) - length + 1, shape.piece):
            parts.append(text[begin : begin + shape.piece + length - 1])
            owners.append(k)
            offsets.append(begin)
    empty = np.zeros(0, np.int64)
    if not parts:
        return (empty,) * 6
    data = np.frombuffer(b"".join(parts) + bytes(2 * length), dtype=np.uint8)
    hashes = prefix_hashes(data, {shape.prefix, shape.base})
    least = (hashes[shape.prefix] & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(data), dtype=np.uint64)
    width = 1
    while 2 * width <= window:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if window > width:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes) - sizes
    strings = sizes - length + 1
    number = np.repeat(np.arange(len(parts)), strings)
    at = np.arange(len(number)) - np.repeat(np.cumsum(strings) - strings, strings) + begins[number]
    place = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(place)) - 1
    low, high, place, number = at[first], at[last], place[first], number[first]
    spans, extent = (high - low).astype(np.uint64), high - low + length - shape.base
    for j in range(4):
        spans = _joined(spans, hashes[shape.base][low + extent * j // 3])
    inside = np.array(offsets)[number] - begins[number]
    return np.array(owners)[number], hashes[shape.prefix][place].astype(np.int64), spans.astype(np.int64), place + inside, place - low, place - high


def merged(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of one owner that touch or overlap as one, by owner and begin."""
    order = np.lexsort((begin, owner))
    owner, begin, end = owner[order], begin[order], end[order]
    # Each owner's ranges lie behind all of the owner before it.
    shift = owner * (end.max(initial=0) + 1)
    reach = np.maximum.accumulate(end + shift)
    first = np.flatnonzero(np.append(True, begin[1:] + shift[1:] > reach[:-1])) if len(owner) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(owner)) - 1 if len(owner) else first
    return owner[first], begin[first], reach[last] - shift[last]


def told_once(found: tuple[np.ndarray, ...], length: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(places with their number in the text, ranges of those there more than once), of one row for each text, rank, span and reach.

    Places of one text that are equal in all that any string selecting them covers, as in a run of
    one character, are repeated by this alone; the rest of the work meets them as one place.
    """
    owner, rank, span, at, back, ahead = found
    kind = _joined(_joined(_joined(rank.view(np.uint64), span.view(np.uint64)), back.astype(np.uint64)), ahead.astype(np.uint64))
    order = np.lexsort((at, kind, owner))
    same = (kind[order[1:]] == kind[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    first = np.flatnonzero(np.append(True, ~same)) if len(order) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(order)))
    several = order[np.repeat(count > 1, count)]
    ranges = merged(owner[several], (at - back)[several], (at - ahead)[several] + length)
    kept = order[first]
    return (*(c[kept] for c in found), count), ranges


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(_key(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("key", "text", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))


def repeated_spans(docs: DataFrame, shape: Shape, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, whole, spans): for each distinct text, by two hashes, that holds a repeated string.

    ``whole``: the text is there more than once and no shorter than ``length``. ``spans``: array of
    (begin, end) bytes, which may overlap. Counts are pre-aggregated and joins split, so a string on
    a third of all documents is not one task's; only groups of at most ``shape.whole_group`` places meet whole.
    """
    length = shape.length
    texts = _texts(docs, id_col, text_col)

    def listed(owner: np.ndarray, columns: tuple, kinds: tuple, names: tuple, rows: int) -> pa.ListArray:
        structs = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), structs)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, chars=1_000_000):
            places, ranges = told_once(selected_places(batch.column("text").cast(pa.binary()).to_pylist(), shape), length)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            lists = listed(places[0], places[1:], kinds, ("rank", "span", "at", "back", "ahead", "same"), batch.num_rows)
            own = listed(ranges[0], ranges[1:], (pa.int64(), pa.int64()), ("begin", "end"), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("a"), batch.column("b"), pa.array(np.asarray(batch.column("size")) >= length), lists, own], names=["key", "a", "b", "long", "places", "own"])

    ranked = texts.select("key", "a", "b", F.octet_length("text").alias("size"), "text").mapInArrow(rank, f"key long, a long, b long, long boolean, places {PLACES}, own {RANGES}")
    ranked = materialise(ranked.withColumn("row", F.monotonically_increasing_id()))
    copies = materialise(ranked.groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"), F.min("key").alias("key"), F.first("long").alias("long")))
    one = materialise(ranked.select("row", "places", "own").join(copies.where("long").drop("long"), "row"))
    discard(ranked)
    places = one.select("a", "b", "key", "copies", F.explode("places").alias("p")).select("a", "b", "key", "copies", "p.*")
    # Counts are written before they are joined back: right on an aggregate, the join of a rank with most places is not split.
    repeated = materialise(places.groupBy("rank").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    places = materialise(places.join(repeated, "rank"))
    kind = ["rank", "span", "back", "ahead"]
    groups = places.groupBy(*kind).agg(F.sum(F.col("copies") * F.col("same")).alias("times"), F.min(F.struct("a", "b", "at")).alias("first"))
    groups = materialise(groups)
    unsure = materialise(groups.where("times = 1").groupBy("rank").agg(F.count(F.lit(1)).alias("_n")).select("rank"))
    shared = groups.where("times > 1").drop("first")
    # Those with equals in their own text are in ``own`` already.
    done = places.where("copies = 1 and same = 1").join(shared, kind).select("a", "b", (F.col("at") - F.col("back")).alias("begin"), (F.col("at") - F.col("ahead") + length).alias("end"))
    # Compared: every place that is alone in its span, and one of each repeated span of the same rank.
    compared = groups.join(unsure, "rank").select(F.col("first.a").alias("a"), F.col("first.b").alias("b"), F.col("first.at").alias("at"), "rank", "back", "ahead", (F.col("times") == 1).alias("alone"))
    compared = materialise(compared)
    sizes = materialise(compared.groupBy("rank").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    asked = compared.join(sizes, "rank").groupBy("a", "b").agg(F.collect_list(F.struct("rank", "at", "back", "ahead", "alone", "members")).alias("asked"))
    asked = asked.join(copies.select("a", "b", "key"), ["a", "b"])

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes around a place, from the first to the last string's end; for the largest groups a row for each string."""
        for batch in slices(batches, chars=2_000_000):
            out: list[tuple] = []
            for text, a, b, places in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                for p in places:
                    low, high = p["at"] - p["back"], p["at"] - p["ahead"]
                    if p["members"] <= shape.whole_group:
                        out.append((a, b, p["rank"], p["at"], p["back"], p["ahead"], p["alone"], text[low : high + length]))
                    else:
                        for begin in range(low, high + 1):
                            digest = sha256(text[begin : begin + length]).digest()[:16]
                            out.append((a, b, p["rank"], p["at"], p["at"] - begin, -1, p["alone"], digest))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["a", "b", "rank", "at", "back", "ahead", "alone", "data"])

    met = texts.join(asked.hint("shuffle_hash"), ["a", "b", "key"]).select("a", "b", "text", "asked")
    contexts = materialise(met.mapInArrow(context, "a long, b long, rank long, at long, back int, ahead int, alone boolean, data binary"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by rank; the last rank of a batch may go on in the next."""
        rest = None
        names = ["a", "b", "begin", "end"]
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            ranks = np.asarray(table.column("rank").combine_chunks())
            whole = int(np.searchsorted(ranks, ranks[-1])) if len(ranks) else 0
            rest = table.slice(whole)
            yield pa.RecordBatch.from_arrays(_paired(table.slice(0, whole), shape), names=names)
        if rest is not None:
            yield pa.RecordBatch.from_arrays(_paired(rest, shape), names=names)

    found = "a long, b long, begin long, end long"
    small = contexts.where("ahead >= 0").repartition("rank").sortWithinPartitions("rank").mapInArrow(compare, found)
    large = contexts.where("ahead < 0").select("a", "b", "at", "back", "alone", "data").distinct()
    # A string on a place of a repeated span counts once here, which is enough beside one more.
    often = large.groupBy("data").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    large = large.where("alone").join(often, "data").select("a", "b", (F.col("at") - F.col("back")).alias("begin"), (F.col("at") - F.col("back") + length).alias("end"))
    within = one.where("copies = 1").select("a", "b", F.explode("own").alias("r")).select("a", "b", "r.begin", "r.end")
    spans = done.unionByName(small).unionByName(large).unionByName(within).groupBy("a", "b").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    every = copies.where("copies > 1 and long").select("a", "b", F.lit(True).alias("whole"), F.lit(None).cast(RANGES).alias("spans"))
    single = spans.join(copies.where("copies = 1").select("a", "b"), ["a", "b"], "left_semi").select("a", "b", F.lit(False).alias("whole"), "spans")
    return every.unionByName(single)


def spans_by_doubling(docs: DataFrame, shape: Shape, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What :func:`repeated_spans` gives, by prefix doubling over every position of each distinct text."""
    texts = _texts(docs, id_col, text_col).where(F.octet_length("text") >= shape.length)
    return repeated_ranges(texts.groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies"), F.min("text").alias("text")), shape.length)


def _paired(rows: pa.Table, shape: Shape) -> list[pa.Array]:
    """Byte ranges of strings at places ``alone`` that a place of the same rank has too."""
    length = shape.length
    n = rows.num_rows
    rank, at = np.asarray(rows.column("rank").combine_chunks()) if n else np.zeros(0, np.int64), np.asarray(rows.column("at").combine_chunks()) if n else np.zeros(0, np.int64)
    if not n:
        return [pa.array([], pa.int64())] * 4
    a, b = np.asarray(rows.column("a").combine_chunks()), np.asarray(rows.column("b").combine_chunks())
    back, ahead = np.asarray(rows.column("back").combine_chunks()).astype(np.int64), np.asarray(rows.column("ahead").combine_chunks()).astype(np.int64)
    alone = np.asarray(rows.column("alone").combine_chunks().to_numpy(zero_copy_only=False)).astype(bool)
    data = rows.column("data").to_pylist()
    before, after = np.full((n, length), -1, np.int16), np.full((n, length), -1, np.int16)
    for k, text in enumerate(data):
        whole = np.frombuffer(text, np.uint8)
        before[k, : back[k]] = whole[: back[k]][::-1]
        after[k, : len(whole) - back[k]] = whole[back[k] :]
    first = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
    size = np.diff(np.append(first, n))
    mine, theirs, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for begin, count in zip(first.tolist(), size.tolist(), strict=True):
        if count > shape.small_group:
            out.append(_counted(range(begin, begin + count), a, b, at, back, ahead, alone, data, length))
            continue
        own = begin + np.flatnonzero(alone[begin : begin + count])
        mine.append(np.repeat(own, count))
        theirs.append(np.tile(np.arange(begin, begin + count), len(own)))
    mine, theirs = np.concatenate(mine), np.concatenate(theirs)
    other = (a[mine] != a[theirs]) | (b[mine] != b[theirs]) | (at[mine] != at[theirs])
    mine, theirs = mine[other], theirs[other]
    for begin in range(0, len(mine), 20_000):
        i, j = mine[begin : begin + 20_000], theirs[begin : begin + 20_000]
        # Equal bytes to the left and from the place on; what a row does not hold equals nothing.
        left = np.where((same := (before[i] == before[j]) & (before[i] >= 0)).all(axis=1), length, same.argmin(axis=1))
        right = np.where((same := (after[i] == after[j]) & (after[i] >= 0)).all(axis=1), length, same.argmin(axis=1))
        furthest, nearest = np.minimum(left, back[i]), np.maximum(length - right, ahead[i])
        hit = furthest >= nearest
        i = i[hit]
        out.append(np.stack([a[i], b[i], at[i] - furthest[hit], at[i] - nearest[hit] + length]))
    merged = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
    return [pa.array(c) for c in merged]


def _counted(rows: range, a: np.ndarray, b: np.ndarray, at: np.ndarray, back: np.ndarray, ahead: np.ndarray, alone: np.ndarray, data: list[bytes], length: int) -> np.ndarray:
    """The same for a larger group, by counting its strings: linear in the group."""
    # A place at the edge of two pieces has a row for each, with strings of its own; of rows that a
    # repeated id brings twice one counts.
    places = np.array(list({(a[k], b[k], at[k], back[k], ahead[k]): k for k in rows}.values()))
    many = (back[places] - ahead[places] + 1).astype(np.int64)
    owner = np.repeat(places, many)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    digests = np.empty((len(owner), 2), np.uint64)
    done = 0
    for k, n in zip(places.tolist(), many.tolist(), strict=True):
        found = b"".join(xxhash.xxh3_128_digest(data[k][j : j + length]) for j in range(n))
        digests[done : done + n] = np.frombuffer(found, "<u8").reshape(-1, 2)
        done += n
    offset = back[owner] - begin
    order = np.lexsort((digests[:, 1], digests[:, 0], offset))
    same = (offset[order[1:]] == offset[order[:-1]]) & (digests[order[1:]] == digests[order[:-1]]).all(axis=1)
    twice = np.zeros(len(owner), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    hit = twice & alone[owner]
    low = at[owner[hit]] - offset[hit]
    return np.stack([a[owner[hit]], b[owner[hit]], low, low + length])


def cut(text: bytes, whole: bool, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """(kept bytes, removed bytes, maximal removed runs)."""
    if whole:
        return b"", len(text), 1
    kept, done, runs, end = [], 0, 0, -1
    for s in sorted((s["begin"], s["end"]) for s in spans or ()):
        if s[0] > end:
            kept.append(text[done : s[0]])
            runs += 1
        end = max(end, s[1])
        done = end
    kept.append(text[done:])
    left = b"".join(kept)
    return left, len(text) - len(left), runs


def remove_repeats(docs: DataFrame, *, shape: Shape = Shape(200), every_position: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` without the bytes that a repeated string of ``shape.length`` bytes covers.

    All columns stay, the text shortened (a character that lost some of its bytes goes), and
    ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` (of the bytes) come beside, replacing
    columns of those names. Repeats are judged on the input, within a text too; overlaps count; none crosses texts. Null or
    empty text: 0 bytes and no span. Copies of a text as long or longer lose everything.
    Null and repeated ids stay row by row; an empty table gives no rows. ``every_position`` doubles
    prefixes over all positions (:mod:`larkspur.llm.prefix_doubling`) instead of the selected ones: the same result.
    """
    find = spans_by_doubling if every_position else repeated_spans
    spans = find(docs, shape, id_col=id_col, text_col=text_col)
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    others = [c for c in docs.columns if c not in (*added, text_col)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carried = F.struct(*(F.col(f"`{c}`") for c in others), F.col(text_col).isNull().alias("_null"))
    rows = docs.select(carried.alias("row"), text.alias("text"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    rows = rows.join(spans, ["a", "b"], "left").select("row", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, chars=2_000_000):
            out = []
            for text, whole, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("whole").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                kept, removed, runs = cut(text, whole, spans)
                out.append((len(text), removed, runs, sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, [pa.int64()] * 3 + [pa.string()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], names=["row", *added, "kept"])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    shorter = F.when(~F.col("row._null"), F.col("kept")).alias(text_col)
    return out.select(*(shorter if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added), *added)
