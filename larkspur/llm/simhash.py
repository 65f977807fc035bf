"""SimHash fingerprints and their neighbourhoods, in DataFrame functions alone."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.operators.graph import connected_components
from larkspur.sources.tables import discard, materialise

#: Terms are pairs of neighbouring words (the last word stands alone); group 1 overlaps the matches.
TERM = r"(?=(\S+(?:\s+\S+)?))\S+"
LANES = 0x0000000100000001
HEAVIEST = 16


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(1))


def fingerprints(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """One row per distinct ``keys`` with its 64-bit fingerprint (long).

    Each term votes with its length in characters, at most 16, on every bit of its hash. Sums
    for bits j and j + 32 share a long, so 32 sums hold all votes; they are added up where the
    text is read before anything is shuffled. A text without terms has fingerprint 0.
    """
    hashed = rows.select(*keys, F.explode_outer(terms(F.col(text_col))).alias("_term"))
    # least() passes over nulls, so the term that a text without terms has must be told apart.
    weight = F.when(F.col("_term").isNotNull(), F.least(F.length("_term"), F.lit(HEAVIEST))).otherwise(0).cast("long")
    hashed = hashed.select(*keys, F.xxhash64("_term").alias("_hash"), weight.alias("_weight"))
    votes = [F.sum(F.shiftrightunsigned("_hash", j).bitwiseAND(F.lit(LANES)) * F.col("_weight")).alias(f"_v{j}") for j in range(32)]
    summed = hashed.groupBy(*keys).agg(F.sum("_weight").alias("_all"), *votes)
    bits = []
    for j in range(32):
        low, high = F.col(f"_v{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_v{j}", 32)
        bits.append(F.when(low * 2 > F.col("_all"), F.lit(1 << j)).otherwise(F.lit(0)).cast("long"))
        bits.append(F.when(high * 2 > F.col("_all"), F.lit((1 << (j + 32)) - (1 << 64 if j == 31 else 0))).otherwise(F.lit(0)).cast("long"))
    return summed.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits of two fingerprints."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def ordered_neighbours(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int = 5_000, most_ranges: int = 100_000) -> DataFrame:
    """Rows (doc_id, text, range, place, next_text, extra) in ascending id, null ids first; after the last comes the first.

    Rows are ordered by id and then by a hash of the text, and that order is cut into ranges at a
    sample of it, so an id on many rows is cut too; only equal rows stay together. The first row
    of each range is sent once more, as ``extra``, behind the range before it, so no window spans
    more than a range. The driver holds some ten sampled places a range, at most a million.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("at", F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("hash")))
    count, least = rows.agg(F.count(F.lit(1)), F.min("at")).first()
    if not count:
        return rows.select("doc_id", "text", F.lit(0).alias("range"), F.lit(0).alias("place"), F.lit("").alias("next_text"), F.lit(False).alias("extra"))
    parts = max(1, min(most_ranges, count // rows_per_range))
    share = int(min(1.0, 10 * parts / count) * (1 << 30)) + 1
    # Drawn by a hash of their own, which neither id nor text order follows.
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(7), "at"), F.lit(1 << 30)) < share).select("at").distinct()
    places = drawn.select("at.key", "at.hash").orderBy("key", "hash").toArrow().to_pydict() if parts > 1 else {"key": [], "hash": []}
    step = max(1, len(places["key"]) // parts)
    cuts = [c for c in zip(places["key"][::step], places["hash"][::step], strict=True) if c > tuple(least)]
    kind = "array<struct<key:bigint,hash:bigint>>"
    table = docs.sparkSession.createDataFrame([(cuts,)], f"cuts {kind}").select("cuts").scalar()
    ranged = rows.withColumn("_cuts", table)
    # The number of cuts at or before a row, by halving what is left of them.
    halves = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))

    def halve(span: Column, _: Column) -> Column:
        middle = ((span["low"] + span["high"]) / 2).cast("int")
        behind = F.col("at") >= F.get("_cuts", middle)
        return F.when(span["low"] >= span["high"], span).otherwise(F.struct(F.when(behind, middle + 1).otherwise(span["low"]).alias("low"), F.when(behind, span["high"]).otherwise(middle).alias("high")))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    ranged = ranged.withColumn("range", F.aggregate(halves, start, halve)["low"])
    begins = F.col("at") == F.get("_cuts", F.col("range") - 1)
    first_of = F.when(F.col("at") == F.struct(F.lit(least.key).alias("key"), F.lit(least.hash).alias("hash")), F.lit(len(cuts))).when(begins, F.col("range") - 1)
    own = F.struct(F.col("range").alias("to"), F.lit(False).alias("extra"))
    sent = F.explode(F.when(first_of.isNotNull(), F.array(own, F.struct(first_of.alias("to"), F.lit(True).alias("extra")))).otherwise(F.array(own)))
    dealt = ranged.select("doc_id", "text", "at", sent.alias("sent")).select("doc_id", "text", "at", F.col("sent.to").alias("range"), F.col("sent.extra").alias("extra"))
    order = Window.partitionBy("range").orderBy("extra", "at", "text")
    return dealt.select("doc_id", "text", "range", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"), "extra")


def edited_neighbours(docs: DataFrame, *, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every whole text and its edited text: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, has_near, n_near, near_class.

    The edited text has its last quarter of code points replaced by the first as many (or all)
    of the next document's, ascending id, after the last the first. ``n_near``: how many other documents'
    fingerprints are at most ``radius`` bits away; ``has_near``: whether one is; ``near_class``: the least fingerprint
    that such links lead to (see :func:`with_neighbours`). A null text is empty; two
    empty texts are alike (1). Among rows of one id the hash of the text orders; an only document
    is its own next. Repeated rows stay row by row; other columns are ignored.
    """
    rows = ordered_neighbours(docs, id_col, text_col)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.when(F.col("extra"), F.lit("")).otherwise(F.coalesce(edited, "text")))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    kinds = F.explode(F.when(F.col("extra"), F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("edited").alias("t")))))
    keys = ["range", "place", "extra", "doc_id", "n_chars", "edited_sha256"]
    both = rows.select(*keys, kinds.alias("v")).select(*keys, F.col("v.k").alias("kind"), F.col("v.t").alias("body"))
    printed = fingerprints(both, [*keys, "kind"], "body")
    order = Window.partitionBy("range").orderBy("place", "kind")
    own = F.when(F.col("kind") == 0, F.col("fingerprint"))
    # Behind each text's own print stand its edited text's and then the next text's.
    printed = printed.withColumn("edited_print", F.lead("fingerprint", 1).over(order)).withColumn("next_print", F.lead("fingerprint", 2).over(order))
    kept = printed.where((F.col("kind") == 0) & ~F.col("extra"))
    kept = materialise(kept.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_print", likeness(F.col("fingerprint"), F.col("edited_print")).alias("near_edited"), likeness(F.col("fingerprint"), F.coalesce("next_print", "fingerprint")).alias("near_next")))
    kept = kept.join(with_neighbours(kept, radius), "fingerprint")
    return kept.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("fingerprint")).alias("fingerprint"), as_hex(F.col("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next", (F.col("n_near") > 0).alias("has_near"), "n_near", as_hex(F.col("near_class")).alias("near_class"))


def block_tables(prints: DataFrame, name: str, radius: int, blocks: int | None = None) -> DataFrame:
    """(name, table, key) of each row's fingerprint ``name``.

    The 64 bits are cut into ``blocks`` (radius + 2 by default); two fingerprints within the radius
    agree on at least blocks - radius of them, so one table for each choice of that many blocks,
    its bits permuted to the front as the key, brings every pair together.
    """
    blocks = blocks or radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    chosen = [sum(masks[k] for k in some) for some in combinations(range(blocks), blocks - radius)]
    keys = F.array(*(F.struct(F.lit(k).alias("table"), F.col(name).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for k, m in enumerate(chosen)))
    return prints.select(name, F.explode(keys).alias("_b")).select(name, F.col("_b.table").alias("table"), F.col("_b.key").alias("key"))


def with_neighbours(prints: DataFrame, radius: int = 3, *, print_col: str = "fingerprint") -> DataFrame:
    """(fingerprint, n_near, near_class): every distinct fingerprint (long) with all that lies at most ``radius`` bits from it.

    ``n_near``: how many other rows have that fingerprint or one within the radius; none is left out. ``near_class``: the least
    fingerprint that links of at most ``radius`` bits lead to. Pairs of different fingerprints come from
    :func:`block_tables`; rows of equal ones are counted as one, so copies cost rows, not pairs. Null fingerprints take no part.
    """
    counted = materialise(prints.where(F.col(print_col).isNotNull()).groupBy(F.col(print_col).alias("_q")).agg(F.count(F.lit(1)).alias("n")))
    keyed = materialise(block_tables(counted, "_q", radius))
    other = keyed.select(F.col("_q").alias("_d"), F.col("table").alias("_t"), F.col("key").alias("_k"))
    close = (F.col("_q") < F.col("_d")) & (F.bit_count(F.col("_q").bitwiseXOR(F.col("_d"))) <= radius)
    pairs = materialise(keyed.join(other, (F.col("table") == F.col("_t")) & (F.col("key") == F.col("_k")) & close).select("_q", "_d").distinct())
    ways = pairs.unionByName(pairs.select(F.col("_d").alias("_q"), F.col("_q").alias("_d")))
    beside = ways.join(counted.select(F.col("_q").alias("_d"), "n"), "_d").groupBy("_q").agg(F.sum("n").alias("beside"))
    # Contracted to the last edge, so that no Python worker joins up the rest.
    classes = connected_components(pairs, "_q", "_d", last=0)
    told = counted.join(beside, "_q", "left").join(classes.withColumnsRenamed({"node": "_q", "component": "least"}), "_q", "left")
    # Written: right on an aggregate, a join back to the fingerprint with most rows would not be split.
    told = materialise(told.select(F.col("_q").alias(print_col), (F.col("n") - 1 + F.coalesce("beside", F.lit(0))).alias("n_near"), F.coalesce("least", "_q").alias("near_class")))
    for used in (counted, keyed, pairs):
        discard(used)
    return told


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = 3, *, blocks: int | None = None, id_col: str = "doc_id", print_col: str = "fingerprint") -> DataFrame:
    """All (query_id, doc_id, distance) of fingerprints (long) at most ``radius`` bits apart, a row itself left out.

    Pairs come from :func:`block_tables`. Equal fingerprints are joined as one, so a group of copies
    meets as one key; its members come back only for a stated query. Null fingerprints take no part.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return block_tables(df.where(F.col(print_col).isNotNull()).select(F.col(print_col).alias(name)).distinct(), name, radius, blocks)

    distance = F.bit_count(F.col("_q").bitwiseXOR(F.col("_d")))
    met = keyed(queries, "_q").join(keyed(prints, "_d"), ["table", "key"]).where(distance <= radius)
    met = met.select("_q", "_d", distance.cast("int").alias("distance")).distinct()
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(print_col).alias("_q"))
    there = prints.select(F.col(id_col).alias("doc_id"), F.col(print_col).alias("_d"))
    return asked.join(met, "_q").join(there, "_d").where("query_id <> doc_id").select("query_id", "doc_id", "distance")


def neighbouring_prints(prints: DataFrame, queries: DataFrame, radius: int = 3, *, id_col: str = "doc_id", print_col: str = "fingerprint") -> DataFrame:
    """(fingerprint, near, distance, n_asked, n_docs, least_id): every two fingerprints (long) of a query and of a row at most ``radius`` bits apart.

    Each fingerprint stands for all its rows: ``n_asked`` of the queries have the one, ``n_docs`` of the rows the other, of which ``least_id`` is
    the least id, and equal fingerprints are a pair too (of distance 0, with the queries themselves among the rows). So copies
    cost rows, not pairs. Pairs come from :func:`block_tables`. Null fingerprints take no part; an empty table gives no rows.
    """
    asked = materialise(queries.where(F.col(print_col).isNotNull()).groupBy(F.col(print_col).alias("_q")).agg(F.count(F.lit(1)).alias("n_asked")))
    there = materialise(prints.where(F.col(print_col).isNotNull()).groupBy(F.col(print_col).alias("_d")).agg(F.count(F.lit(1)).alias("n_docs"), F.min(id_col).alias("least_id")))
    distance = F.bit_count(F.col("_q").bitwiseXOR(F.col("_d")))
    met = block_tables(asked.select("_q"), "_q", radius).join(block_tables(there.select("_d"), "_d", radius), ["table", "key"]).where(distance <= radius)
    met = met.select("_q", "_d", distance.cast("int").alias("distance")).distinct()
    return met.join(asked, "_q").join(there, "_d").select(F.col("_q").alias("fingerprint"), F.col("_d").alias("near"), "distance", "n_asked", "n_docs", "least_id")
