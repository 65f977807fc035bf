"""TF-IDF retrieval, evidence scoring, grounded responses and decisions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import rules as R
from larkspur.functions import text as T
from larkspur.operators.classify import decision_risk, present, response_type, settled
from larkspur.sources.tables import discard, materialise

USABLE_TYPES = ("diagnostic_question", "direct_guidance")


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, tf)"""
    tokens = F.explode(T.retrieval_tokens(F.col(text_col), R.STOP_WORDS)).alias("token")
    return docs.select(F.col(id_col).alias("id"), tokens).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))


def inverse_frequencies(terms: DataFrame, documents: int) -> DataFrame:
    """idf = ln((N + 1) / (df + 1)) + 1 over all documents, those without a token too."""
    df = terms.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.select("token", "df", (F.log(F.lit(documents + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def weights(terms: DataFrame, idf: DataFrame) -> DataFrame:
    return terms.join(idf, "token").select("id", "token", (F.col("tf") * F.col("idf")).alias("w"))


def token_bags(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables (id, home, bag) and (bag, tokens, n): texts of equal tokens have one ``bag``, a number, and its tokens are sorted, repeats kept. Texts without tokens are left out."""
    rows = docs.select(F.col("message_id").alias("id"), F.col("conversation_id").alias("home"), F.col("text").alias("text"))
    rows = settled(rows, tokens=F.array_sort(T.retrieval_tokens(F.col("text"), R.STOP_WORDS))).where(F.size("tokens") > 0)
    rows = materialise(rows.select("id", "home", F.md5(F.array_join("tokens", " ").cast("binary")).alias("text"), "tokens"))
    bags = materialise(rows.groupBy("text").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).withColumn("bag", F.monotonically_increasing_id()))
    texts = materialise(rows.join(bags.select("text", "bag"), "text").select("id", "home", "bag"))
    discard(rows)
    return texts, bags


def bag_vectors(bags: DataFrame, idf: DataFrame) -> DataFrame:
    """(bag, tokens, w, norm): the numbers of a bag's tokens, their tf-idf weights and the weights' norm; tokens without an idf do not count.

    A weight is one of few numbers for each token, which shuffles small; divided by the norm hardly two are equal.
    """
    # Tokens are sorted, so a token's count is the distance from its first place to the next token's.
    rows = settled(bags.select("bag", "tokens"), own=F.array_distinct("tokens"))
    rows = settled(rows, first=F.transform("own", lambda t: F.array_position(F.col("tokens"), t)))
    count = lambda i: F.coalesce(F.get("first", i + 1), F.size("tokens") + F.lit(1).cast("long")) - F.get("first", i)
    terms = rows.select("bag", F.explode(F.transform("own", lambda t, i: F.struct(t.alias("token"), count(i).alias("tf")))).alias("t")).select("bag", "t.token", "t.tf")
    weighted = terms.join(idf.select("token", "number", "idf"), "token").select("bag", F.struct("number", (F.col("tf") * F.col("idf")).alias("w")).alias("v"))
    listed = weighted.groupBy("bag").agg(F.array_sort(F.collect_list("v")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, v: total + v["w"] * v["w"]))
    return listed.select("bag", F.col("v.number").alias("tokens"), F.col("v.w").alias("w"), norm.alias("norm"))


def first_of(rows: DataFrame, group: list[str], order: list[Column], n: int, name: str = "_r") -> DataFrame:
    """The first ``n`` rows of each group, numbered. A filter on row_number is a bounded top-n: each task drops all but its own first n
    before anything is shuffled (WindowGroupLimit), so a group with most rows is no task's."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)


def _matcher(k: int, need: int, at_once: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Made here, so that the function goes to the workers whole and they need not import this module."""

    def matched(asked: pa.Table, held: pa.Table) -> pa.Table:
        """(asked, doc_id, home, exact): of a block of documents what each text of a block of asked ones can need.

        Of each, the ``need`` best, at most k + 1 of one home, and what lies so close behind that rounding may put it before.
        """

        def lists(table: pa.Table, *names: str) -> tuple:
            columns = [table.column(c).combine_chunks() for c in names]
            return np.asarray(columns[0].value_lengths()).astype(np.int64), *(c.flatten() for c in columns)

        def unit(norm: pa.ChunkedArray, sizes: np.ndarray, w: pa.Array) -> np.ndarray:
            return np.asarray(w) / np.repeat(np.asarray(norm.combine_chunks()), sizes)

        sizes, tokens, w = lists(held, "tokens", "w")
        u = unit(held.column("norm"), sizes, w)
        vocabulary, token = np.unique(np.asarray(tokens), return_inverse=True)
        order = np.argsort(token, kind="stable")
        document, u = np.repeat(np.arange(len(sizes)), sizes)[order], u[order]
        starts = np.searchsorted(token[order], np.arange(len(vocabulary) + 1)).tolist()
        # Columns are looked at in strips of 64; a token of many documents is a whole row, added at once.
        width = -(-len(sizes) // 64) * 64
        rows = {}
        for t in np.flatnonzero(np.diff(starts) > max(64, width // 12)).tolist():
            rows[t] = np.zeros(width)
            rows[t][document[starts[t] : starts[t + 1]]] = u[starts[t] : starts[t + 1]]
        many, members = lists(held, "members")
        first_member = np.append(0, np.cumsum(many))
        homes = members.field("home")
        home = np.asarray(homes.dictionary_encode().indices.fill_null(-1))
        q_sizes, q_tokens, w = lists(asked, "asked_tokens", "asked_w")
        q_tokens, q = np.asarray(q_tokens), unit(asked.column("asked_norm"), q_sizes, w)
        place = np.minimum(np.searchsorted(vocabulary, q_tokens), max(0, len(vocabulary) - 1))
        known = vocabulary[place] == q_tokens if len(vocabulary) else np.zeros(len(q_tokens), bool)
        begins = np.append(0, np.cumsum(q_sizes)).tolist()
        out: tuple[list, list, list] = ([], [], [])
        sums = np.zeros((at_once, width))
        for begin in range(0, len(q_sizes), at_once):
            block = sums[: min(at_once, len(q_sizes) - begin)]
            block[:] = 0
            for row, i in zip(block, range(begin, begin + len(block)), strict=True):
                own = np.flatnonzero(known[begins[i] : begins[i + 1]]) + begins[i]
                for t, w in zip(place[own].tolist(), q[own].tolist(), strict=True):
                    if t in rows:
                        row += w * rows[t]
                    else:
                        row[document[starts[t] : starts[t + 1]]] += w * u[starts[t] : starts[t + 1]]
            strips = block.reshape(len(block), -1, 64).max(axis=2)
            for i, row in enumerate(block):
                met = 4 * need
                while True:
                    # As many strips reach this as documents are looked for, so at least as many documents do.
                    least = np.partition(strips[i], -met)[-met] if met < strips.shape[1] else 0.0
                    found = np.flatnonzero(row >= least) if least > 0 else np.flatnonzero(row > 0)
                    found = found[np.argsort(-row[found], kind="stable")]
                    kept, taken, cut = [], {}, -1.0
                    for d, score in zip(found.tolist(), row[found].tolist(), strict=True):
                        if score < cut:
                            break
                        for m in range(first_member[d], first_member[d + 1]):
                            of = taken.setdefault(home[m], [])
                            if len(of) <= k:
                                of.append(score)
                            elif score < of[-1] - 4e-9:
                                continue
                            kept.append((m, score))
                        if cut < 0 and sum(map(len, taken.values())) >= need:
                            cut = score - 4e-9
                    # All that reach the cut are there if what was looked at goes down to it.
                    if least <= 0 or (cut >= 0 and least <= cut):
                        break
                    met *= 8
                out[0].extend([begin + i] * len(kept))
                out[1].extend(m for m, _ in kept)
                out[2].extend(s for _, s in kept)
        take = pa.array(out[1], pa.int64())
        columns = [asked.column("asked").combine_chunks().take(pa.array(out[0], pa.int64())), members.field("doc_id").take(take), homes.take(take), pa.array(out[2], pa.float64())]
        return pa.table(columns, names=["asked", "doc_id", "home", "exact"])

    return matched


def search(corpus: DataFrame, queries: DataFrame, *, k: int = 5, first_block: int = 64, told: list[int] | None = None, documents_a_block: int = 40_000, asked_a_block: int = 40_000, least_blocks: int = 24, blocks_a_wave: int = 12) -> DataFrame:
    """(query_id, rank, doc_id, score): the k nearest by cosine, not the same message nor its conversation.

    Both frames have message_id, conversation_id and text. The result is that of comparing with every document.
    Texts of equal tokens ask once and are found once: 2k + 2 documents, at most k + 1 of a
    conversation, are enough for each of them, whatever its own conversation is, which takes k + 1 places at most.

    Documents and asked texts are dealt into blocks, and every two blocks meet in one task, where the postings of the block's
    documents are added up for ``first_block`` asked texts at a time. What leaves a task are the documents that an asked text can need
    of that block, so no pair that shares a token is ever written: shuffled are the texts' weights, once for each block
    of the other side. Blocks of asked texts come in waves, each of which meets all documents in ``blocks_a_wave`` tasks or few more, and a
    wave's shuffles go before the next: what lies on disk at once grows with the texts, not with the pairs of blocks. None of the sizes changes the result. Scores are rounded to 9 digits before they are ordered, ties to
    the smaller id. ``told`` gets the number of postings met. A null conversation finds nothing; texts without tokens ask nothing.
    """
    need, documents, alike = 2 * k + 2, corpus.count(), queries is corpus
    texts, bags = token_bags(corpus)
    own, asks = (texts, bags) if alike else token_bags(queries)
    df = bags.select("n", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("bags"))
    idf = materialise(df.select("token", "bags", (F.log(F.lit(documents + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"), F.monotonically_increasing_id().alias("number")))
    if told is not None:
        told.append(asks.select(F.explode(F.array_distinct("tokens")).alias("token")).join(idf, "token").agg(F.sum("bags")).first()[0] or 0)
    vectors = materialise(bag_vectors(bags, idf))
    asked = vectors if alike else materialise(bag_vectors(asks, idf))
    asked = asked.select(F.col("bag").alias("asked"), *(F.col(c).alias(f"asked_{c}") for c in ("tokens", "w", "norm")))

    # A null home finds and is found by nothing, so it takes no place.
    few = first_of(texts.where("home is not null").select("bag", F.col("id").alias("doc_id"), "home"), ["bag", "home"], [F.col("doc_id").asc()], k + 1).drop("_r")
    members = materialise(first_of(few, ["bag"], [F.col("doc_id").asc()], need).groupBy("bag").agg(F.collect_list(F.struct("doc_id", "home")).alias("members")))
    across, down = _blocks(members.count(), asked.count(), documents_a_block, asked_a_block, least_blocks)

    there, here = vectors.join(members, "bag").withColumn("across", F.pmod(F.xxhash64("bag"), F.lit(across))).drop("bag"), asked.withColumn("down", F.pmod(F.xxhash64("asked"), F.lit(down)))
    kinds, parts, at_once = dict(texts.dtypes), [], -(-blocks_a_wave // across)
    for begin in range(0, down, at_once):
        last = min(begin + at_once, down) - 1
        held = there.withColumn("down", F.explode(F.sequence(F.lit(begin), F.lit(last))))
        wave = here.where(F.col("down").between(begin, last)).withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
        pairs = (rows.withColumn("deal", F.col("across") * down + F.col("down")).drop("across", "down").groupBy("deal") for rows in (wave, held))
        met = next(pairs).cogroup(next(pairs)).applyInArrow(_matcher(k, need, first_block), f"asked long, doc_id {kinds['id']}, home {kinds['home']}, exact double")
        parts.append(materialise(met))
    met = reduce(DataFrame.unionByName, parts)
    # Dealt by asked text, rows meet for both of the windows at once.
    found, order = met.select("asked", "doc_id", "home", F.round("exact", 9).alias("score")).repartition("asked"), [F.desc("score"), F.col("doc_id").asc()]
    best = materialise(first_of(first_of(found, ["asked", "home"], order, k + 1).drop("_r"), ["asked"], order, need).drop("_r"))
    for used in (bags, idf, vectors, members, *parts):
        discard(used)
    mine = own.select(F.col("id").alias("query_id"), F.col("home").alias("asked_in"), F.col("bag").alias("asked"))
    found = mine.join(best, "asked").where((F.col("asked_in") != F.col("home")) & (F.col("query_id") != F.col("doc_id")) & (F.col("score") > 0))
    out = materialise(first_of(found, ["query_id"], [F.desc("score"), F.col("doc_id").asc()], k, "rank").select("query_id", "rank", "doc_id", "score"))
    for used in (texts, best, *(() if alike else (own, asks, asked))):
        discard(used)
    return out


def _blocks(held: int, asked: int, documents_a_block: int, asked_a_block: int, least: int) -> tuple[int, int]:
    """How many blocks of documents and of asked texts: none too large, at least ``least`` pairs of blocks, and as few copies shuffled as that allows."""
    fewest, narrowest = max(1, -(-held // documents_a_block)), max(1, -(-asked // asked_a_block))
    ways = [(n, max(narrowest, -(-least // n))) for n in range(fewest, max(fewest, least) + 1)]
    return min(ways, key=lambda way: (held * way[1] + asked * way[0], way[0]))


def _words(text: Column) -> Column:
    """The distinct tokens of a text as one string, which shuffles smaller than the text and than a list of them."""
    return F.array_join(F.array_distinct(T.retrieval_tokens(text, R.STOP_WORDS)), " ")


def results(queries: DataFrame, found: DataFrame, corpus: DataFrame) -> DataFrame:
    """Every query with its results; a query without any keeps one row of null rank.

    ``corpus`` has a ``row`` of its own for each message, as ids may repeat. What evidence needs of a text (its words, the response's type) is told before the joins, once a message; a
    frame that is built on this shuffles only the columns that it reads.
    """
    response = F.col("response")
    docs = corpus.select(
        F.col("message_id").alias("doc_id"), F.col("text").alias("doc_text"), "response", F.col("primary").alias("doc_intent"), F.transform("matches", lambda m: m["intent_id"]).alias("doc_intents"),
        _words(F.col("text")).alias("doc_words"), _words(response).alias("response_words"), response_type(response).alias("response_type"), (F.trim(F.coalesce(response, F.lit(""))) != "").alias("available"),
        F.col("row").alias("doc_row"), F.col("message_id").isNull().cast("long").alias("_dealt"),
    )
    asked = queries.select(F.col("message_id").alias("query_id"), F.col("text").alias("query"), "gold_intent", F.col("bucket").alias("query_bucket"), _words(F.col("text")).alias("query_words"))
    # Queries without results have no doc_id: dealt by it alone they would all go to one task. Any other key of theirs meets nothing.
    dealt = F.when(F.col("doc_id").isNull(), F.xxhash64("query_id")).otherwise(F.lit(0).cast("long"))
    return asked.join(found, "query_id", "left").withColumn("_dealt", dealt).join(docs, ["doc_id", "_dealt"], "left").drop("_dealt")


def is_hit() -> Column:
    return F.coalesce(F.array_contains("doc_intents", F.col("gold_intent")), F.lit(False))


def retrieval_summary(rows: DataFrame) -> DataFrame:
    """hit@1/3/5 over eligible queries, reciprocal rank over those with results, mean similarities."""
    eligible = rows.where(F.col("gold_intent").isNotNull())
    hit = is_hit()
    per = eligible.groupBy("query_id").agg(
        *(F.max(F.when(hit & (F.col("rank") <= k), 1).otherwise(0)).alias(f"hit_{k}") for k in (1, 3, 5)),
        F.min(F.when(hit, F.col("rank"))).alias("first"), F.max(F.col("rank").isNotNull().cast("int")).alias("any"),
    )
    quality = per.agg(F.count(F.lit(1)).alias("eligible"), *(F.round(F.avg(f"hit_{k}"), 6).alias(f"hit_at_{k}") for k in (1, 3, 5)), F.round(F.avg(F.when(F.col("any") == 1, F.coalesce(1 / F.col("first"), F.lit(0.0)))), 6).alias("mrr"))
    means = rows.agg(F.count_distinct("query_id").alias("queries"), F.count_if(F.col("rank").isNull()).alias("failures"), F.round(F.avg(F.when(F.col("rank") == 1, F.col("score"))), 6).alias("mean_top"), F.round(F.avg("score"), 6).alias("mean_all"))
    return quality.join(means)  # one row each


def evidence(rows: DataFrame) -> DataFrame:
    """Score, strength, flags and response type of every row of :func:`results`."""
    q, c, r = (F.array_remove(F.split(F.coalesce(x, F.lit("")), " "), "") for x in ("query_words", "doc_words", "response_words"))
    out = settled(rows, _q=q, _c=c, _r=r)
    out = settled(out, qc=T.overlap_score(F.col("_q"), F.col("_c")), qr=T.overlap_score(F.col("_q"), F.col("_r"))).drop("_q", "_c", "_r", "query_words", "doc_words", "response_words")
    there, kind = F.coalesce("available", F.lit(False)), F.coalesce("response_type", F.lit("none"))
    score = F.when(there, 0.35).otherwise(0.0) + 0.25 * F.least("qc", F.lit(1.0)) + 0.25 * F.least("qr", F.lit(1.0))
    out = settled(out, available=there, evidence_score=F.round(score, 6), response_type=kind)
    strength = F.when(F.col("evidence_score") >= 0.65, "strong").when(F.col("evidence_score") >= 0.35, "moderate").otherwise("weak")
    out = out.withColumn("strength", strength)
    flags = present(
        F.when(F.col("available"), "historical_response_available").otherwise("no_historical_response"),
        F.when(F.col("qc") >= 0.35, "strong_query_customer_overlap").when(F.col("qc") >= 0.15, "some_query_customer_overlap").otherwise("weak_query_customer_overlap"),
        F.when(F.col("qr") >= 0.25, "response_lexically_related").when(F.col("qr") > 0, "limited_response_overlap").otherwise("no_response_overlap"),
        F.when(F.col("gold_intent").isNull(), "intent_metric_ineligible").when(is_hit(), "curated_intent_agreement").otherwise("curated_intent_mismatch_or_unavailable"),
        F.concat(F.col("strength"), F.lit("_deterministic_evidence")),
    )
    return out.withColumn("flags", F.array_join(flags, ","))


def usable(rows: DataFrame, least: float = 0.35) -> DataFrame:
    return rows.where(F.col("available") & (F.col("evidence_score") >= least) & F.col("response_type").isin(*USABLE_TYPES))


def grounded(queries: DataFrame, rows: DataFrame, corpus: DataFrame, least: float = 0.35) -> DataFrame:
    """Each query with its best usable response: highest score, then rank, then id.

    The response is fetched by its ``row`` of the corpus, for the best alone, which are written first: evidence is done with, and
    its shuffles gone, when the texts are moved. What decisions need of the texts is told
    before they are joined, so that decisions without texts shuffle none.
    """
    slim = usable(rows, least).select("query_id", "rank", "doc_id", "doc_row", "evidence_score", "response_type")
    best = materialise(first_of(slim, ["query_id"], [F.desc("evidence_score"), F.col("rank").asc(), F.col("doc_id").asc(), F.col("doc_row").asc()], 1).drop("_r"))
    empty = F.coalesce("response", F.lit("")) == ""
    best = best.join(corpus.select(F.col("row").alias("doc_row"), F.col("response").alias("generated_response"), empty.alias("unanswered")), "doc_row")
    best = best.select("query_id", "doc_id", "evidence_score", "response_type", "generated_response", "unanswered")
    asked = queries.select(F.col("message_id").alias("query_id"), F.col("text").alias("query"), "gold_intent", "bucket", decision_risk(F.col("text")).alias("risk"))
    return asked.join(best, "query_id", "left")


def decide(responses: DataFrame, least: float = 0.35) -> DataFrame:
    """auto_handle or escalate with the first reason that holds, of rows of :func:`grounded`."""
    weak = F.col("evidence_score").isNull() | (F.col("evidence_score") < least)
    unclear = F.col("gold_intent").isNull() & F.col("bucket").isin("ambiguous", "multi_intent", "unclassified")
    reason = (
        F.when(F.col("risk").isNotNull(), F.col("risk"))
        .when(F.col("doc_id").isNull(), "insufficient_historical_evidence")
        .when(F.col("unanswered"), "no_grounded_response")
        .when(F.col("response_type") == "generic_routing", "generic_routing_only")
        .when(~F.col("response_type").isin(*USABLE_TYPES), "other_safety_or_grounding_concern")
        .when(weak, "insufficient_historical_evidence")
        .when(unclear, "ambiguous_request")
    )
    out = settled(responses, escalation_reason=reason).withColumn("decision", F.when(F.col("escalation_reason").isNull(), "auto_handle").otherwise("escalate"))
    return out.withColumn("generated_response", F.when(F.col("decision") == "auto_handle", F.col("generated_response")))
