"""Named queries: each operator over the support messages or the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from larkspur.functions import rules as R
from larkspur.functions import text as T
from larkspur.operators import annotate, classify, evaluate, retrieval, sampling
from larkspur.operators import conversations as C
from larkspur.operators.graph import connected_components
from larkspur.plans.fixture import support_messages
from larkspur.plans.oracles import ORACLE_SQL
from larkspur.sources import files
from larkspur.sources.tables import discard, materialise, scratch, still_there, table, version
from larkspur.streaming import rules as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Sizes of a pool and a golden set that fit the small tables; ``rules`` has those of the product.
POOL_QUOTAS = {"primary_intent": 60, "unclassified": 26, "multi_intent": 24, "ambiguous": 15}
GOLDEN_GROUPS = [*(("primary_intent", intent, k // 3) for intent, k in R.INTENT_QUOTAS), ("unclassified", "", 10), ("multi_intent", "", 8), ("ambiguous", "", 8)]
#: What was retrieved of the table last asked for, written once for all queries that build on them. The key tells the
#: table's files by size and time of change, so rows of a table that has changed since are never served.
_RETRIEVED: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def n(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def classified(spark: SparkSession, sf: str) -> DataFrame:
    messages = C.ordered_messages(support_messages(spark, sf)).where("role = 'customer_message'")
    return classify.classify_messages(messages)


def corpus_of(spark: SparkSession, sf: str) -> DataFrame:
    """The retrieval corpus: customer messages, the brand's next message, heuristic intents."""
    return classify.classify_messages(C.immediate_responses(support_messages(spark, sf)))


def asked(corpus: DataFrame) -> DataFrame:
    """Every customer message as a query; its intent counts as gold where it is the only one."""
    return corpus.withColumn("gold_intent", F.when(F.col("bucket") == "primary_intent", F.col("primary")))


def retrieved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(queries, their results): the messages and the ids found for each are written in the shared folder once a session and state
    of the table, and joined by each query with the columns that it needs. Every message of the corpus asks, so ``queries`` has the corpus's columns."""
    key = (spark.sparkContext.applicationId, sf, *version(table(spark, sf, "conversations")))
    if key not in _RETRIEVED or not all(map(still_there, _RETRIEVED[key])):
        kept = ("message_id", "conversation_id", "text", "response", "primary", "bucket", "matches")
        corpus = materialise(corpus_of(spark, sf).select(*kept, F.monotonically_increasing_id().alias("row")))
        queries, texts = asked(corpus), corpus.select("message_id", "conversation_id", "text")
        rows = retrieval.results(queries, retrieval.search(texts, texts), corpus)
        forget_retrieved()
        _RETRIEVED[key] = queries, rows
    return _RETRIEVED[key]


def forget_retrieved() -> None:
    """The next query that needs what :func:`retrieved` wrote retrieves again. The files stay for frames that are still to read them."""
    _RETRIEVED.clear()


def decided(spark: SparkSession, sf: str) -> DataFrame:
    queries, rows = retrieved(spark, sf)
    return retrieval.decide(retrieval.grounded(queries, retrieval.evidence(rows), queries))


def joined(column: str, key: str | None = None) -> Column:
    return F.array_join(F.transform(column, lambda m: m[key]) if key else F.col(column), ",")


@query
def scan_filter(spark, sf):
    return support_messages(spark, sf).where("role = 'brand_response' and author_id = 'brand1' and message_id <> ''").select("message_id", "created_at")


@query
def brand_messages(spark, sf):
    return C.outbound(support_messages(spark, sf)).where("author_id = 'brand2'").select("message_id", "conversation_id")


@query
def unnest_messages(spark, sf):
    return C.unnest(C.nested(support_messages(spark, sf))).select("conversation_id", "conversation_length", "place", "message_id", "role")


@query
def audit_counts(spark, sf):
    return C.audit(support_messages(spark, sf))


@query
def outbound_by_author(spark, sf):
    return C.author_volumes(support_messages(spark, sf))


@query
def top_brands(spark, sf):
    return C.top_brands(support_messages(spark, sf), 3).select("author_id", "n")


@query
def semi_join_top_brands(spark, sf):
    messages = support_messages(spark, sf)
    return C.outbound(messages).join(C.top_brands(messages, 3), "author_id", "left_semi").select("message_id", "author_id")


@query
def answered_issues(spark, sf):
    return C.answered_issues(support_messages(spark, sf))


@query
def linked_replies(spark, sf):
    return C.linked_replies(support_messages(spark, sf))


@query
def response_links(spark, sf):
    return C.response_links(support_messages(spark, sf))


@query
def related_inbound(spark, sf):
    return C.related_inbound(support_messages(spark, sf), "brand1").select("message_id")


@query
def link_flags(spark, sf):
    return C.link_flags(support_messages(spark, sf), "brand1")


@query
def token_freq(spark, sf):
    return C.token_frequencies(support_messages(spark, sf))


@query
def topical_tokens(spark, sf):
    return C.token_frequencies(support_messages(spark, sf)).where("n >= 3").groupBy("brand").agg(n("topics"))


@query
def distinct_customers(spark, sf):
    return C.inbound(support_messages(spark, sf)).agg(F.count_distinct("author_id").alias("customers"))


@query
def connected_components_of_replies(spark, sf):
    return connected_components(C.reply_edges(support_messages(spark, sf)))


@query
def component_sizes(spark, sf):
    sizes = connected_components(C.reply_edges(support_messages(spark, sf))).groupBy("component").agg(n("size"))
    return sizes.groupBy("size").agg(n("components"))


@query
def conversation_order(spark, sf):
    return C.ordered_messages(support_messages(spark, sf)).select("conversation_id", "pos", "message_id", "conversation_length")


@query
def conversation_stats(spark, sf):
    return C.conversation_stats(support_messages(spark, sf))


@query
def immediate_response(spark, sf):
    return C.immediate_responses(support_messages(spark, sf)).select("message_id", "response_id")


@query
def brand_score(spark, sf):
    return C.brand_scores(support_messages(spark, sf), eligible_from=20)


@query
def brand_ranking(spark, sf):
    return C.brand_ranking(C.brand_scores(support_messages(spark, sf), eligible_from=20)).select("rank", "brand")


@query
def component_conversations(spark, sf):
    """The conversations of one brand, rebuilt from links alone."""
    rows = C.ordered_messages(C.brand_conversations(support_messages(spark, sf), "brand1"), "conversation")
    return rows.select("conversation", "pos", "message_id", "conversation_length")


@query
def conversation_list(spark, sf):
    return C.conversation_list(C.brand_conversations(support_messages(spark, sf), "brand1"), "conversation")


@query
def component_stats(spark, sf):
    return C.conversation_stats(C.conversations_of(support_messages(spark, sf)), "conversation")


@query
def intent_volumes(spark, sf):
    """Messages by hour and intent; the same expression counts a stream."""
    return streams.intent_volumes(support_messages(spark, sf).where("role = 'customer_message'")).select(F.col("window.start").cast("string").alias("begins"), F.col("primary").alias("intent_id"), "n")


@query
def utc_times(spark, sf):
    return support_messages(spark, sf).select("message_id", T.utc_iso(F.col("created_at")).alias("created_at_utc"))


@query
def intent_match(spark, sf):
    rows = classified(spark, sf).select("message_id", F.explode("matches").alias("m"))
    return rows.select("message_id", "m.intent_id", F.size("m.evidence").alias("n_patterns"), F.array_join("m.evidence", " ").alias("patterns"))


@query
def intent_primary(spark, sf):
    return classified(spark, sf).select("message_id", F.col("primary").alias("primary_intent"), "bucket", "evidence_strength", "words")


@query
def non_support(spark, sf):
    return classified(spark, sf).where("non_support").select("message_id", "normal")


@query
def short_messages(spark, sf):
    return classified(spark, sf).where("words <= 3").select("message_id", "words")


@query
def taxonomy_diagnostics(spark, sf):
    rows = classified(spark, sf)
    total = rows.agg(n("all_rows"), F.count_if(F.size("matches") > 0).alias("matched_rows"))
    primary = rows.where("primary is not null").groupBy(F.col("primary").alias("intent_id")).agg(n("n_primary"))
    matched = rows.select(F.explode("matches").alias("m")).groupBy("m.intent_id").agg(n("n_matched"), F.sum(F.size("m.evidence")).alias("n_patterns"))
    out = matched.join(primary, "intent_id", "left").join(total).na.fill(0, ["n_primary"])  # total: one row
    return out.select("intent_id", "n_matched", "n_patterns", "n_primary", F.round(100 * F.col("n_primary") / F.col("all_rows"), 2).alias("pct_all"), F.round(100 * F.col("n_primary") / F.col("matched_rows"), 2).alias("pct_matched"))


@query
def pattern_freq(spark, sf):
    rows = classified(spark, sf).select(F.explode("matches").alias("m"))
    return rows.select("m.intent_id", F.explode("m.evidence").alias("pattern")).groupBy("intent_id", "pattern").agg(n())


@query
def examples_per_intent(spark, sf):
    rows = retrieval.first_of(classified(spark, sf).where("primary is not null"), ["primary"], [F.col("message_id").cast("long").asc()], 3, "example")
    return rows.select(F.col("primary").alias("intent_id"), "example", "message_id", T.concise(F.col("text")).alias("shown"))


@query
def quality_reasons(spark, sf):
    rows = classify.settled(table(spark, sf, "documents").select("doc_id", "text"), tokens=T.quality_tokens(F.col("text")))
    tokens = F.col("tokens")
    return rows.select("doc_id", F.size(tokens).alias("n_tokens"), classify.low_diversity(tokens).alias("low_diversity"), classify.repeated_token(tokens).alias("repeated"))


@query
def mojibake(spark, sf):
    """Documents, the texts of every third of which are damaged here, by what is wrong with them."""
    damaged = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" itâ€™s caf"), F.lit("Ã© I\ufe0fI\ufe0fI\ufe0fI\ufe0f"))).otherwise(F.col("text"))
    rows = table(spark, sf, "documents").select("doc_id", damaged.alias("text"))
    return classify.settled(rows, bad=classify.has_mojibake(F.col("text")), reason=classify.row_quality(F.col("text"))).select("doc_id", "bad", "reason")


@query
def invisible_characters(spark, sf):
    marked = F.concat(F.lit("\ufeff"), F.col("text"), F.lit("\u00a0\u200b"), F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.visible(marked).cast("binary")).alias("shown_md5"))


@query
def canonical_forms(spark, sf):
    """Both canonical forms of messages to which a hashtag and a link were added."""
    text = F.concat("text", F.lit(" #Late www.example.com/x"))
    rows = support_messages(spark, sf).select("message_id", T.canonical(text, keep_hashtags=True).alias("with_hashtags"), T.canonical(text).alias("without"))
    return rows


@query
def exact_dup_groups(spark, sf):
    groups = sampling.exact_duplicate_groups(table(spark, sf, "documents"))
    return groups.select(F.md5(F.col("canonical").cast("binary")).alias("canonical_md5"), "n")


@query
def near_dup_pairs(spark, sf):
    return sampling.near_duplicate_pairs(classified(spark, sf), "message_id", "text")


@query
def near_dup_links(spark, sf):
    """The same without listing pairs: each message with the least id of its words and the number of its near duplicates."""
    links = sampling.near_duplicate_links(classified(spark, sf), "message_id", "text")
    return links.select(F.col("id").alias("message_id"), "set_id", "n_links")


@query
def overlap_score(spark, sf):
    rows = C.immediate_responses(support_messages(spark, sf)).where("response is not null")
    sets = [F.array_distinct(T.retrieval_tokens(F.col(c), R.STOP_WORDS)) for c in ("text", "response")]
    return rows.select("message_id", F.round(T.overlap_score(*sets), 9).alias("overlap"))


@query
def bucket_rank(spark, sf):
    return sampling.bucket_ranks(classified(spark, sf)).select("message_id", "bucket", "bucket_rank")


@query
def quota_allocation(spark, sf):
    counts = classified(spark, sf).where("bucket = 'primary_intent'").groupBy(F.col("primary").alias("group")).agg(n())
    return sampling.quota_allocation(counts, 52).withColumnRenamed("group", "intent_id")


def filtered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = materialise(classified(spark, sf))
    return sampling.quality_filtered(rows), sampling.intent_quotas(rows, POOL_QUOTAS)


@query
def pool_select(spark, sf):
    return sampling.pool_select(*filtered(spark, sf))


@query
def quality_rejections(spark, sf):
    return filtered(spark, sf)[0].groupBy("bucket", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(n())


@query
def replacement_pairs(spark, sf):
    return sampling.replacement_pairs(*filtered(spark, sf))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    tags = classify.difficulty_tags(F.col("text"), F.col("bucket"), F.col("matches"), F.col("words"), F.col("conversation_length"))
    return classified(spark, sf).withColumn("tags", tags)


@query
def difficulty_tags(spark, sf):
    return tagged(spark, sf).select("message_id", joined("tags").alias("tags"))


@query
def tag_counts(spark, sf):
    return tagged(spark, sf).select(F.explode("tags").alias("tag")).groupBy("tag").agg(n())


@query
def golden_rank(spark, sf):
    return sampling.golden_ranks(tagged(spark, sf)).select("message_id", "bucket", "golden_rank")


def golden(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(the golden set chosen from the pool, its groups)."""
    ranked = sampling.golden_ranks(tagged(spark, sf)).select("message_id", "text", "created_at", "primary", "golden_rank")
    pool = materialise(sampling.pool_select(*filtered(spark, sf)).join(ranked, "message_id"))
    groups = spark.createDataFrame([(b, i, k, q) for k, (b, i, q) in enumerate(GOLDEN_GROUPS)], "bucket string, intent string, turn int, quota long")
    chosen = materialise(sampling.golden_select(pool, groups).join(pool, "message_id"))
    # The small tables do not fill every group; the product's selection is refused where one is short.
    sampling.check_selection(chosen, groups, complete=False)
    return chosen, groups


@query
def golden_select(spark, sf):
    return golden(spark, sf)[0].select("message_id", "bucket", "intent", "golden_rank")


@query
def golden_ids(spark, sf):
    numbered = sampling.golden_ids(golden(spark, sf)[0])
    return numbered.select("golden_id", "message_id", T.id_suffix(F.col("golden_id")).alias("number"))


@query
def selection_sizes(spark, sf):
    selected, groups = golden(spark, sf)
    return sampling.selection_sizes(selected, groups)


@query
def human_sample(spark, sf):
    return sampling.seeded_sample(classified(spark, sf), "message_id", 30).select("message_id")


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    return classify.preliminary_annotation(classified(spark, sf))


@query
def prelim_annotation(spark, sf):
    return annotated(spark, sf).select("message_id", "label", "confidence", "review_reasons", "review_required")


@query
def stale_labels(spark, sf):
    """Records every fifth conversation's of which came with another intent than their texts give."""
    stored = F.when(F.col("conversation_id") % 5 == 0, F.lit("apple_watch")).otherwise(F.col("primary"))
    rows = classify.preliminary_annotation(classified(spark, sf).withColumn("stored", stored), "stored")
    return rows.select("message_id", "label", "confidence", "review_reasons")


@query
def escalation_prelim(spark, sf):
    return annotated(spark, sf).select("message_id", "risks", "escalate")


@query
def review_queue(spark, sf):
    return annotated(spark, sf).where("review_required").select("message_id", "bucket", "review_reasons")


@query
def collect_context(spark, sf):
    targets = annotated(spark, sf).where("review_required and bucket = 'ambiguous'")
    messages = support_messages(spark, sf).select("conversation_id", "message_id", "role")
    return annotate.conversation_contexts(targets, messages).select("target_id", "message_id", "role")


@query
def resolve_intent(spark, sf):
    rows = annotated(spark, sf)
    return annotate.resolve_intents(rows.where("review_required"), rows).select("message_id", "resolved_intent", "status", "resolved_confidence")


@query
def escalation_context(spark, sf):
    rows = annotated(spark, sf)
    targets = rows.where("review_required")
    return annotate.context_escalation(targets.select("message_id", "conversation_id", "text"), rows, annotate.resolve_intents(targets, rows))


@query
def gold_response(spark, sf):
    return annotate.gold_responses(C.immediate_responses(support_messages(spark, sf))).select("message_id", "shared_tokens", "gold_response_id")


@query
def annotated_golden(spark, sf):
    rows = annotated(spark, sf)
    resolved = annotate.resolve_intents(rows.where("review_required"), rows)
    out = rows.join(resolved, "message_id", "left")
    return out.select("message_id", F.when(F.col("review_required"), F.col("resolved_intent")).otherwise(F.col("label")).alias("gold_intent"), F.when(F.col("review_required"), F.col("status")).otherwise("inherited").alias("annotation_status"))


@query
def retrieval_corpus(spark, sf):
    return corpus_of(spark, sf).select(F.format_string("hist_%06d", F.col("message_id").cast("long")).alias("corpus_id"), "message_id", "response_id", "conversation_length", joined("matches", "intent_id").alias("intents"), F.col("primary").alias("primary_intent"))


@query
def tfidf_weights(spark, sf):
    corpus = support_messages(spark, sf).where("role = 'customer_message'")
    terms = retrieval.term_counts(corpus, "message_id", "text")
    weighted = retrieval.weights(terms, retrieval.inverse_frequencies(terms, corpus.count()))
    return weighted.groupBy("id").agg(n("n_tokens"), F.round(F.sqrt(F.sum(F.col("w") * F.col("w"))), 9).alias("norm"))


@query
def tfidf_topk(spark, sf):
    return retrieved(spark, sf)[1].where("rank is not null").select("query_id", "rank", "doc_id", "score")


@query
def retrieval_failures(spark, sf):
    return retrieved(spark, sf)[1].where("rank is null").select("query_id")


@query
def eligibility(spark, sf):
    return asked(corpus_of(spark, sf)).agg(n("queries"), F.count("gold_intent").alias("eligible"))


@query
def retrieval_summary(spark, sf):
    return retrieval.retrieval_summary(retrieved(spark, sf)[1])


@query
def hit_at_k(spark, sf):
    return retrieval.retrieval_summary(retrieved(spark, sf)[1]).select("eligible", "hit_at_1", "hit_at_3", "hit_at_5")


@query
def mrr(spark, sf):
    return retrieval.retrieval_summary(retrieved(spark, sf)[1]).select("mrr")


@query
def similarity_avgs(spark, sf):
    return retrieval.retrieval_summary(retrieved(spark, sf)[1]).select("mean_top", "mean_all")


@query
def evidence_score(spark, sf):
    return retrieval.evidence(retrieved(spark, sf)[1]).select("query_id", F.coalesce("rank", F.lit(0)).alias("rank"), "evidence_score", "response_type", "strength", "flags")


@query
def evidence_hist(spark, sf):
    return retrieval.evidence(retrieved(spark, sf)[1]).groupBy("strength", "response_type").agg(n())


@query
def evidence_summary(spark, sf):
    rows = retrieval.evidence(retrieved(spark, sf)[1])
    return rows.agg(n("candidates"), F.round(F.avg("evidence_score"), 6).alias("mean_score"), F.count_if("available").alias("available"))


@query
def coverage_at_k(spark, sf):
    rows = retrieval.evidence(retrieved(spark, sf)[1]).where("gold_intent is not null")
    per = rows.groupBy("query_id").agg(*(F.max(F.when(F.col("available") & (F.col("rank") <= k), 1).otherwise(0)).alias(f"c{k}") for k in (1, 3, 5)))
    return per.agg(*(F.round(F.avg(f"c{k}"), 6).alias(f"coverage_at_{k}") for k in (1, 3, 5)))


@query
def usable_evidence(spark, sf):
    return retrieval.usable(retrieval.evidence(retrieved(spark, sf)[1])).select("query_id", "rank")


@query
def anti_join_no_response(spark, sf):
    queries, rows = retrieved(spark, sf)
    usable = retrieval.usable(retrieval.evidence(rows)).select(F.col("query_id").alias("message_id"))
    return queries.join(usable, "message_id", "left_anti").select("message_id")


@query
def grounded_response(spark, sf):
    queries, rows = retrieved(spark, sf)
    return retrieval.grounded(queries, retrieval.evidence(rows), queries).select("query_id", "doc_id", "evidence_score", "response_type")


@query
def decision(spark, sf):
    return decided(spark, sf).select("query_id", "doc_id", "decision", "escalation_reason", "generated_response")


@query
def decision_summary(spark, sf):
    return shares_of(decided(spark, sf))


def shares_of(rows: DataFrame) -> DataFrame:
    share = F.round(100 * F.count(F.lit(1)) / F.sum(F.count(F.lit(1))).over(Window.partitionBy()), 2)
    return rows.groupBy("decision", F.coalesce("escalation_reason", F.lit("none")).alias("reason")).agg(n(), share.alias("percentage"))


@query
def trivial_baseline(spark, sf):
    rows = retrieved(spark, sf)[1]
    return evaluate.most_frequent(rows, "response", F.struct("query_id", "rank")).select(F.md5(F.col("value").cast("binary")).alias("response_md5"), "n")


@query
def simple_baseline(spark, sf):
    top = retrieved(spark, sf)[1].where("rank = 1")
    eligible = F.col("gold_intent").isNotNull()
    return top.agg(n("queries"), F.count_if(eligible & retrieval.is_hit()).alias("agreeing"), F.round(100 * F.count_if(eligible & retrieval.is_hit()) / F.count_if(eligible), 2).alias("percentage"))


@query
def baseline_compare(spark, sf):
    queries, rows = retrieved(spark, sf)
    chosen = retrieval.grounded(queries, retrieval.evidence(rows), queries).select("query_id", F.col("doc_id").alias("grounded_id"))
    top = rows.where("rank = 1").select("query_id", F.col("doc_id").alias("top_id"))
    return queries.select(F.col("message_id").alias("query_id")).join(top, "query_id", "left").join(chosen, "query_id", "left")


@query
def reference_agreement(spark, sf):
    return agreement_of(spark, sf, decided(spark, sf))


def agreement_of(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    reference = annotated(spark, sf).select(F.col("message_id").alias("query_id"), F.col("escalate").alias("reference"))
    rows = rows.withColumn("decided", F.col("decision") == "escalate").join(reference, "query_id")
    return evaluate.reference_agreement(rows, "reference", "decided")


@query
def agreement(spark, sf):
    """Labels of documents against a rule on their length."""
    labels = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.agreement(labels.withColumn("guess", (F.col("n_chars") > 500).cast("int")), "quality", "guess")


@query
def proof_checks(spark, sf):
    rows = decided(spark, sf)
    risky = F.coalesce(F.bool_and(F.col("decision") == F.when(F.col("escalation_reason").isNull(), "auto_handle").otherwise("escalate")), F.lit(True))
    return rows.agg(risky.alias("consistent"), (n() == F.count_distinct("query_id")).alias("unique_ids"), F.bool_or(F.col("decision") == "auto_handle").alias("any_auto"))


@query
def except_keys(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return docs.exceptAll(labels).withColumn("side", F.lit("unlabelled")).unionByName(labels.exceptAll(docs).withColumn("side", F.lit("unknown")))


@query
def union_strata(spark, sf):
    ranked = sampling.bucket_ranks(classified(spark, sf)).select("message_id", "bucket", "bucket_rank")
    parts = [ranked.where((F.col("bucket") == b) & (F.col("bucket_rank") <= k)) for b, k in POOL_QUOTAS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def judge_stub(spark, sf):
    rows = decided(spark, sf).select("query_id", "query", F.coalesce("generated_response", F.lit("")).alias("response"), "decision")
    return evaluate.judge(rows)


@query
def judge_replies(spark, sf):
    """Grades read from replies, every other one of which stands in a fenced block."""
    body = F.format_string('{"retrieval_relevance_1_5": %d, "overall_acceptable": %s}', F.col("turn") % 5 + 1, F.when(F.col("turn") % 2 == 0, "true").otherwise("false"))
    reply = F.when(F.col("conversation_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    read = F.from_json(T.judge_reply(reply), "retrieval_relevance_1_5 int, overall_acceptable boolean")
    rows = support_messages(spark, sf).select("message_id", read.alias("v"))
    return rows.select("message_id", F.col("v.retrieval_relevance_1_5").alias("relevance"), F.col("v.overall_acceptable").alias("acceptable"))


@query
def csv_scan(spark, sf):
    """Messages written as CSV, with line breaks and quotes in their texts, and read again."""
    path = scratch(spark)
    rows = support_messages(spark, sf).select(*C.REQUIRED)
    rows.withColumn("text", F.concat("text", F.lit('\nsaid "so", twice'))).write.options(**files.CSV, header=True).csv(path)
    back = files.read_messages_csv(spark, path)
    return back.select("message_id", "author_id", F.coalesce("parent_ids", F.lit("")).alias("parent_ids"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def missing_columns(spark, sf):
    """The messages without each required column in turn, and whole: refused, or how many rows they are."""
    messages, out = support_messages(spark, sf), []
    for gone in (*C.REQUIRED, "none"):
        try:
            found = C.require_columns(messages.drop(gone)).agg(n("rows"))
        except ValueError:
            found = spark.createDataFrame([(None,)], "rows long")
        out.append(found.select(F.lit(gone).alias("dropped"), F.col("rows").isNull().alias("refused"), "rows"))
    return reduce(DataFrame.unionByName, out)


@query
def written_bytes(spark, sf):
    """Messages of each role written as text files, a message with its line's end, and the files' sizes as the store tells them."""
    path = scratch(spark)
    support_messages(spark, sf).select("role", F.concat_ws(" ", "message_id", "text").alias("value")).write.partitionBy("role").text(path, lineSep="\n")
    sizes = files.file_sizes(spark.read.text(path), "role")
    return sizes.groupBy("role").agg(F.sum("bytes").alias("bytes"))


@query
def jsonl_roundtrip(spark, sf):
    rows, path = materialise(C.nested(support_messages(spark, sf))), scratch(spark)
    files.write_jsonl(rows, path)
    return files.read_jsonl(spark, path, rows.schema).select("conversation_id", "message_count", F.size("messages").alias("n"))


@query
def sorted_jsonl(spark, sf):
    """The lines that a writer with sorted keys leaves."""
    path = scratch(spark)
    files.write_jsonl(support_messages(spark, sf).select("role", "message_id", "parent_ids"), path, sorted_keys=True)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def corrupt_records(spark, sf):
    """Lines that do not parse, told from those that do."""
    path = scratch(spark)
    line = F.concat(F.lit('{"message_id": "'), "message_id", F.lit('", "turn": '), F.col("turn").cast("string"), F.lit("}"))
    support_messages(spark, sf).select(F.when(F.col("conversation_id") % 7 == 2, F.substring(line, 1, 15)).otherwise(line).alias("value")).write.text(path)
    rows, bad = files.read_jsonl_with_errors(spark, path, StructType([StructField("message_id", StringType()), StructField("turn", LongType())]))
    return rows.select(F.lit("row").alias("kind"), F.concat_ws("/", "message_id", "turn").alias("what")).unionByName(bad.select(F.lit("bad").alias("kind"), F.col("line").alias("what")))


@query
def digest_is_stable(spark, sf):
    """A table's digest against that of its copy, dealt otherwise, and of one that lacks a row."""
    rows = support_messages(spark, sf).select("message_id", "text", "role")
    whole, copy = files.digest(rows), files.digest(materialise(rows.repartition(3)))
    least = rows.agg(F.min("message_id")).first()[0]
    lacking = files.digest(rows.where(F.col("message_id") != F.lit(least)))
    return spark.createDataFrame([(whole == copy, whole == lacking)], "copy_equal boolean, lacking_equal boolean")


@query
def human_sheet(spark, sf):
    """The sheet for people to grade, written as CSV, read again as labels are."""
    path, (queries, found) = scratch(spark), retrieved(spark, sf)
    # The sample depends on the ids alone, so only what it holds is decided.
    ids = materialise(sampling.seeded_sample(queries.select("message_id"), "message_id", 30).select(F.col("message_id").alias("query_id")).distinct())
    own, found = queries.join(ids.withColumnRenamed("query_id", "message_id"), "message_id", "left_semi"), found.join(ids, "query_id", "left_semi")
    rows = retrieval.decide(retrieval.grounded(own, retrieval.evidence(found), queries))
    evidence = found.select("query_id", "doc_id", F.col("response").alias("historical_evidence"))
    chosen = sampling.seeded_sample(rows.withColumn("message_id", F.col("query_id")), "message_id", 30)
    sheet = chosen.join(evidence, ["query_id", "doc_id"], "left").select("query_id", F.col("query").alias("customer_message"), F.coalesce("historical_evidence", F.lit("")).alias("historical_evidence"), F.coalesce("generated_response", F.lit("")).alias("generated_response"), "decision")
    files.write_sheet(sheet, path, evaluate.SHEET_COLUMNS)
    schema = StructType([StructField(c, StringType()) for c in (*sheet.columns, *evaluate.SHEET_COLUMNS)])
    back = files.read_labels(spark, path, schema, ("query_id", "decision"))
    empty = F.count_if(F.concat_ws("", *evaluate.SHEET_COLUMNS) == "").over(Window.partitionBy())
    return back.select("query_id", "customer_message", F.coalesce("historical_evidence", F.lit("")).alias("historical_evidence"), F.coalesce("generated_response", F.lit("")).alias("generated_response"), "decision", empty.alias("unfilled"))


@query
def summary_document(spark, sf):
    """The decisions' summary as an indented JSON document, read again."""
    path = scratch(spark)
    files.write_document(spark, files.summary_json(evaluate.decision_totals(decided(spark, sf))), path)
    return files.read_json_document(spark, path, "queries long, auto_handle long, escalate long, auto_handle_percentage double")


@query
def result_array(spark, sf):
    """Decisions against the annotated reference, as JSON arrays that are read again."""
    path = scratch(spark)
    reference = annotated(spark, sf).select(F.col("message_id").alias("query_id"), F.col("escalate").alias("reference"))
    rows = decided(spark, sf).join(reference, "query_id").select("query_id", "decision", "reference", F.col("generated_response").isNotNull().alias("answered"))
    files.write_arrays(rows, path, [F.col("query_id").asc()], rows=100)
    return files.read_json_document(spark, path, "query_id string, decision string, reference boolean, answered boolean")


@query
def final_report(spark, sf):
    """The lines of the closing report."""
    rows = retrieved(spark, sf)[1]
    decisions = materialise(decided(spark, sf).select("query_id", "decision", "escalation_reason"))
    tables = {"retrieval": retrieval.retrieval_summary(rows), "decisions": shares_of(decisions).orderBy("decision", "reason"), "baseline": simple_baseline(spark, sf), "reference": agreement_of(spark, sf, decisions)}
    lines = evaluate.final_report(tables, None).splitlines()
    discard(decisions)
    return spark.createDataFrame(list(enumerate(lines, 1)), "place int, line string")


@query
def file_metadata(spark, sf):
    return files.file_sizes(table(spark, sf, "documents"))
