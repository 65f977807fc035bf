"""Message links, conversations and brand metrics.

A message table has message_id, author_id, inbound, created_at, text, response_ids and
parent_ids, all strings. Links are joins on exploded ids; counts are pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import rules as R
from larkspur.functions import text as T
from larkspur.operators.graph import connected_components
from larkspur.operators.ranks import ranked

REQUIRED = ("message_id", "author_id", "inbound", "created_at", "text", "response_ids", "parent_ids")


def require_columns(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def inbound(df: DataFrame) -> DataFrame:
    return df.where(T.is_true(F.col("inbound")))


def outbound(df: DataFrame) -> DataFrame:
    return df.where(~T.is_true(F.col("inbound")))


def audit(messages: DataFrame) -> DataFrame:
    is_in, when = T.is_true(F.col("inbound")), T.message_time(F.col("created_at"))
    known = F.lower(F.trim("inbound")).isin("true", "false")
    return messages.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(is_in).alias("n_inbound"), F.count_if(~is_in).alias("n_outbound"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("n_invalid"), F.count_if(when.isNull()).alias("n_bad_time"),
        F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("n_empty"),
        F.min(when).cast("string").alias("first_at"), F.max(when).cast("string").alias("last_at"),
    )


def author_volumes(messages: DataFrame) -> DataFrame:
    return outbound(messages).groupBy("author_id").agg(F.count(F.lit(1)).alias("n"))


def top_brands(messages: DataFrame, limit: int) -> DataFrame:
    """Most outbound messages first, then the least id seen."""
    counts = outbound(messages).groupBy("author_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("message_id").cast("long")).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen").limit(limit)


def links(messages: DataFrame, column: str) -> DataFrame:
    """(message_id, other): one row for each id that the column lists."""
    return messages.select("message_id", F.explode(T.ids(F.col(column))).alias("other"))


def brand_of(messages: DataFrame) -> DataFrame:
    return outbound(messages).select(F.col("message_id").alias("other"), F.col("author_id").alias("brand"))


def answered_issues(messages: DataFrame) -> DataFrame:
    """(message_id, brand): the brands that answered an inbound message, each once."""
    return links(inbound(messages), "response_ids").join(brand_of(messages), "other").select("message_id", "brand").distinct()


def linked_replies(messages: DataFrame) -> DataFrame:
    """Inbound messages that reply to a brand's message, once per link."""
    return links(inbound(messages), "parent_ids").join(brand_of(messages), "other").select("message_id", "brand", "other")


def response_links(messages: DataFrame) -> DataFrame:
    """(message_id, brand, other): the parents that brand messages name, with repeats and ids without a row."""
    out = outbound(messages)
    return links(out, "parent_ids").join(out.select("message_id", F.col("author_id").alias("brand")), "message_id").select("message_id", "brand", "other")


def link_flags(messages: DataFrame, brand: str) -> DataFrame:
    """Inbound messages of one brand's conversations with what links them: has_response, is_parent, replies_to."""
    own = outbound(messages).where(F.col("author_id") == brand)
    ids, customers = own.select(F.col("message_id").alias("other")), inbound(messages)
    answered = links(customers, "response_ids").join(ids, "other", "left_semi").select("message_id").distinct().withColumn("has_response", F.lit(True))
    named = links(own, "parent_ids").select(F.col("other").alias("message_id")).distinct().withColumn("is_parent", F.lit(True))
    replies = links(customers, "parent_ids").join(ids, "other", "left_semi").select("message_id").distinct().withColumn("replies_to", F.lit(True))
    flagged = customers.select("message_id").join(answered, "message_id", "left").join(named, "message_id", "left").join(replies, "message_id", "left")
    return flagged.select("message_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("has_response", "is_parent", "replies_to")))


def related_inbound(messages: DataFrame, brand: str) -> DataFrame:
    return link_flags(messages, brand).where("has_response or is_parent or replies_to")


def reply_edges(messages: DataFrame) -> DataFrame:
    """Each message with itself and with every id that it names as parent, rows or not."""
    known = messages.select(F.col("message_id").cast("long").alias("src"))
    named = links(messages, "parent_ids").select(F.col("message_id").cast("long").alias("src"), F.col("other").cast("long").alias("dst"))
    return known.select("src", F.col("src").alias("dst")).unionByName(named)


def conversations_of(messages: DataFrame) -> DataFrame:
    """Every message with the least id of its connected component."""
    labels = connected_components(reply_edges(messages)).withColumn("message_id", F.col("node").cast("string"))
    return messages.join(labels.select("message_id", F.col("component").alias("conversation")), "message_id")


def brand_conversations(messages: DataFrame, brand: str) -> DataFrame:
    """A brand's own messages and the customers' ones linked to them, each with the least id of its component as conversation.

    A brand's message stands with every parent it names, kept or not, so that answers to one message
    meet; a customer's stands with those of the brand's that it names.
    """
    own = outbound(messages).where(F.col("author_id") == brand)
    kept = own.unionByName(messages.join(related_inbound(messages, brand).select("message_id"), "message_id", "left_semi"))
    ids = own.select(F.col("message_id").alias("other"))
    customers = inbound(messages)
    named = links(customers, "response_ids").unionByName(links(customers, "parent_ids")).join(ids, "other", "left_semi")
    pairs = links(own, "parent_ids").unionByName(named).unionByName(kept.select("message_id", F.col("message_id").alias("other")))
    labels = connected_components(pairs.select(F.col("message_id").cast("long").alias("src"), F.col("other").cast("long").alias("dst")))
    labels = labels.select(F.col("node").cast("string").alias("message_id"), F.col("component").alias("conversation"))
    return kept.join(labels, "message_id")


def conversation_list(messages: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Conversations by the id of their first message as text, with their place in that order, that id and their counts."""
    whole = nested(messages, key).withColumn("first_id", F.col("messages")[0]["message_id"])
    usable = (F.col("customer_message_count") > 0) & (F.col("brand_response_count") > 0)
    told = whole.select("first_id", key, "message_count", "customer_message_count", "brand_response_count", usable.alias("usable"))
    return ranked(told, [], [F.col("first_id").asc(), F.col(key).asc()], "place").orderBy("place")


def brand_ranking(scores: DataFrame) -> DataFrame:
    """Brands (few): the eligible first, then by score, issues and name, numbered."""
    order = Window.orderBy(F.desc("eligible"), F.desc("score"), F.desc("issues"), "brand")
    return scores.withColumn("rank", F.row_number().over(order))


def ordered_messages(messages: DataFrame, key: str = "conversation_id") -> DataFrame:
    """pos in the conversation: by time (unknown last), brand before customer, then id; and its size."""
    order = [T.message_time(F.col("created_at")).asc_nulls_last(), F.col("role"), F.col("message_id").cast("long")]
    own = Window.partitionBy(key)
    return messages.withColumn("pos", F.row_number().over(own.orderBy(*order))).withColumn("conversation_length", F.count(F.lit(1)).over(own))


def nested(messages: DataFrame, key: str = "conversation_id") -> DataFrame:
    """One row a conversation with its messages in order; conversations are small, so they meet whole."""
    one = F.struct("pos", "message_id", "role", "text")
    return ordered_messages(messages, key).groupBy(key).agg(
        F.array_sort(F.collect_list(one)).alias("messages"), F.count(F.lit(1)).alias("message_count"),
        F.count_if(F.col("role") == "customer_message").alias("customer_message_count"), F.count_if(F.col("role") == "brand_response").alias("brand_response_count"),
    )


def unnest(conversations: DataFrame, key: str = "conversation_id") -> DataFrame:
    return conversations.select(key, F.size("messages").alias("conversation_length"), F.posexplode("messages").alias("place", "m")).select(key, "conversation_length", "place", "m.message_id", "m.role", "m.text")


def conversation_stats(messages: DataFrame, key: str = "conversation_id") -> DataFrame:
    per = messages.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "customer_message").alias("customers"), F.count_if(F.col("role") == "brand_response").alias("brands"))
    return per.agg(F.count(F.lit(1)).alias("n_conversations"), F.round(F.avg("n"), 6).alias("mean_length"), F.median("n").alias("median_length"), F.max("n").alias("max_length"), F.count_if((F.col("customers") > 0) & (F.col("brands") > 0)).alias("n_usable"))


def immediate_responses(messages: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Customer messages with the next message of the conversation if a brand wrote it."""
    order = Window.partitionBy(key).orderBy("pos")
    following = F.lead(F.struct("role", "message_id", "text", "created_at")).over(order)
    out = ordered_messages(messages, key).withColumn("following", following).where(F.col("role") == "customer_message")
    brand = F.col("following.role") == "brand_response"
    return out.withColumn("response_id", F.when(brand, F.col("following.message_id"))).withColumn("response", F.when(brand, F.col("following.text"))).drop("following")


def token_frequencies(messages: DataFrame) -> DataFrame:
    """(brand, token, n) over the messages that a brand answered."""
    issues = answered_issues(messages).join(messages.select("message_id", "text"), "message_id")
    return issues.select("brand", F.explode(T.topical_tokens(F.col("text"), R.BRAND_STOP_WORDS)).alias("token")).groupBy("brand", "token").agg(F.count(F.lit(1)).alias("n"))


def brand_components(messages: DataFrame) -> DataFrame:
    """(brand, components, nodes) of each brand's own graph of its messages and the parents they name or that reply to them."""
    edges = response_links(messages).select("brand", F.col("message_id").alias("x"), F.col("other").alias("y"))
    edges = edges.unionByName(linked_replies(messages).select("brand", F.col("message_id").alias("x"), F.col("other").alias("y")))
    keyed = edges.select("brand", F.concat_ws("/", "brand", "x").alias("src"), F.concat_ws("/", "brand", "y").alias("dst"))
    labels = connected_components(keyed)
    brand = F.substring_index("node", "/", 1)
    return labels.groupBy(brand.alias("brand")).agg(F.count_distinct("component").alias("components"), F.count(F.lit(1)).alias("nodes"))


def brand_scores(messages: DataFrame, *, eligible_from: int = 250) -> DataFrame:
    """The transparent 100-point score of each brand, best first."""
    volume = author_volumes(messages).withColumnRenamed("author_id", "brand").withColumnRenamed("n", "outbound")
    issues = answered_issues(messages).groupBy("brand").agg(F.count(F.lit(1)).alias("issues"))
    responses = response_links(messages).groupBy("brand").agg(F.count(F.lit(1)).alias("responses"))
    topics = token_frequencies(messages).where("n >= 3").groupBy("brand").agg(F.count(F.lit(1)).alias("topics"))
    out = volume
    for part in (issues, responses, topics, brand_components(messages)):
        out = out.join(part, "brand", "left")
    out = out.na.fill(0).withColumn("usable", F.least("responses", "issues")).withColumn("link_rate", F.col("issues") / F.col("outbound"))

    def share(column: str) -> Column:
        most = F.greatest(F.max(column).over(Window.partitionBy()), F.lit(1))
        return F.log1p(column) / F.log1p(most)

    score = 25 * share("issues") + 25 * share("usable") + 20 * F.least("link_rate", F.lit(1.0)) + 15 * share("components") + 15 * F.least(F.col("topics") / 30, F.lit(1.0))
    eligible = (F.col("issues") >= eligible_from) & (F.col("usable") >= eligible_from)
    return out.select("brand", "outbound", "issues", "responses", "usable", F.round("link_rate", 6).alias("link_rate"), "components", "nodes", "topics", F.round(score, 2).alias("score"), eligible.alias("eligible"))
