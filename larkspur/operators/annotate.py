"""Resolution of reviewed records from their conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import rules as R
from larkspur.functions import text as T
from larkspur.operators.classify import risk_reasons, settled


def conversation_contexts(targets: DataFrame, messages: DataFrame) -> DataFrame:
    """All messages of the conversations that hold a target, once for each target."""
    return targets.select(F.col("message_id").alias("target_id"), "conversation_id").join(messages, "conversation_id")


def resolve_intents(targets: DataFrame, classified: DataFrame) -> DataFrame:
    """(message_id, resolved_intent, acceptable, status, resolved_confidence) from the patterns of the whole conversation.

    Each intent's score is its number of distinct patterns over the customer messages; 2 at least
    count. A unique best resolves, several make it ambiguous, none leaves it open.
    """
    context = conversation_contexts(targets, classified.select("conversation_id", F.explode("matches").alias("m")))
    scores = context.select("target_id", "m.intent_id", F.explode("m.evidence").alias("pattern")).groupBy("target_id", "intent_id").agg(F.count_distinct("pattern").alias("score")).where("score >= 2")
    best = F.max("score").over(Window.partitionBy("target_id"))
    tied = scores.withColumn("best", best).where("score = best").groupBy("target_id").agg(F.array_sort(F.collect_list("intent_id")).alias("tied"))
    sizes = classified.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("customers"))
    out = targets.join(tied.withColumnRenamed("target_id", "message_id"), "message_id", "left").join(sizes, "conversation_id")
    several, own = F.coalesce(F.size("tied") > 1, F.lit(False)), F.size("matches") > 0
    intent = F.when(F.col("tied").isNull(), None).when(several & F.array_contains("tied", F.col("primary")), F.col("primary")).otherwise(F.get("tied", F.lit(0)))
    others = F.when(several, F.array_join(F.slice("tied", 2, 100), ",")).otherwise("")
    in_context = F.col("conversation_length") > 1
    status = F.when(F.col("tied").isNull(), "insufficient_evidence").when(several, "genuinely_ambiguous").when(in_context | ~own, "resolved_from_context").otherwise("resolved_from_text")
    confidence = F.when(F.col("tied").isNull(), "low").when(several, "medium").when(in_context, "high").otherwise("medium")
    return out.select("message_id", intent.alias("resolved_intent"), others.alias("acceptable"), status.alias("status"), confidence.alias("resolved_confidence"))


def context_escalation(targets: DataFrame, messages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Risks in the record's text and, after it, all customer texts of its conversation in order; true, false, or null where unresolved."""
    customers = messages.where("role = 'customer_message'").select("conversation_id", "pos", F.col("text").alias("said"))
    spoken = conversation_contexts(targets, customers).groupBy("target_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda m: m["said"]), " ").alias("said"))
    out = targets.join(spoken.withColumnRenamed("target_id", "message_id"), "message_id").join(resolved, "message_id")
    out = settled(out, risks=F.array_join(risk_reasons(F.concat_ws(" ", "text", "said")), "; "))
    risks = F.col("risks")
    done = F.col("status").isin("resolved_from_context", "resolved_from_text")
    escalate = F.when((risks != "") & done, True).when(~done | (F.col("resolved_confidence") == "low"), None).otherwise(False)
    return out.select("message_id", risks.alias("risks"), escalate.alias("escalate"))


def gold_responses(answered: DataFrame) -> DataFrame:
    """The immediate brand response where it is long, specific and related to the message, else null."""
    own, reply = T.review_tokens(F.col("text"), R.REVIEW_STOP_WORDS), T.review_tokens(F.col("response"), R.REVIEW_STOP_WORDS)
    answered = settled(answered, shared_tokens=F.size(F.array_intersect(own, reply)))
    shared = F.col("shared_tokens")
    text = F.coalesce("response", F.lit(""))
    generic = F.lower(text).rlike(R.GENERIC_GOLD_RESPONSE)
    refuse = (F.length(text) < 30) | (generic & (shared < 2)) | ((shared == 0) & ~text.contains("?"))
    return answered.withColumn("gold_response_id", F.when(F.col("response").isNotNull() & ~refuse, F.col("response_id")))

