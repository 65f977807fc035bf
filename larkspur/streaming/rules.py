"""The row-wise rules on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators.classify import classify_messages, response_type, risk_reasons


def classify_stream(messages: DataFrame) -> DataFrame:
    """The batch classifier's columns on a stream: every rule is a stateless column expression."""
    return classify_messages(messages).withColumn("risks", F.array_join(risk_reasons(F.col("text")), "; ")).withColumn("response_type", response_type(F.col("text")))


def intent_volumes(messages: DataFrame, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Messages by event-time window and primary intent; later than ``late`` is dropped by the watermark."""
    timed = classify_messages(messages).withColumn("at", T.message_time(F.col("created_at"))).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "primary").agg(F.count(F.lit(1)).alias("n"))
