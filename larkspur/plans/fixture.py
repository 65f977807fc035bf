"""Support messages made from the ``conversations`` table, by SQL that both engines run.

The table's texts hold no support phrases, so one is put in front by arithmetic on the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.sources.tables import table

CUSTOMER = (
    "my battery drains and charging is slow after the ios update", "why does wifi keep dropping on the network", "my password and account are locked, sign in fails",
    "@brand the app store will not download music", "i was charged twice, refund my payment please", "imessage not sending, calls drop again",
    "the screen and camera are broken", "please help activate and set up my new phone", "my macbook is stuck and slow", "apple watch will not pair",
    "the keyboard shows question marks and squares", "on hold with customer service, still waiting!", "where is my order? repair appointment please",
    "", "thanks", "see https://example.com/x for details", "is it fixed?", "hello", "my wifi", "hi battery",
    "since the new update my battery drains fast and the screen freezes while charging overnight", "my battery drains fast and the screen freezes while charging, since the new update today",
)
#: Phrases that stand without the table's text.
ALONE = ("thanks", "hello", "is it fixed?", "my wifi", "hi battery", *CUSTOMER[-2:])
BRAND = (
    "what version are you using?", "go to settings and tap reset to restart the battery report", "please send us a dm so we can look into this", "glad to hear that",
    "", "have you tried to update ios? does it continue", "open the app store, select your account and choose update",
)


def _values(name: str, phrases: tuple[str, ...]) -> str:
    return f"{name}(k, phrase) AS (VALUES " + ", ".join(f"({k}, '{p}')" for k, p in enumerate(phrases)) + ")"


def messages_sql(engine: str, source: str = "conversations") -> str:
    """CTEs, the last of which is ``msg``: a row for each customer or brand message; other roles speak for neither.

    Some times and brand flags are no times or flags.
    """
    day = {
        "spark": "date_format(timestampadd(MINUTE, CAST(conversation_id * 60 + turn AS INT), TIMESTAMP'2017-10-31 22:10:47'), 'EEE MMM dd HH:mm:ss')",
        "duckdb": "strftime(TIMESTAMP '2017-10-31 22:10:47' + to_minutes(CAST(conversation_id * 60 + turn AS INTEGER)), '%a %b %d %H:%M:%S')",
    }[engine]
    return f"""{_values("customer_phrase", CUSTOMER)}, {_values("brand_phrase", BRAND)},
line AS (SELECT conv_id AS conversation_id, turn, conv_id * 100 + turn AS message_id, role = 'user' AS inbound, text AS body,
    lag(conv_id * 100 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent,
    lead(conv_id * 100 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS child,
    lead(conv_id * 100 + turn, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS second_child
    FROM {source} WHERE role IN ('user', 'assistant')),
msg AS (SELECT CAST(message_id AS STRING) AS message_id, conversation_id, turn, CASE WHEN inbound THEN 'True' WHEN conversation_id % 19 = 4 THEN 'yes' ELSE 'False' END AS inbound,
    CASE WHEN inbound THEN 'customer_message' ELSE 'brand_response' END AS role,
    CASE WHEN inbound THEN concat('u', CAST(conversation_id % 40 AS STRING)) ELSE concat('brand', CAST(conversation_id % 5 AS STRING)) END AS author_id,
    CASE WHEN conversation_id % 17 = 3 AND turn % 4 = 1 THEN 'unknown' ELSE concat({day}, ' +0000 ', '2017') END AS created_at,
    CASE WHEN inbound AND c.phrase IN ({", ".join(f"'{p}'" for p in ALONE)}) THEN c.phrase WHEN inbound THEN concat(c.phrase, ' ', body) ELSE concat(b.phrase, CASE WHEN b.phrase = '' THEN '' ELSE concat(' ', body) END) END AS text,
    CASE WHEN conversation_id % 5 = 0 AND second_child IS NOT NULL THEN concat(CAST(child AS STRING), ',', CAST(second_child AS STRING)) ELSE CAST(child AS STRING) END AS response_ids,
    CAST(CASE WHEN parent IS NULL AND conversation_id % 11 = 0 THEN message_id + 50
              WHEN parent IS NULL AND conversation_id % 13 = 0 AND conversation_id > 0 THEN (conversation_id - 1) * 100 + 1 ELSE parent END AS STRING) AS parent_ids
    FROM line LEFT JOIN customer_phrase c ON c.k = (conversation_id * 7 + turn * 3) % {len(CUSTOMER)}
    LEFT JOIN brand_phrase b ON b.k = (conversation_id * 5 + turn) % {len(BRAND)})"""


def support_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {messages_sql('spark', '{source}')} SELECT * FROM msg", source=table(spark, sf_dir, "conversations"))
