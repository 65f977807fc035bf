"""Baselines, agreement statistics and the judge."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.sources.files import report
from larkspur.sources.tables import materialise


def most_frequent(rows: DataFrame, value: str, position: Column) -> DataFrame:
    """(value, n): the commonest non-empty value; of several the one with the least position."""
    counts = rows.where(F.coalesce(F.trim(value), F.lit("")) != "").groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first_at"))
    return counts.orderBy(F.desc("n"), "first_at").limit(1).select("value", "n")


def reference_agreement(decisions: DataFrame, reference: str, decided: str) -> DataFrame:
    """Agreement over rows whose reference is not null."""
    comparable = F.col(reference).isNotNull()
    same = comparable & (F.col(reference) == F.col(decided))
    return decisions.agg(F.count(F.lit(1)).alias("total"), F.count_if(comparable).alias("comparable"), F.count_if(same).alias("agreed"), F.round(100 * F.count_if(same) / F.count_if(comparable), 2).alias("percentage"))


def agreement(rows: DataFrame, human: str, judge: str) -> DataFrame:
    """Mean absolute error, exact and within-one shares, Pearson (null for under 2 rows or no variance)."""
    h, j = F.col(human).cast("double"), F.col(judge).cast("double")
    both = rows.where(h.isNotNull() & j.isNotNull())
    varied = (F.count(F.lit(1)) > 1) & (F.stddev_pop(h) > 0) & (F.stddev_pop(j) > 0)
    covariance = F.covar_pop(h, j) / F.when(varied, F.stddev_pop(h) * F.stddev_pop(j))
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(h - j)), 6).alias("mean_absolute_error"), F.round(F.avg((h == j).cast("double")), 6).alias("exact"),
        F.round(F.avg((F.abs(h - j) <= 1).cast("double")), 6).alias("within_one"), F.round(covariance, 6).alias("pearson"),
    )


#: Fixed values. What people fill in.
SHEET_COLUMNS = ("human_retrieval_relevance_1_5", "human_response_grounding_1_5", "human_response_quality_1_5", "human_escalation_correctness_0_1", "human_overall_acceptable_0_1", "human_notes")


def decision_totals(decisions: DataFrame) -> DataFrame:
    auto = F.count_if(F.col("decision") == "auto_handle")
    return decisions.agg(F.count(F.lit(1)).alias("queries"), auto.alias("auto_handle"), F.count_if(F.col("decision") == "escalate").alias("escalate"), F.round(100 * auto / F.count(F.lit(1)), 2).alias("auto_handle_percentage"))


def final_report(tables: dict[str, DataFrame], grades: DataFrame | None) -> str:
    """The closing report from frames of aggregates: retrieval, decisions, baseline, reference; ``grades`` of people where there are any."""
    return report("Evaluation", [
        ("Retrieval", tables["retrieval"]), ("Decisions", tables["decisions"]), ("Baseline: the nearest message's response as it is", tables["baseline"]),
        ("Agreement with the rule-based reference", tables["reference"]),
        ("What this does not say", "The reference is made by rules, so agreement with it is no accuracy, and agreement of intents is no quality of responses."),
        ("Grades by people and by the judge", grades if grades is not None else "Pending: nobody has filled in the sheet."),
    ])


def stub_judge(payload: dict) -> dict:
    """A deterministic judge without a network: grades by shared words."""
    said, reply = set(str(payload.get("query") or "").lower().split()), set(str(payload.get("response") or "").lower().split())
    grade = 1 + min(4, len(said & reply))
    return {"retrieval_relevance_1_5": grade, "response_grounding_1_5": grade, "response_quality_1_5": grade, "escalation_correct": True, "overall_acceptable": grade >= 3, "reason": "shared words"}


#: What a judge grades. The names are fixed values; the questions may be put otherwise.
RUBRIC = {
    "retrieval_relevance_1_5": "How close is the earlier case that was found to what this customer needs? From 1, another matter, to 5, the same matter.",
    "response_grounding_1_5": "How much of the reply stands in the evidence that was given? From 1, made up, to 5, all of it.",
    "response_quality_1_5": "How well does the reply serve the customer, in substance and in tone? From 1, badly, to 5, very well.",
    "escalation_correct": "Was handing over to a person, or not, the right decision here? true or false.",
    "overall_acceptable": "Could all of this go out unchanged? true or false.",
}


def verdict_of(reply: str) -> dict:
    """The JSON object of a reply, which may stand in a fenced block; anything else is an error."""
    bare = reply.strip()
    if bare.startswith("```"):
        bare = bare.strip("`").strip().removeprefix("json").strip()
    found = json.loads(bare)
    if not isinstance(found, dict):
        raise ValueError("the reply is no JSON object")
    return found


def http_judge(url: str, key: str, model: str, *, timeout: float = 90, pause: float = 0.1, attempts: int = 3) -> Callable[[dict], dict]:
    """A judge behind a chat-completions endpoint: one request a row, ``pause`` seconds apart.

    Refusals by load (429 and 5xx), lost connections and replies without a verdict are tried again
    after growing waits; the last failure is raised, so that its task is tried again or fails.
    """

    def ask(payload: dict) -> dict:
        question = {"rubric": RUBRIC, "case": payload, "answer": "One JSON object alone: integers for the three _1_5 fields, booleans for the two others, and a short reason."}
        talk = [{"role": "system", "content": "Grade strictly, by the supplied evidence alone."}, {"role": "user", "content": json.dumps(question, ensure_ascii=False)}]
        request = urllib.request.Request(url, json.dumps({"model": model, "temperature": 0, "messages": talk}).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        for attempt in range(attempts):
            time.sleep(pause * 4**attempt)
            try:
                with urllib.request.urlopen(request, timeout=timeout) as reply:
                    return verdict_of(json.loads(reply.read())["choices"][0]["message"]["content"])
            except urllib.error.HTTPError as e:
                if attempt + 1 == attempts or e.code != 429 and e.code < 500:
                    raise
            except (OSError, ValueError, LookupError):
                if attempt + 1 == attempts:
                    raise
        raise ValueError("attempts must be 1 or more")

    return ask


#: What :func:`judge` gives.
VERDICTS = "query_id string, relevance int, grounding int, quality int, escalation_correct boolean, acceptable boolean"


def judge(rows: DataFrame, ask: Callable[[dict], dict] = stub_judge, *, lenient: bool = False) -> DataFrame:
    """Grade (query_id, query, response, ...) rows by any function from payload to verdict, all columns being its payload; strings such as "false" are read strictly.

    The frame is lazy: every action on it asks again, as does a task that is run again. For a judge that costs something
    there is :func:`judge_into`. With ``lenient`` a row whose call fails is left out.
    """

    def asked(payload: dict) -> dict | None:
        try:
            return ask(json.loads(json.dumps(payload)))
        except Exception:
            if not lenient:
                raise
            return None

    def truth(value: object) -> bool | None:
        return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).strip().lower())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [(r["query_id"], asked(r)) for r in batch.to_dict("records")]
            ids, verdicts = [q for q, v in answers if v is not None], [v for _, v in answers if v is not None]
            yield pd.DataFrame({
                "query_id": ids, "relevance": [v.get("retrieval_relevance_1_5") for v in verdicts], "grounding": [v.get("response_grounding_1_5") for v in verdicts],
                "quality": [v.get("response_quality_1_5") for v in verdicts], "escalation_correct": [truth(v.get("escalation_correct")) for v in verdicts], "acceptable": [truth(v.get("overall_acceptable")) for v in verdicts],
            })

    return rows.mapInPandas(run, VERDICTS)


def judge_into(rows: DataFrame, path: str, ask: Callable[[dict], dict] = stub_judge, *, wave: int = 1_000) -> DataFrame:
    """The verdicts of ``rows``, kept in a table at ``path`` of the shared store: each query_id is asked for once, whatever is computed from them.

    Rows without a verdict there are asked for in waves of about ``wave`` rows, each of which is appended when it is done. So after a
    failure a second call asks only for what the first did not append, a wave at most is asked for again, and reading the
    result asks for nothing. A call that fails leaves its row out and lets the others go on; at the end that is an
    error, and the rows that have a verdict are kept. Of rows with one query_id one is asked for, null ids are left out.
    """
    spark = rows.sparkSession
    spark.createDataFrame([], VERDICTS).write.mode("append").parquet(path)  # so that there is a table to read
    known = spark.read.schema(VERDICTS).parquet(path).select("query_id")
    waiting = materialise(rows.where(F.col("query_id").isNotNull()).dropDuplicates(["query_id"]).join(known, "query_id", "left_anti"))
    waves = -(-waiting.count() // wave)
    for k in range(waves):
        part = waiting.where(F.pmod(F.xxhash64("query_id"), F.lit(waves)) == k)
        judge(part, ask, lenient=True).write.mode("append").parquet(path)
    verdicts = spark.read.schema(VERDICTS).parquet(path)
    if failed := waiting.join(verdicts.select("query_id"), "query_id", "left_anti").count():
        raise RuntimeError(f"{failed} rows have no verdict; a further call asks for those alone")
    return verdicts.join(rows.select("query_id").distinct(), "query_id", "left_semi")
