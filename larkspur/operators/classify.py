"""Row-wise rule classification: intents, buckets, tags, reasons, response types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import prefilter
from larkspur.functions import rules as R
from larkspur.functions import text as T


def present(*columns: Column) -> Column:
    """The columns that are not null, as an array."""
    return F.filter(F.array(*columns), lambda x: x.isNotNull())


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the columns added behind a generator, so that later filters and projections read them instead of repeating their expressions."""
    kept = [c for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias("_made")
    return df.select(*kept, made).select(*kept, "_made.*")


def hits(normal: Column, pattern: str) -> Column:
    return normal.rlike(T.bounded(pattern))


#: Every pattern of every intent.
_PATTERNS = tuple(p for _, patterns in R.INTENTS for p in patterns)


def intent_matches(normal: Column, heads: Column | None = None) -> Column:
    """Array of (intent_id, evidence): the patterns of each intent that the normalised text holds.

    ``heads`` is :func:`prefilter.heads` of the text by all patterns, best settled as a column before: a pattern
    is searched only in texts of which a word begins as the pattern does.
    """
    heads = prefilter.heads(normal, _PATTERNS) if heads is None else heads
    one = []
    for intent, patterns in R.INTENTS:
        evidence = present(*(F.when(prefilter.possible(heads, p, _PATTERNS) & hits(normal, p), F.lit(p)) for p in patterns))
        one.append(F.struct(F.lit(intent).alias("intent_id"), evidence.alias("evidence")))
    return F.filter(F.array(*one), lambda m: F.size(m["evidence"]) > 0)


def primary_intent(matches: Column) -> Column:
    """The intent with most patterns; of several the first in taxonomy order."""
    most = F.array_max(F.transform(matches, lambda m: F.size(m["evidence"])))
    return F.get(F.filter(matches, lambda m: F.size(m["evidence"]) == most), F.lit(0))["intent_id"]


def is_non_support(normal: Column) -> Column:
    return normal.rlike(rf"(?i)^{R.NON_SUPPORT}\z")


def assign_bucket(matches: Column, words: Column, non_support: Column) -> Column:
    return (
        F.when(F.size(matches) == 0, "unclassified")
        .when(F.size(matches) > 1, "multi_intent")
        .when((words <= 3) | non_support, "ambiguous")
        .otherwise("primary_intent")
    )


def classify_messages(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds normal, matches, primary, evidence_strength, words, non_support and bucket."""
    base = settled(messages, normal=T.normalized(F.col(text_col)))
    base = settled(base, _heads=prefilter.heads(F.col("normal"), _PATTERNS))
    words = F.size(T.found(F.col("normal"), r"[a-z][a-z0-9']*"))
    base = settled(base, matches=intent_matches(F.col("normal"), F.col("_heads")), words=words, non_support=is_non_support(F.col("normal"))).drop("_heads")
    strength = F.aggregate("matches", F.lit(0), lambda n, m: n + F.size(m["evidence"]))
    bucket = assign_bucket(F.col("matches"), F.col("words"), F.col("non_support"))
    return settled(base, primary=primary_intent(F.col("matches")), evidence_strength=strength, bucket=bucket)


def response_type(response: Column) -> Column:
    lower = F.lower(F.coalesce(response, F.lit("")))
    out = F.when(F.trim(lower) == "", "none")
    for name, pattern in R.RESPONSE_TYPES:
        out = out.when(hits(lower, pattern), name)
    return out.otherwise("acknowledgement_or_other")


def risk_reasons(text: Column) -> Column:
    """All annotation risks that the text names."""
    lower = T.lowered(text)
    return present(*(F.when(hits(lower, p), F.lit(name)) for name, p in R.ANNOTATION_RISKS))


def decision_risk(text: Column) -> Column:
    """The first risk that always escalates, else null."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(hits(lower, p), F.lit(name)) for name, p in R.DECISION_RISKS))


def difficulty_tags(text: Column, bucket: Column, matches: Column, words: Column, length: Column) -> Column:
    normal = T.normalized(text)
    phrase = {name: hits(normal, p) for name, p in R.DIFFICULTY_PHRASES}
    phrase["historical_retrieval_context"] = phrase["historical_retrieval_context"] | (length >= 4)
    return present(
        F.when((bucket == "primary_intent") & (F.size(matches) == 1), F.lit("clear_single_intent")),
        F.when((words <= 8) | (length <= 2), F.lit("incomplete_context")),
        *(F.when(test, F.lit(name)) for name, test in phrase.items()),
    )


def has_mojibake(text: Column) -> Column:
    """Clusters of wrongly decoded characters in short tokens, or four variation selectors behind an ``I``."""
    text = F.coalesce(text, F.lit(""))
    marks = f"[{R.MOJIBAKE_MARKERS}]"
    beside = f"(?i)[a-z0-9]{marks}{{2,}}|{marks}{{2,}}[a-z0-9]"
    bad = F.exists(T.found(text, r"\S+"), lambda t: (F.length(t) <= 24) & t.rlike(marks) & (t.rlike(R.MOJIBAKE_CLUSTERS) | t.rlike(beside)))
    return (F.regexp_count(text, F.lit("I[︎️]")) >= 4) | bad


def low_diversity(tokens: Column) -> Column:
    return (F.size(tokens) >= 8) & (F.size(F.array_distinct(tokens)) < 0.2 * F.size(tokens))


def repeated_token(tokens: Column) -> Column:
    """Of eight tokens or more one is half of all or more: then it is the middle one of the sorted tokens."""
    ordered = F.array_sort(tokens)
    middle = F.floor(F.size(tokens) / 2).cast("int")
    # The outer transform evaluates the middle tokens once, not for every token compared.
    candidates = F.array(F.get(ordered, middle), F.get(ordered, middle - 1))
    counts = F.transform(candidates, lambda m: F.size(F.filter(tokens, lambda t: t == m)))
    return (F.size(tokens) >= 8) & F.exists(counts, lambda n: n >= 0.5 * F.size(tokens))


def row_quality(text: Column) -> Column:
    """The first reason to reject a text by itself, or null."""
    tokens = T.quality_tokens(text)
    return (
        F.when(F.size(tokens) == 0, "empty_or_non_informative")
        .when(low_diversity(tokens), "low_token_diversity")
        .when(repeated_token(tokens), "repeated_token_noise")
        .when(has_mojibake(text), "mojibake_or_unicode_artifact")
    )


def preliminary_annotation(classified: DataFrame, stored: str = "primary") -> DataFrame:
    """Adds label, confidence, reasons (in order) and risk reasons with the tri-state escalation.

    ``stored`` is the column of the intent that a record came with; ``primary`` is what its text gives now.
    """
    n, inherited = F.col("evidence_strength"), F.col("bucket") == "primary_intent"
    strong = F.when((F.size("matches") == 1) & (n >= 2), F.get("matches", F.lit(0))["intent_id"])
    label = F.when(inherited, F.col(stored)).when(F.col("bucket") == "multi_intent", F.lit(None)).otherwise(strong)
    out = settled(classified, label=label)
    confidence = F.when(inherited & (n >= 2), "high").when(inherited | F.col("label").isNotNull(), "medium").otherwise("low")
    out = settled(out, confidence=confidence)
    unknown = F.col("label").isNotNull() & ~F.exists("matches", lambda m: m["intent_id"] == F.col("label"))
    reasons = present(
        F.when(F.col("bucket") == "ambiguous", F.lit("ambiguous bucket")),
        F.when(F.col("bucket") == "multi_intent", F.lit("multi-intent bucket")),
        F.when((F.col("bucket") == "unclassified") & F.col("label").isNull(), F.lit("unclassified without label")),
        F.when(F.col("confidence") == "low", F.lit("low confidence")),
        F.when(F.col("words") <= 3, F.lit("short message")),
        F.when(unknown, F.lit("label not among matches")),
        F.when(inherited & (F.col(stored) != F.col("primary")), F.lit("stored label differs from the text's")),
    )
    out = settled(out, reasons=reasons, risks=F.array_join(risk_reasons(F.col("text")), "; "))
    clear = inherited & (F.col("confidence") == "high")
    escalate = F.when(F.col("risks") != "", True).when(clear, False)
    return settled(out, review_reasons=F.array_join("reasons", "; "), review_required=F.size("reasons") > 0, escalate=escalate)
