"""String functions of the rule sets as Column expressions.

White space is ASCII white space, word characters are Unicode letters, digits and ``_``. A null
text is empty. Everything stays inside whole-stage code generation; nothing here is a UDF.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MENTION_OR_URL = r"(?i)@[\pL\pN_]+|https?://[^\s]+"
START, END = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"


def bounded(pattern: str) -> str:
    """The pattern with each ``\\b``, alternately before and behind a word, as explicit Unicode bounds.

    Java's and RE2's ``\\b`` differ beside accented letters; these bounds do not.
    """
    sides = iter((START, END) * (pattern.count(r"\b") // 2 + 1))
    return re.sub(r"\\b", lambda _: next(sides), pattern)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_links(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), MENTION_OR_URL, " ")


def normalized(text: Column) -> Column:
    """Mentions and links out, lower case, white space collapsed."""
    return collapsed(F.lower(without_links(text)))


def lowered(text: Column) -> Column:
    """Lower case and collapsed only; mentions stay."""
    return collapsed(F.lower(F.coalesce(text, F.lit(""))))


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def content_word_count(text: Column) -> Column:
    return F.size(found(normalized(text), r"[a-z][a-z0-9']*"))


def quality_tokens(text: Column) -> Column:
    return found(normalized(text), r"[a-z0-9]+")


def canonical(text: Column, *, keep_hashtags: bool = False) -> Column:
    """Letters, digits and blanks of normalised text; the pool's form also drops www links and hashtags."""
    value = normalized(text)
    if not keep_hashtags:
        value = F.regexp_replace(value, r"www\.[^\s]+|#[\pL\pN_]+", " ")
    return collapsed(F.regexp_replace(value, r"[^a-z0-9\s]", " "))


def kept_words(tokens: Column, stop_words: Sequence[str], shortest: int = 3) -> Column:
    stops = F.array(*map(F.lit, stop_words))
    return F.filter(tokens, lambda t: (F.length(t) >= shortest) & ~F.array_contains(stops, t))


def content_tokens(text: Column, stop_words: Sequence[str], *, keep_hashtags: bool = False) -> Column:
    """Distinct words of the canonical text."""
    return F.array_distinct(kept_words(found(canonical(text, keep_hashtags=keep_hashtags), "[a-z0-9]+"), stop_words))


def retrieval_tokens(text: Column, stop_words: Sequence[str]) -> Column:
    """Words of the text without mentions and links, repeats kept."""
    return kept_words(found(F.lower(without_links(text)), "[a-z0-9]+"), stop_words)


def review_tokens(text: Column, stop_words: Sequence[str]) -> Column:
    bare = F.regexp_replace(lowered(text), r"https?://[^\s]+|[@#][\pL\pN_]+", " ")
    return F.array_distinct(kept_words(found(bare, "[a-z0-9]+"), stop_words))


def topical_tokens(text: Column, stop_words: Sequence[str]) -> Column:
    return kept_words(found(F.lower(without_links(text)), "[a-z][a-z']{2,}"), stop_words)


def concise(text: Column, limit: int = 320) -> Column:
    return F.substring(collapsed(F.coalesce(text, F.lit(""))), 1, limit)


def ids(value: Column) -> Column:
    """All runs of digits of a list such as ``1,2``."""
    return found(F.coalesce(value, F.lit("")), "[0-9]+")


def is_true(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)) == "true", F.lit(False))


def message_time(value: Column) -> Column:
    """``Tue Oct 31 22:10:47 +0000 2017`` as a timestamp; null if it is anything else."""
    return F.try_to_timestamp(F.substring(F.trim(value), 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))


def utc_iso(value: Column) -> Column:
    """A message time as ISO 8601 text in UTC, ``2017-10-31T22:10:47+00:00``; null if it is no time."""
    # The wall clock is compared in UTC whatever the session's zone is.
    utc = F.to_utc_timestamp(message_time(value), F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def id_suffix(value: Column) -> Column:
    """The number behind the first dash of ``GS-007``, for numeric order; null if there is none."""
    return F.regexp_extract(value, r"^[^-]*-0*([0-9]+)$", 1).try_cast("int")


def visible(text: Column) -> Column:
    """Non-breaking blanks as blanks; zero-width characters and byte-order marks out."""
    return F.translate(F.coalesce(text, F.lit("")), "\u00a0\u200b\ufeff", " ")


def overlap_score(a: Column, b: Column) -> Column:
    """Shared tokens over the root of the product of both sizes; 0 if either set is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b).cast("double"))).otherwise(0.0)


def near_duplicate(a: Column, b: Column, *, both_long: bool = True) -> Column:
    """4 shared words, 70 % of the smaller set, 6 in all; the pool asks six words of the first set only."""
    shared = F.size(F.array_intersect(a, b))
    long_enough = (F.size(a) >= 6) & (F.size(b) >= 6) if both_long else F.size(a) >= 6
    return long_enough & (shared >= 4) & (shared >= 0.7 * F.least(F.size(a), F.size(b))) & (F.size(F.array_union(a, b)) >= 6)


def judge_reply(reply: Column) -> Column:
    """The JSON inside a reply that may stand in a fenced block."""
    return F.trim(F.regexp_replace(F.trim(reply), r"^```(?:json)?|```$", ""))
