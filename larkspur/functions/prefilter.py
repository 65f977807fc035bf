"""One scan that tells which of many word-bounded patterns can match a text at all."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import text as T

#: Characters that stand for themselves in the patterns; any other ends the known opening.
_PLAIN = re.compile(r"[A-Za-z0-9 ']*")


def _opening(part: str) -> str:
    """The characters that every match of ``part`` begins with; one that may be missing or repeated is not among them."""
    known = _PLAIN.match(part).group()
    return known[:-1] if part[len(known) : len(known) + 1] in ("?", "*", "{") else known


def openings(pattern: str) -> tuple[str, ...] | None:
    r"""What a match of ``pattern`` can begin with, at the beginning of a word, or None where that is not known.

    A pattern is read up to its first special character behind ``\b``, or each alternative of a group that it begins with.
    """
    if not pattern.startswith(r"\b"):
        return None
    rest = pattern[2:]
    group = re.match(r"\(\?:([^()]*)\)(?![?*{])", rest)
    found = tuple(map(_opening, group.group(1).split("|") if group else [rest.split("|")[0]]))
    return None if not all(found) or not group and "|" in re.sub(r"\([^()]*\)", "", rest) else found


def _tree(words: Iterable[str]) -> str:
    """An expression for any of ``words``, the longest first, in which words with a common beginning share it."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by_first.setdefault(w[:1], []).append(w[1:])
    ends = "" in by_first
    branches = [re.escape(c) + _tree(rest) for c, rest in by_first.items() if c]
    if not branches:
        return ""
    return f"(?:{'|'.join(branches)})" + ("?" if ends else "")


def heads(text: Column, patterns: Iterable[str]) -> Column:
    """The openings of any of ``patterns`` that words of the text begin with, longest first, from one scan of the text."""
    known = [o for p in patterns for o in openings(p) or ()]
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"{T.START}(?=({_tree(known)}))"), F.lit(1))) if known else F.array().cast("array<string>")


def possible(found: Column, pattern: str, patterns: Iterable[str]) -> Column:
    """Whether ``pattern`` can match a text whose :func:`heads` by ``patterns`` are ``found``."""
    own = openings(pattern)
    if own is None:
        return F.lit(True)
    # A scan gives the longest opening at a place, which may go on from this pattern's.
    reached = sorted({o for p in patterns for o in openings(p) or () if o.startswith(own)})
    return F.arrays_overlap(found, F.array(*map(F.lit, reached)))
