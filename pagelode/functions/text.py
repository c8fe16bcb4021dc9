"""Text expressions. Whitespace always means the class ``WS``, not Java's ASCII-only ``\\s``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace characters of ECMAScript.
WS_CHARS = "\t\n\x0b\x0c\r    -     　﻿"
WS = f"[{WS_CHARS}]"
#: The same one by one, without a range.
WS_EACH = "".join(c for c in map(chr, range(0x10000)) if re.match(WS, c))
#: Runs of anything else, for Python's ``re``.
WORD_RE = re.compile(f"[^{WS_CHARS}]+")


def tokens(text: Column) -> Column:
    """Whitespace-separated words; null stays null, blank text gives an empty array."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def query_terms(query: Column) -> Column:
    """Lower-case words of a query, repeated words kept."""
    return tokens(F.lower(query))


def trim_ws(text: Column) -> Column:
    """Strip the whole whitespace class from both ends (``trim`` knows only U+0020)."""
    return F.trim(text, F.lit(WS_EACH))


def term_count(text: Column, term: Column) -> Column:
    """Non-overlapping literal occurrences of ``term`` in ``text``."""
    left = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, (left / F.length(term)).cast("long")).otherwise(F.lit(0).cast("long"))


def saturation(count: Column) -> Column:
    """c / (c + 1.5): the score that one term adds."""
    return count.cast("double") / (count.cast("double") + F.lit(1.5))


def keyword_score(text: Column, terms: list[str]) -> Column:
    """Sum of ``saturation`` over the terms, in their order; 0 for null text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0.0)
    for term in terms:
        total = total + saturation(term_count(low, F.lit(term)))
    return total


def glob_regex(pattern: str) -> str:
    """An anchored regex for a glob with ``*``, ``**`` and ``**/``; ``?`` keeps its regex meaning."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif pattern[i] == "*":
            out.append("[^/]*")
            i += 1
        else:
            out.append(pattern[i] if pattern[i] == "?" else re.escape(pattern[i]))
            i += 1
    return "^" + "".join(out).replace(r"\-", "-").replace(r"\ ", " ") + "$"


def glob_filter(path: Column, include: list[str], exclude: list[str]) -> Column:
    """True where some include pattern and no exclude pattern matches the relative path."""
    keep = F.lit(False)
    for p in include:
        keep = keep | path.rlike(glob_regex(p))
    for p in exclude:
        keep = keep & ~path.rlike(glob_regex(p))
    return keep


def slug_title(slug: Column) -> Column:
    """Dashes and underscores become spaces, and every ASCII word starts upper-case; the rest stays."""
    spaced = F.regexp_replace(slug, "[-_]", " ")
    parts = F.regexp_extract_all(spaced, F.lit("([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), 1)
    raised = F.transform(
        parts,
        lambda p: F.when(p.rlike("^[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))
        .otherwise(p),
    )
    return F.array_join(raised, "")


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[A-Za-z0-9_]+$", "")


def file_title(title: Column, path: Column) -> Column:
    """The title, or one made from the file name where it is null or empty."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.nullif(title, F.lit("")), slug_title(strip_extension(name)))


def snippet(text: Column, width: int = 100) -> Column:
    """Collapsed, trimmed and cut text; the ellipsis depends on the raw length."""
    flat = F.substring(trim_ws(F.regexp_replace(text, f"{WS}+", " ")), 1, width)
    return F.concat(flat, F.when(F.length(text) > width, F.lit("…")).otherwise(F.lit("")))


def score_percent(score: Column) -> Column:
    return F.floor(score * 100 + 0.5).cast("int")


def score_band(score: Column) -> Column:
    pct = score_percent(score)
    return F.when(pct > 60, F.lit("green")).when(pct > 30, F.lit("yellow")).otherwise(F.lit("dim"))


def truncate_for_embedding(text: Column, limit: int = 1000) -> Column:
    return F.substring(text, 1, limit)
