"""The heuristic that tells good entries ('g') from noise ('b'): an ordered list of rules, the first that applies decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .patterns import java
from .text import let, rstrip, strip

NOISE = ("CLASSIFIED", "CONFIDENTIAL", "SECRET", "See", "Terms", "This section contains no entries.", "UNCLASSIFIED")
NOUN_TAIL = P.TAIL_STOP[:-1] + "|if|when)"


def is_acronym_entry(term: Column, definition: Column) -> Column:
    shape = r"^[A-Z][./A-Z0-9-]{1,18}(?:\s*\([^)]{1,20}\))?$"
    return (term != "") & (F.length(term) <= 22) & term.rlike(java(shape)) & definition.rlike(r"^\p{L}") & (F.length(definition) >= 3)


def is_rank(term: Column, definition: Column) -> Column:
    return term.rlike(java(r"^\d[A-Z]{2,3}$")) & (F.length(strip(definition)) >= 3)


def strip_parentheses(c: Column, times: int = 3) -> Column:
    """Up to three flat groups in parentheses are peeled off the end."""
    out = rstrip(c)
    for _ in range(times):
        out = rstrip(F.regexp_replace(out, java(r"\s*\([^()]{1,120}\)\s*$"), ""))
    return out


def is_noun_phrase(term: Column) -> Column:

    def is_one(core: Column, tokens: Column) -> Column:
        tail = F.lower(F.regexp_replace(F.element_at(tokens, -1), "[,.:;]+$", ""))
        plain = F.length(F.regexp_replace(core, java(r"[^\p{L}\s/-]"), ""))
        return (strip(core) != "") & (F.size(tokens) <= 10) & ~core.rlike(java(r"\.\s+\S")) & ~tail.rlike(f"^{NOUN_TAIL}$") & (plain / F.length(core) >= 0.85)

    return let(strip_parentheses(term), lambda core: let(F.split(strip(core), java(r"\s+")), lambda tokens: is_one(core, tokens)))


def classify(term: Column, definition: Column) -> Column:
    """'g' or 'b'; a null term or definition counts as empty."""
    both = F.struct(*(strip(F.coalesce(c, F.lit(""))).alias(n) for c, n in ((term, "t"), (definition, "d"))))
    return let(both, lambda s: _verdict(s["t"], s["d"]))


def _verdict(t: Column, d: Column) -> Column:
    lower_pair = t.rlike(java("^[a-z]{2,5}$")) & d.rlike(java("^[a-z][ a-z]{2,49}$"))
    cites = d.rlike(java("^" + P.words("ADP AR ATP FM PAM SD STP TC TM") + r"[\s-]\d"))
    rules: list[tuple[Column, str | Column]] = [
        ((t == "") | (d == ""), "b"),
        (t.isin(*NOISE), "b"),
        (is_acronym_entry(t, d) | is_rank(t, d), "g"),
        (t.rlike(r"^[A-Z]{6,}\z"), "b"),
        (F.lower(t).rlike("^(?:pin |see |this section)"), "b"),
        (F.length(d) < 15, F.when(lower_pair, "g").otherwise("b")),
        (t.rlike(r"^(?:[abc]\. |\([1-5]\))"), "b"),
        (t.rlike(java(rf"\b{P.TAIL_STOP}$", "i")), "b"),
        ((F.length(t) < 2) | (F.length(t) > 200) | (F.length(strip_parentheses(t)) > 100), "b"),
        (t.rlike(java(r"^[ ,./\d-]+\z")), "b"),
        (t.rlike(java(r"\([A-Z]{2,5}\s*$|\(AR\b")), "b"),
        (~is_noun_phrase(t), "b"),
        (cites & (F.length(d) < 25), "b"),
        (d.rlike(java(r"^[).\d\s]+\z")), "b"),
    ]
    out = F.lit("g")
    for condition, verdict in reversed(rules):
        out = F.when(condition, verdict).otherwise(out)
    return out
