"""Measures of extracted text: how much of it looks like text, and where pages and glossaries lie."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import java

LOOSE_HEADER = r"(?:^|\n)\s*glossary(?:\s+of\s+(?:abbreviations?|acronyms?|terms?))?\s*(?:\n|$)"
LOOSE_END = r"(?:^|\n)\s*(?:appendix\s+[A-Z]|bibliography|index|references|PIN\s*:?\s*\d{4,})\b"
PAGE_MARK = r"--\s*(\d+)\s+of\s+\d+\s*--"


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _without(c: Column, characters: str) -> Column:
    """How many of these characters there are: what goes when they go, with no array of matches."""
    return F.length(c) - F.length(F.translate(c, characters, ""))


def vowel_ratio(c: Column) -> Column:
    """Plain vowels among letters of any alphabet, 0 for texts of under 100 letters."""
    letters = F.length(F.regexp_replace(c, r"\P{L}+", ""))
    return F.when(letters >= 100, _without(c, "AEIOUaeiou") / letters).otherwise(F.lit(0.0))


def control_rate(c: Column) -> Column:
    return _ratio(F.length(c) - F.length(F.regexp_replace(c, r"[\x00-\x08\x0B\x0E-\x1F]+", "")), F.length(c))


def replacement_rate(c: Column) -> Column:
    return _ratio(_without(c, "�"), F.length(c))


def newline_rate(c: Column) -> Column:
    return _ratio(_without(c, "\n"), F.length(c))


def longest_space_run(c: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(" +"), F.lit(0)), F.length)), F.lit(0))


def sentences_per_thousand(c: Column) -> Column:
    return _ratio((F.length(c) - F.length(F.regexp_replace(c, r"[!.?](?=\s)", ""))) * 1000, F.length(c))


def page_breaks(c: Column) -> Column:
    return F.greatest(F.when(c.contains("--"), F.regexp_count(c, F.lit(PAGE_MARK))).otherwise(F.when(c.isNotNull(), 0)), _without(c, "\f"))


def page_slice(c: Column, first: Column, last: Column) -> Column:
    """From the mark of page `first` (from 1) up to the first mark beyond `last`; the whole text if there is no such mark."""
    marks = F.regexp_extract_all(c, F.lit(PAGE_MARK), F.lit(0))
    numbers = F.transform(F.regexp_extract_all(c, F.lit(PAGE_MARK), F.lit(1)), lambda n: n.cast("int"))
    after = F.slice(F.split(c, PAGE_MARK, -1), F.lit(2), F.greatest(F.size(marks), F.lit(1)))
    begin = F.array_position(numbers, first)
    beyond = F.array_position(F.transform(numbers, lambda n: n > last), F.lit(True))
    stop = F.when(beyond > 0, beyond).otherwise(F.size(marks) + 1)
    parts = F.transform(F.arrays_zip(marks.alias("mark"), after.alias("text")), lambda p: F.concat(p["mark"], p["text"]))
    return F.when((begin > 0) & (begin < stop), F.array_join(F.slice(parts, begin.cast("int"), (stop - begin).cast("int")), "")).otherwise(c)


def has_loose_header(c: Column) -> Column:
    return c.rlike(java(LOOSE_HEADER, "i"))


def range_relation(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    """How two page ranges, either of which may be null, lie."""
    return (
        F.when(a_first.isNull() & b_first.isNull(), "neither")
        .when(a_first.isNull(), "second-only")
        .when(b_first.isNull(), "first-only")
        .when((a_first == b_first) & (a_last == b_last), "exact")
        .when((b_first <= a_last) & (a_first <= b_last), "overlap")
        .otherwise("disjoint")
    )
