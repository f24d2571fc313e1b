"""Numbers with a unit of time, and percentages, read from normalised English.

A replacement marks every hit in the text; splitting at the marks gives each hit together with
the text before and after it, so no offsets and no per-row Python are needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactum.functions.numbers import round_half_up

# Number words and the patterns over them.
SMALL_NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    "fifteen sixteen seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_VALUES = {w: float(i) for i, w in enumerate(SMALL_NUMBERS)} | {
    w: float(10 * (i + 2)) for i, w in enumerate(TENS)
}
_WORDS = "|".join(sorted([*NUMBER_VALUES, "hundred"], key=len, reverse=True))
WORD_NUMBER = rf"(?:{_WORDS})(?:[ -](?:and[ -])?(?:{_WORDS}))*"
DIGITS = r"\d+(?:\.\d+)?"
ONE_AS_ARTICLE = (
    r"(?<!\b(?:hours?|days?|weeks?|months?|years?|times|riyals?|sar)\s)an?"
)
NUMBER = rf"(?:{DIGITS}|{WORD_NUMBER}(?: and a half)?|{ONE_AS_ARTICLE})"
BRACKETED_REPEAT = rf"(?:\s*\(\s*(?:{DIGITS}|{WORD_NUMBER})\s*\))?"
UNIT_MODIFIER = (
    r"(?:(?:calendar|working|business|full|consecutive|additional|more|further|extra)\s+)?"
)
QUANTITY = (
    rf"\b({NUMBER}){BRACKETED_REPEAT}\s*-?\s*{UNIT_MODIFIER}"
    r"(hours?|days?|weeks?|months?|years?)\b"
)
PERCENTAGE = rf"\b({DIGITS}|{WORD_NUMBER})\s*(?:%|per[ -]?cent\b)"
MONTHS_PER_UNIT = {"year": 12.0, "month": 1.0}
WEEKS_PER_MONTH = 4.345
DAYS_PER_UNIT = {"day": 1.0, "week": 7.0, "month": 30.0, "year": 365.0}

_OPEN, _CLOSE, _SEP = "\u0001", "\u0002", "\u0003"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``body``."""
    return F.transform(F.array(value), body)[0]


_VALUE_MAP = "map(" + ", ".join(f"'{w}', {v}D" for w, v in NUMBER_VALUES.items()) + ")"


def parse_number(phrase: Column) -> Column:
    """Digits or English number words; null when it is neither."""
    half = F.when(phrase.endswith(" and a half"), 0.5).otherwise(0.0)
    words = F.split(F.regexp_replace(phrase, " and a half$", ""), "[ -]+")
    values = F.expr(_VALUE_MAP)
    total = F.aggregate(
        words,
        F.lit(0.0),
        lambda acc, w: F.when(w == "and", acc)
        .when(w == "hundred", F.when(acc == 0, 100.0).otherwise(acc * 100))
        .otherwise(acc + F.try_element_at(values, w)),
    )
    return (
        F.when(phrase.rlike(r"^\d"), phrase.try_cast("double"))
        .when(phrase.isin("a", "an"), 1.0)
        .otherwise(total + half)
    )


def mark_quantities(text: Column) -> Column:
    """The text with every quantity wrapped in control characters, number and unit in front.

    One pass over the text; a text without any unit word is not scanned.
    """
    marks = f"{_OPEN}$1{_SEP}$2{_SEP}$0{_CLOSE}"
    return F.when(
        text.rlike("hour|day|week|month|year"), F.regexp_replace(text, QUANTITY, marks)
    ).otherwise(text)


def is_marked(text: Column) -> Column:
    return text.contains(_OPEN)


def unmark(text: Column) -> Column:
    bare = F.regexp_replace(text, f"{_OPEN}[^{_SEP}]*{_SEP}[^{_SEP}]*{_SEP}", "")
    return F.when(is_marked(text), F.translate(bare, _CLOSE, "")).otherwise(text)


def marked_quantities(marked: Column) -> Column:
    """``array<struct<value, unit, before, after>>`` of a marked text, in order."""

    def plain(part: Column) -> Column:
        bare = F.regexp_replace(part, f"^[^{_SEP}]*{_SEP}[^{_SEP}]*{_SEP}", "")
        return F.translate(bare, _CLOSE, "")

    def read(parts: Column, plains: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            return F.struct(
                parse_number(F.trim(F.substring_index(part, _SEP, 1))).alias("value"),
                F.regexp_replace(F.split(part, _SEP)[1], "s$", "").alias("unit"),
                F.array_join(F.slice(plains, F.lit(1), i + 1), "").alias("before"),
                F.concat(
                    F.substring_index(part, _CLOSE, -1),
                    F.array_join(F.slice(plains, i + 3, F.size(plains)), ""),
                ).alias("after"),
            )

        return F.transform(F.slice(parts, F.lit(2), F.size(parts)), one)

    hits = let(
        F.split(marked, _OPEN),
        lambda parts: let(F.transform(parts, plain), lambda plains: read(parts, plains)),
    )
    return F.filter(hits, lambda h: h["value"].isNotNull())


def quantities(text: Column) -> Column:
    return marked_quantities(mark_quantities(text))


def percentages(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PERCENTAGE), F.lit(1))
    return F.filter(F.transform(found, parse_number), lambda v: v.isNotNull())


def to_months(q: Column) -> Column:
    months = F.when(q["unit"] == "week", round_half_up(q["value"] / WEEKS_PER_MONTH, 1))
    for unit, factor in MONTHS_PER_UNIT.items():
        months = months.when(q["unit"] == unit, q["value"] * factor)
    return months


def to_days(q: Column) -> Column:
    days = F.lit(None).cast("double")
    for unit, factor in DAYS_PER_UNIT.items():
        days = F.when(q["unit"] == unit, q["value"] * factor).otherwise(days)
    return days


def first_months(qs: Column, weeks: bool = True) -> Column:
    """Months of the first quantity that has any."""
    months = F.transform(qs, lambda q: F.when(F.lit(weeks) | (q["unit"] != "week"), to_months(q)))
    return F.try_element_at(F.array_compact(months), F.lit(1))
