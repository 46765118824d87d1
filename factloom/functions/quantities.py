"""Numbers in texts: figures and words, ranges, and whether a stated quantity is there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plain

# Units that stand for another, and units that count things.
UNITS = {
    "visit_count": "count", "game_count": "count", "run_count": "count", "occurrence_count": "count", "times": "count", "number": "count",
    "duration_minutes": "duration", "minutes": "duration", "time": "duration", "hours": "duration", "days": "duration", "weeks": "duration", "none": "",
}
COUNTING = ("count", "item_count", "trip_count", "ride_count", "flight_segment")

_ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: The words of the numbers from 1 to 99, "twenty-one" and "twenty one" alike.
WORDS = {w: n for n, w in enumerate(_ONES, 1)} | {t: 10 * k for k, t in enumerate(_TENS, 2)} | {f"{t}{mark}{w}": 10 * k + n for k, t in enumerate(_TENS, 2) for n, w in enumerate(_ONES[:9], 1) for mark in "- "}

_WORD = rf"(?:(?:{'|'.join(_TENS)})(?:[- ](?:{'|'.join(_ONES[:9])})\b)?|(?:{'|'.join(sorted(_ONES, key=len, reverse=True))}))\b"
_FIGURE = r"\d[\d,]*(?:\.\d+)?"
_NUMBER = rf"(?:{_FIGURE}|\b{_WORD})"
_BETWEEN = rf"(?i)\bbetween\s+({_NUMBER})\s+and\s+({_NUMBER})"
_TO = rf"(?i)({_NUMBER})\s*(?:-|–|—|\bto\b|\bthrough\b)\s*({_NUMBER})"


def unit(raw: Column) -> Column:
    """The unit a name stands for; others stay as they are, "none" and null are empty."""
    names = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, plain(raw)), plain(raw))


def number(text: Column) -> Column:
    """The value of a number in figures or words; null if it is none."""
    names = F.create_map(*(F.lit(x) for w, n in WORDS.items() for x in (w, float(n))))
    clean = F.regexp_replace(F.lower(F.trim(plain(text))), r"\s+", " ")
    return F.coalesce(F.regexp_replace(clean, ",", "").try_cast("double"), F.try_element_at(names, clean))


def numbers(text: Column) -> Column:
    """The values of all numbers in a text, in order."""
    found = F.regexp_extract_all(plain(text), F.lit(f"(?i)({_NUMBER})"), F.lit(1))
    return F.filter(F.transform(found, number), lambda v: v.isNotNull())


def stated_range(text: Column) -> Column:
    """Struct (low, high) of the first range in a text, "between a and b" before "a to b"; null without one, or if it does not rise."""

    def one(pattern: str) -> Column:
        low, high = (number(F.regexp_extract(plain(text), pattern, k)) for k in (1, 2))
        return F.when(low < high, F.struct(low.alias("low"), high.alias("high")))

    return F.coalesce(one(_BETWEEN), one(_TO))


def quantity_range(value: Column, unit_: Column, text: Column) -> Column:
    """The range that a quantity was stated as: one around the value, or for a unit that counts things any."""
    found = stated_range(text)
    return F.when(unit_.isin(*COUNTING) | value.between(found["low"], found["high"]), found)


def grounded(value: Column, text: Column) -> Column:
    """Whether the text states the value, in figures or words; null without a value."""
    return F.when(value.isNotNull(), F.exists(numbers(text), lambda v: (v == value) | (F.floor(v) == F.floor(value))))
