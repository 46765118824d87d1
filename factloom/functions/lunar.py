"""The Chinese lunisolar calendar by its rule, from new moons and the sun's longitude.

A month begins on the day of a new moon in China's time (UTC+8). Month 11 holds the winter
solstice. Where thirteen months lie between two such months, the first without a principal
term (a multiple of 30 degrees) is a leap month and repeats the number before it. New moons
are right to some seconds and the sun to a quarter of an hour, from 1900 to 2100.
"""

from __future__ import annotations

from datetime import date
from functools import lru_cache
from math import floor, radians, sin

# Terms of a mean new moon's correction in days, as
# (days, power of the orbit's eccentricity, multiples of the sun's anomaly, the moon's anomaly and its latitude).
MOON_TERMS = (
    (-0.40720, 0, 0, 1, 0), (0.17241, 1, 1, 0, 0), (0.01608, 0, 0, 2, 0), (0.01039, 0, 0, 0, 2),
    (0.00739, 1, -1, 1, 0), (-0.00514, 1, 1, 1, 0), (0.00208, 2, 2, 0, 0), (-0.00111, 0, 0, 1, -2),
    (-0.00057, 0, 0, 1, 2), (0.00056, 1, 1, 2, 0), (-0.00042, 0, 0, 3, 0), (0.00042, 1, 1, 0, 2),
    (0.00038, 1, 1, 0, -2), (-0.00024, 1, -1, 2, 0),
)
CHINA = 8 / 24
#: Days from the start of Julian day numbers to the day before 0001-01-01.
EPOCH = 1721424.5


def _clock(year: float) -> float:
    """Days by which even time is ahead of the earth's turning, about."""
    return (29 + (year - 1950) * 0.66) / 86400


def new_moon(k: int) -> int:
    """The ordinal of the day, in China, of the k-th new moon after the first of the year 2000."""
    t = k / 1236.85
    day = 2451550.09766 + 29.530588861 * k + 0.00015437 * t * t
    e = 1 - 0.002516 * t
    sun, moon, latitude = 2.5534 + 29.1053567 * k, 201.5643 + 385.81693528 * k + 0.0107582 * t * t, 160.7108 + 390.67050284 * k - 0.0016118 * t * t
    day += sum(c * e**p * sin(radians(x * sun + y * moon + z * latitude)) for c, p, x, y, z in MOON_TERMS)
    day += 0.000325 * sin(radians(299.77 + 0.107408 * k)) - 0.00017 * sin(radians(124.7746 - 1.56375588 * k))
    return floor(day - _clock(2000 + t * 100) + CHINA - EPOCH)


def sun(ordinal: int) -> float:
    """The sun's longitude in degrees at the start of a day in China."""
    t = (ordinal + EPOCH - CHINA + _clock(ordinal / 365.2425) - 2451545) / 36525
    anomaly = radians(357.52911 + 35999.05029 * t)
    centre = (1.914602 - 0.004817 * t) * sin(anomaly) + 0.019993 * sin(2 * anomaly) + 0.000289 * sin(3 * anomaly)
    return (280.46646 + 36000.76983 * t + centre - 0.00569 - 0.00478 * sin(radians(125.04 - 1934.136 * t))) % 360


def _holding_solstice(year: int) -> int:
    """Which new moon begins the month of a year's winter solstice."""
    day = date(year, 12, 18).toordinal()
    while sun(day + 1) < 270:
        day += 1
    k = round((day - date(2000, 1, 6).toordinal()) / 29.530588861) + 1
    while new_moon(k) > day:
        k -= 1
    return k


@lru_cache(maxsize=512)
def _months(year: int) -> dict[int, int]:
    """First days of the months from 11 of the year before (as -1) and 12 (as 0) to 10, leap months left out."""
    first, last = _holding_solstice(year - 1), _holding_solstice(year)
    starts = [new_moon(k) for k in range(first, last + 1)]
    leap = len(starts) == 14
    out: dict[int, int] = {}
    for start, end in zip(starts, starts[1:], strict=False):
        if leap and out and sun(start) // 30 == sun(end) // 30:
            leap = False
            continue
        out[len(out) - 1] = start
    return out


def day_of(year: int, month: int, day: int) -> date | None:
    """The day of a lunar date, its leap months apart; None before 1900 and after 2100."""
    if not 1900 <= year <= 2100:
        return None
    start = _months(year)[month] if month <= 10 else _months(year + 1)[month - 12]
    return date.fromordinal(start + day - 1)
