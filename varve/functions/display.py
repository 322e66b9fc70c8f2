"""What a page shows: money, numbers, times and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .prices import half_up

# Lower bounds of the bands.
SCORE_BANDS = [(65.0, "excellent"), (45.0, "good"), (25.0, "fair")]
DISCOUNT_TIERS = [(0.5, "huge"), (0.25, "large"), (0.1, "small")]
CONFIDENCE_BANDS = [(0.7, "high"), (0.4, "medium")]


def _band(value: Column, bands: list[tuple[float, str]], last: str) -> Column:
    out = F.when(value >= bands[0][0], bands[0][1])
    for low, name in bands[1:]:
        out = out.when(value >= low, name)
    return F.when(value.isNotNull(), out.otherwise(last))


def score_band(score: Column) -> Column:
    return _band(score, SCORE_BANDS, "weak")


def discount_tier(share: Column) -> Column:
    return _band(share, DISCOUNT_TIERS, "none")


def confidence_band(confidence: Column) -> Column:
    return _band(confidence, CONFIDENCE_BANDS, "low")


def grouped(value: Column) -> Column:
    """A whole number with no-break spaces between thousands."""
    return F.replace(F.format_number(half_up(value).cast("long"), 0), F.lit(","), F.lit("\u00a0"))


def money(value: Column) -> Column:
    """Canadian French: 1 299,99 $."""
    cents = half_up(value * 100).cast("long")
    return F.concat(grouped(F.floor(cents / 100)), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit("\u00a0$"))


def percent(share: Column) -> Column:
    return F.concat(half_up(share * 100).cast("long").cast("string"), F.lit("\u00a0%"))


def time_ago(then: Column, now: Column) -> Column:
    """Minutes, hours, days or months before now."""
    minutes = F.timestamp_diff("MINUTE", then, now)
    return (
        F.when(minutes < 1, "à l’instant").when(minutes < 60, F.format_string("il y a %d min", minutes)).when(minutes < 1440, F.format_string("il y a %d h", F.floor(minutes / 60)))
        .when(minutes < 43_200, F.format_string("il y a %d j", F.floor(minutes / 1440))).otherwise(F.format_string("il y a %d mois", F.floor(minutes / 43_200)))
    )
