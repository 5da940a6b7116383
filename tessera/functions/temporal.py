"""Decay, freshness and validity of facts, by whole days at a reference time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR, HALF_LIFE, HORIZON, FRESH_DAYS, FRESH = 0.1, 180.0, 360.0, 7, 0.2


def days(since: Column, reference: Column) -> Column:
    return F.floor((F.unix_seconds(reference.cast("timestamp")) - F.unix_seconds(since.cast("timestamp"))) / 86400)


def decayed(confidence: Column, d: Column, kind: str) -> Column:
    """The confidence after d days, never under FLOOR; unchanged for none."""
    d = d.cast("double")
    factor = {
        "exponential": F.pow(F.lit(0.5), d / HALF_LIFE),
        "linear": F.greatest(F.lit(0.0), 1 - d / HORIZON),
        "step": F.when(d <= HALF_LIFE, 1.0).when(d <= HORIZON, 0.5).otherwise(0.25),
        "logarithmic": F.greatest(F.lit(0.0), 1 - F.log1p(F.greatest(d, F.lit(0.0))) / F.log1p(F.lit(HORIZON))),
    }[kind]
    return F.when(d <= 0, confidence).otherwise(F.greatest(F.lit(FLOOR), confidence * factor))


def freshness(d: Column) -> Column:
    """1.2 for today down to 1 after FRESH_DAYS days."""
    return F.when(d <= FRESH_DAYS, 1 + FRESH * (1 - d.cast("double") / FRESH_DAYS)).otherwise(1.0)


def valid_confidence(confidence: Column, until: Column, reference: Column) -> Column:
    """FLOOR once the fact has run out."""
    return F.when(reference > until, F.lit(FLOOR)).otherwise(confidence)
