"""Arithmetic of ranking and reports."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom import config


def rounded(x: Column, digits: int = 1) -> Column:
    """Half up on the binary value, below zero as well."""
    by = 10**digits
    return F.floor(x.cast("double") * by + 0.5) / by


def percent(part: Column, whole: Column) -> Column:
    """One decimal; 0 where there is nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part / whole * 1000 + 0.5) / 10)


def rate(part: Column, whole: Column, digits: int = 3) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(rounded(part / whole, digits))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + n / F.coalesce(df, F.lit(1)))


def freshness(hours: Column) -> Column:
    """Half-life of eight hours, a linear end from 48 to 72."""
    decay = F.pow(F.lit(0.5), hours / 8)
    return F.when(hours <= 0, F.lit(1.0)).when(hours >= 72, F.lit(0.0)).when(hours > 48, decay * (1 - (hours - 48) / 24)).otherwise(decay)


def coverage(sources: Column) -> Column:
    return F.when(sources <= 1, F.lit(0.2)).otherwise(F.least(F.lit(1.0), 0.2 + F.log(sources.cast("double")) / math.log(12) * 0.8))


def geography(country: Column) -> Column:
    return F.when(country.isin("US", "CA", "US_CA"), F.lit(1.0)).when(country == "GLOBAL_NA", F.lit(0.65)).otherwise(F.lit(0.35))


def tier_weight(tier: Column) -> Column:
    out = F
    for name, weight in config.TIER_WEIGHT.items():
        out = out.when(tier == name, F.lit(weight))
    return out.otherwise(F.lit(config.TIER_WEIGHT["C"]))


def authority(best: Column, top_tier: Column, release: Column) -> Column:
    bonus = F.least(F.lit(0.15), F.greatest(F.lit(0), top_tier - 1) * 0.05)
    return F.least(F.lit(1.0), best + bonus) * F.when(release, 0.5).otherwise(1.0)


def prominence(image: Column, summary: Column, entities: Column, title: Column) -> Column:
    part = lambda test, weight: F.when(F.coalesce(test, F.lit(False)), weight).otherwise(0.0)
    return F.least(F.lit(1.0), part(image.isNotNull(), 0.35) + part(F.length(summary) > 40, 0.35) + part(entities >= 2, 0.2) + part(F.length(title).between(35, 140), 0.1))


def velocity(recent: Column, members: Column) -> Column:
    return F.when(members <= 1, F.lit(0.0)).otherwise(F.least(F.lit(1.0), recent / F.greatest(F.lit(2.0), members * 0.6)))
