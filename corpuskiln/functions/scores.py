"""Sub-scores of the confidence in a retrieved chunk, each from 0 to 1, and their weighted sum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskiln import config


def as_time(value: Column) -> Column:
    """A timestamp from ISO 8601 text, also without separators; null if it cannot be read."""
    return F.coalesce(
        F.try_to_timestamp(value),
        F.try_to_timestamp(value, F.lit("yyyyMMdd")),
        F.try_to_timestamp(value, F.lit("yyyyMMdd'T'HHmmss")),
    )


def freshness(date: Column, as_of: Column, decay_days: float = config.FRESHNESS_DECAY_DAYS) -> Column:
    """exp(-age / decay); 1 for dates to come, a fixed value for unknown ones."""
    days = (F.unix_micros(as_of) - F.unix_micros(date)) / F.lit(86400e6)
    return F.when(date.isNull(), F.lit(config.FRESHNESS_UNKNOWN)).when(days <= 0, F.lit(1.0)).otherwise(F.exp(-days / F.lit(decay_days)))


def trust(source: Column, overrides: dict[str, float] | None = None, default: float = config.DEFAULT_TRUST) -> Column:
    """The value of the first override whose text the source contains, else the default; the default for null."""
    found = reduce(lambda c, kv: c.when(source.contains(kv[0]), F.lit(kv[1])), ((k, v) for k, v in (config.TRUST_OVERRIDES if overrides is None else overrides).items() if k), F.when(F.lit(False), F.lit(0.0)))
    return found.otherwise(F.lit(default))


def overlap(retrieved_by: Column) -> Column:
    """Share of the two methods that found the chunk."""
    return F.coalesce(F.size(F.array_distinct(retrieved_by)), F.lit(0)) / F.lit(2.0)


def relevance(logit: Column) -> Column:
    """Sigmoid of a reranker's score, safe at any size; a fixed value for null."""
    e = F.exp(-F.abs(logit))
    return F.when(logit.isNull(), F.lit(config.RELEVANCE_UNKNOWN)).when(logit >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def weighted(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the parts, held within 0 and 1; no weights mean the default ones."""
    weights = weights or config.WEIGHTS
    total = reduce(lambda a, b: a + b, (F.lit(float(weights.get(k, 0.0))) * v for k, v in parts.items()))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
