"""Scores, vectors and stable hashes as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS, HALF_LIFE_DAYS, RECENCY_HALF_LIFE_HOURS = 86_400_000, 180, 6
FNV_BASIS, FNV_PRIME = 0x811C9DC5, 0x01000193


def clamp01(x: Column) -> Column:
    """Into [0, 1]; what is no finite number is 0."""
    y = x.cast("double")
    return F.when(y.isNull() | F.isnan(y) | (F.abs(y) == F.lit(float("inf"))), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)))


def age_days(created_ms: Column, now_ms) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(now_ms) - created_ms) / float(DAY_MS))


def prior(importance: Column, age: Column) -> Column:
    """Importance with a slight decay by age in days (M3)."""
    return importance * 0.85 + F.pow(F.lit(0.5), age / HALF_LIFE_DAYS) * 0.15


def blend(relevance: Column, prior_score: Column, weight: float) -> Column:
    """Relevance against prior (M4)."""
    return prior_score if weight == 0 else weight * F.coalesce(relevance, F.lit(0.0)) + (1 - weight) * prior_score


def recency(age: Column, bonus: float) -> Column:
    """Bonus of what is only hours old (M5)."""
    return bonus * F.pow(F.lit(0.5), age * 24 / RECENCY_HALF_LIFE_HOURS)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty, unequally long or zero vectors (M6)."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    fine = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(fine & (norms > 0), _dot(a, b) / norms).otherwise(0.0)


def score_to_unit(score: Column, levels: int) -> Column:
    """A level score on [0, 1] (M7)."""
    return clamp01(score / max(1, levels - 1))


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-16 units of a text (M8)."""
    raw = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), (F.length(raw) / 4 - 1).cast("int")), lambda k: F.conv(F.substring(raw, k * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    units = F.when(F.length(raw) > 0, units).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(units, F.lit(FNV_BASIS).cast("bigint"), lambda h, u: F.pmod(h.bitwiseXOR(u) * F.lit(FNV_PRIME).cast("bigint"), F.lit(1 << 32).cast("bigint")))


def vector_key(model: Column, dims: Column, text: Column) -> Column:
    """Cache key of an embedding (M9)."""
    return F.substring(F.sha2(F.concat_ws("|", model, dims.cast("string"), text).cast("binary"), 256), 1, 32)


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    """Share of a rank in reciprocal rank fusion."""
    return F.lit(1.0) / (F.lit(k) + rank)
