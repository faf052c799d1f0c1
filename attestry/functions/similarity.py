"""String and vector similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 768
FUSION = {"trigram": 0.45, "vector": 0.35, "state": 0.12}  # fixed weights


def words(col: Column) -> Column:
    """Lower-cased words: runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def trigrams(col: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each word padded by two spaces before and one after."""
    grams = F.transform(words(col), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared over united; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for different lengths or a zero vector."""
    return once(F.struct(a.alias("a"), b.alias("b")), lambda v: _cosine(v["a"], v["b"]))


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def hash_embedding(col: Column, dims: int = DIMENSIONS) -> Column:
    """Deterministic stand-in for an embedding: the bytes of the SHA-256 digest, repeated, through a cosine."""
    digest = F.sha2(F.coalesce(col, F.lit("")), 256)
    byte = lambda d, i: F.conv(F.substring(d, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return once(digest, lambda d: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.cos((byte(d, i) - 128) / 128 * F.lit(3.141592653589793)) / 2 + 0.5))


def positional_confidence(query: Column, name: Column) -> Column:
    """1 for equal, 0.8 if one holds the other, else one half and up by the share of places with equal characters."""
    a, b = F.trim(F.lower(query)), F.trim(F.lower(name))
    longest = F.greatest(F.length(a), F.length(b))
    shortest = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(shortest, F.lit(1))), F.lit(0), lambda s, i: s + F.when((i <= shortest) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), 1).otherwise(0))
    ratio = F.when(longest == 0, F.lit(1.0)).otherwise(same / longest)
    return F.when(a == b, F.lit(1.0)).when(F.contains(b, a) | F.contains(a, b), F.lit(0.8)).otherwise(F.lit(0.5) + ratio * 0.5)


def fused(trigram: Column, vector: Column, state_match: Column) -> Column:
    """Weighted sum; a missing or zero vector similarity counts as one half."""
    return trigram * FUSION["trigram"] + F.coalesce(F.nullif(vector, F.lit(0.0)), F.lit(0.5)) * FUSION["vector"] + state_match * FUSION["state"]


def confidence_level(col: Column) -> Column:
    return F.when(col >= 0.9, "high").when(col >= 0.7, "medium").when(col >= 0.5, "low").otherwise("unknown")


def title_match(title: Column, name: Column) -> Column:
    """1 for equal, 0.85 if one holds the other, else 0.8 times the share of the name's distinct words in the title."""
    a, b = F.lower(title), F.lower(name)
    wa, wb = F.array_distinct(F.split(a, r"\s+")), F.array_distinct(F.split(b, r"\s+"))
    return F.when(a == b, F.lit(1.0)).when(F.contains(a, b) | F.contains(b, a), F.lit(0.85)).otherwise(F.size(F.array_intersect(wa, wb)) / F.size(wb) * 0.8)
