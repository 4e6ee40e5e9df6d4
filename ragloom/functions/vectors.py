"""Vector expressions: cosine similarity and the deterministic offline embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fake_embedding(text: Column, dimensions: int) -> Column:
    """Vector whose values are the bytes of the text's SHA-256, in -1..1, repeated to the dimensions asked for.

    Each of the 32 bytes is read once.
    """
    digest = F.sha2(text, 256)
    byte = lambda i: F.conv(F.substring(digest, i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("double")
    values = F.transform(F.sequence(F.lit(0), F.lit(min(dimensions, 32) - 1)), lambda i: byte(i) / 255 * 2 - 1)
    return values if dimensions <= 32 else F.slice(F.flatten(F.array_repeat(values, -(-dimensions // 32))), 1, dimensions)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 where a norm is 0. Norms that are stored need not be computed again."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)
