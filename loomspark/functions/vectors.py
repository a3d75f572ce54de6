"""Vector expressions on array columns; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    zero = F.lit(0.0).cast("double")
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: (x.cast("double") / n).cast("float")))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is not 0, over an array of arrays; zeros if none is."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda p: p["m"] != 0), lambda p: p["t"])
    count = F.greatest(F.size(kept), F.lit(1))
    width = F.size(tokens[0])
    zeros = F.array_repeat(F.lit(0.0).cast("double"), width)
    total = F.aggregate(kept, zeros, lambda s, t: F.zip_with(s, t, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: (x / count).cast("float"))


def softmax(logits: Column) -> Column:
    """NaN logits count as minus infinity."""
    clean = F.transform(logits, lambda x: F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x.cast("double")))
    e = F.transform(clean, lambda x: F.exp(x - F.array_max(clean)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0).cast("double"), lambda s, y: s + y))


def argmax(values: Column) -> Column:
    """0-based position of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
