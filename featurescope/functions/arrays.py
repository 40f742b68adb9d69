"""Column expressions over feature and label arrays; they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def ones(a: Column) -> Column:
    """Cardinality of a 0/1 array."""
    return F.aggregate(a, F.lit(0), lambda s, x: s + x.cast("int"))


def both(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("int")), F.lit(0), lambda s, x: s + x)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of 0/1 arrays; 1 where neither has a label."""
    union = ones(a) + ones(b) - both(a, b)
    return F.when(union == 0, F.lit(1.0)).otherwise(both(a, b) / union)


def hamming(a: Column, b: Column) -> Column:
    """Share of differing positions."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def label_entropy(rates: Column) -> Column:
    """Mean binary entropy, in bits, of an array of label rates; constant labels count as 0."""

    def bits(p: Column) -> Column:
        return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))

    return total(F.transform(rates, bits)) / F.size(rates)


def finite(a: Column) -> Column:
    """Whether an array has no null, NaN or infinite entry."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
