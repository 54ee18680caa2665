"""Vector functions over ``array<float|double>`` columns, as higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def population_std(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(F.array(mean(v)), lambda m: total(F.transform(v, lambda x: (x - m) * (x - m)))), F.lit(0.0), lambda a, x: a + x) / F.size(v))


def row_zscore(v: Column) -> Column:
    """(v - mean) / population std; only centred if the std is 1e-8 or less.  Mean and std are computed once a row."""
    v = doubles(v)
    moments = F.transform(F.array(F.struct(mean(v).alias("m"), population_std(v).alias("s"))), lambda q: F.transform(v, lambda x: (x - q["m"]) / F.when(q["s"] > EPSILON, q["s"]).otherwise(1.0)))
    return F.element_at(moments, 1)


def row_l2(v: Column) -> Column:
    """v / (norm + 1e-8)."""
    v = doubles(v)
    scaled = F.transform(F.array(F.sqrt(total(F.transform(v, lambda x: x * x)))), lambda n: F.transform(v, lambda x: x / (n + EPSILON)))
    return F.element_at(scaled, 1)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(total(F.transform(F.zip_with(doubles(a), doubles(b), lambda x, y: x - y), lambda d: d * d)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def hash_bits(hexadecimal: Column) -> Column:
    """A 64-bit hash in hexadecimal as a long; null if it is none."""
    return F.when(hexadecimal.rlike("^[0-9a-fA-F]{16}$"), F.conv(hexadecimal, 16, -10).cast("long"))
