"""Vector columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1, normalised; an array of zeros if there is none."""
    chosen = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda p: p["m"] == 1)
    width = F.size(F.element_at(vectors, 1))
    zeros = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(chosen, zeros, lambda s, p: F.zip_with(s, p["v"], lambda x, y: x + y.cast("double")))
    mean = F.transform(total, lambda x: x / F.greatest(F.size(chosen), F.lit(1)))
    length = norm(mean)
    return F.when(length == 0, mean).otherwise(F.transform(mean, lambda x: x / length))


def pool_rows(rows: DataFrame, group: Sequence[str], vector: str, mask: str) -> DataFrame:
    """group, pooled: the normalised mean of a group's vectors whose mask is 1; a group without any is left out.

    Sums are formed for each dimension, in part before the shuffle, so a group may have any number of rows.
    """
    parts = rows.filter(F.col(mask) == 1).select(*group, F.posexplode(vector).alias("at", "x"))
    means = parts.groupBy(*group, "at").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda p: p["mean"])  # one entry for each dimension
    gathered = means.groupBy(*group).agg(mean.alias("mean"))
    length = norm(F.col("mean"))
    return gathered.select(*group, F.when(length == 0, F.col("mean")).otherwise(F.transform("mean", lambda x: x / length)).alias("pooled"))


def softmax(logits: Column, index: int) -> Column:
    """Share of one of the logits; the largest is taken off first."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.element_at(powers, index + 1) / F.aggregate(powers, F.lit(0.0), lambda s, v: s + v)
