"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a weight schedule over training time. Targets share all words by weight; a target
stops at `max_passes` times its source's size and the excess goes to the others by weight. A source's documents are
taken in a fixed pseudo-random order, pass after pass, until its target is met; the document at the edge gives
the words still wanted. Each copy's training position is found by integrating the source's schedule and inverting
the cumulative demand at the middle of the copy; the result is range-sorted by position.

Null text has size 0; a null source is a source of its own, ordered last; repeated rows and rows that share a doc_id count
each. A document of size 0 is taken 0 times and has no position. Other columns, whatever their names, pass through
`mix_documents` and are ignored by `mix_plan`. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import materialise
from lodestone.llm.text import count_words

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
#: Knots (time, relative weight) of the schedules that sources take in turn: steady, rising, falling.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)))
#: Rows of one source whose running sum one task forms.
ROWS_PER_BUCKET = 4096


def integrate(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """Segments (start, length, weight, slope, demand before) of a piecewise linear schedule, scaled to total demand 1."""
    pieces = [(a, b - a, u, (v - u) / (b - a), (u + v) / 2 * (b - a)) for (a, u), (b, v) in zip(knots, knots[1:]) if b > a]
    total = sum(p[4] for p in pieces)
    out, done = [], 0.0
    for start, length, weight, slope, area in pieces:
        out.append((start, length, weight / total, slope / total, done))
        done += area / total
    return out


def time_of_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """When the cumulative demand of a schedule reaches share (0 to 1)."""
    result = None
    for start, length, weight, slope, before in integrate(knots):
        rest = F.greatest(share - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(weight * weight) + F.lit(2 * slope) * rest, F.lit(0.0)))
        here = F.lit(start) + F.least(2 * rest / (F.lit(weight) + root), F.lit(length))
        result = here if result is None else F.when(share >= F.lit(before), here).otherwise(result)
    return result


def source_targets(stats: DataFrame, weights: Sequence[int] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """Add source_rank (0-based) and target to stats(source, source_size); one row per source.

    Sorted by cap over weight, a source is capped as long as the even share of what is left would exceed its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = stats.withColumn("source_rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_passes).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    # the level holds at the first source, in that order, that it doesn't cap
    first_open = F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "source_rank", "level")
    open_level = F.min(F.when(F.col("cap") / F.col("weight") > F.col("level"), first_open)).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(open_level * F.col("weight"), F.col("cap")))
    return ranked.withColumn("target", target).drop("weight", "cap", "level")


def mix_plan(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_passes: int = MAX_PASSES,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    row: str = "doc_id",
) -> DataFrame:
    """Per document: row (a column that names it), doc_id, source, size, source_size, target, taken, before, quota, source_rank."""
    sizes = sizes_of(docs, row)
    return plan_sizes(sizes, weights, max_passes)


def sizes_of(docs: DataFrame, row: str = "doc_id") -> DataFrame:
    """row, doc_id, source, size, order_key (uniform, from doc_id), content (of the text) of every document."""
    return materialise(
        docs.select(
            F.col(row).alias("row"), "doc_id", "source", count_words(F.col("text")).alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order_key"), F.xxhash64("text").alias("content"),
        ),
        "mix-sizes",
    )


def plan_sizes(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """mix_plan from sizes_of."""
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(stats, weights, max_passes)
    # order_key is uniform, so its first characters cut every source into even buckets
    n_chars = max(1, math.ceil(math.log(max(1, sizes.count()) / ROWS_PER_BUCKET, 16)))
    sizes = sizes.withColumn("bucket", F.substring("order_key", 1, n_chars))
    bucket_sums = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    over_buckets = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket_sums = bucket_sums.withColumn("bucket_before", F.coalesce(F.sum("bucket_size").over(over_buckets), F.lit(0)))
    per_bucket = bucket_sums.join(targets, bucket_sums["source"].eqNullSafe(targets["source"])).select(
        bucket_sums["source"].alias("b_source"), F.col("bucket").alias("b_bucket"), "bucket_before", "source_size", "target", "source_rank"
    )
    in_bucket = Window.partitionBy("source", "bucket").orderBy("order_key", "doc_id", "size", "content", "row").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("inside", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    same = inside["source"].eqNullSafe(per_bucket["b_source"]) & (inside["bucket"] == per_bucket["b_bucket"])
    quota, size, source_size = F.floor(F.col("target")), F.col("size"), F.col("source_size")
    passes = F.when(source_size > 0, F.floor(quota / source_size)).otherwise(F.lit(0)).cast("long")
    edge = F.least(F.greatest(quota - passes * source_size - F.col("before"), F.lit(0)), size)
    return (
        inside.join(per_bucket, same)
        .withColumn("before", F.col("inside") + F.col("bucket_before"))
        .select("row", "doc_id", "source", "size", "source_size", "target", (passes * size + edge).cast("long").alias("taken"), "before", quota.alias("quota"), "source_rank", "content")
    )


def position(copy: Column, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> Column:
    """Training position (0 to 1) of a 0-based copy of a planned document; null for what is not taken."""
    words = F.least(F.col("size"), F.col("taken") - copy * F.col("size"))
    share = (copy * F.col("source_size") + F.col("before") + words / F.lit(2.0)) / F.col("quota")
    result = None
    for i, knots in enumerate(schedules):
        here = time_of_demand(share, knots)
        result = here if result is None else F.when(F.col("source_rank") % len(schedules) == i, here).otherwise(result)
    return F.when(words > 0, result)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, position (of the first copy), range-sorted by position."""
    plan = mix_plan(docs, **options)
    first = F.round(position(F.lit(0), options.get("schedules", SCHEDULES)), 9)
    return plan.select("doc_id", "size", "source_size", "target", "taken", first.alias("position")).orderBy(F.asc_nulls_last("position"), "doc_id")


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_passes: int = MAX_PASSES, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """The rows of docs in training order, each as often as the mix takes it (the copy at the edge whole)."""
    sizes, own = sizes_of(docs), docs["doc_id"]
    columns = docs.columns
    if not sizes.groupBy("doc_id").count().filter("count > 1").isEmpty():  # rows that share a doc_id are named by a number
        name = "row"
        while name in columns:
            name += "_"
        docs = materialise(docs.withColumn(name, F.monotonically_increasing_id()), "mix-rows")
        sizes, own = sizes_of(docs, name), docs[name]
    plan = plan_sizes(sizes, weights, max_passes).filter("taken > 0")
    copies = plan.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("taken") / F.col("size")) - 1).cast("int"))))
    copies = copies.select("row", position(F.col("copy"), schedules).alias("position"), F.col("doc_id").alias("id"), "copy", "content")
    joined = docs.join(copies, own.eqNullSafe(copies["row"]))
    return joined.orderBy(*[copies[c] for c in ("position", "id", "content", "copy", "row")]).select(*[docs[c] for c in columns])
