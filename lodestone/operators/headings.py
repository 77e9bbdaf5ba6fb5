"""Heading operators: admission, rejection, clustering, relevance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.functions import lists as L
from lodestone.functions import text as X
from lodestone.functions.vectors import cosine
from lodestone.operators.containment import phrase_hits
from lodestone.storage import materialise

MAX_PATTERNS = 100
#: A heading as far as this from the query stays only if it occurs twice.
LEAST_SIMILARITY = 0.15


def admit_headings(pages: DataFrame, group: Sequence[str], page: str, n: int = 30) -> DataFrame:
    """group, page, nth, tag, text of the first n headings of pages with enough words and not too many headings."""
    kept = pages.filter((F.col("word_count") > 50) & ~F.coalesce("non_article", F.lit(False)) & (F.size("headings") / F.col("word_count") <= 0.10))
    rows = kept.select(*group, F.col(page).alias("page"), F.posexplode(F.slice("headings", 1, n)).alias("nth", "h"))
    return rows.select(*group, "page", "nth", F.col("h.tag").alias("tag"), F.col("h.text").alias("text"))


def reject_headings(headings: DataFrame, phrases: Sequence[str] = L.HEADING_BLACKLIST) -> DataFrame:
    return headings.filter(~X.heading_rejected(F.col("text"), phrases))


def heading_patterns(headings: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, tag, text, count, pages: equal headings without regard to case. Scales with any group."""
    rows = headings.groupBy(*group, "tag", F.lower("text").alias("text"))
    return rows.agg(F.count(F.lit(1)).alias("count"), F.countDistinct("page").alias("pages"))


def heading_clusters(headings: DataFrame, group: Sequence[str], n: int = MAX_PATTERNS) -> DataFrame:
    """group, tag, text, count, first_seen: each heading joins the first pattern of its tag that contains it, or starts one.

    The order of headings decides, so a group is folded in one task. Its rows come sorted and are read as a stream: only the
    first n patterns are ever held, and once there are n the rest of the group is passed over.
    """
    fields = [headings.schema[g] for g in group]
    schema = T.StructType([*fields, T.StructField("tag", T.StringType()), T.StructField("text", T.StringType()), T.StructField("count", T.LongType()), T.StructField("first_seen", T.IntegerType())])
    arrow_schema = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, patterns = None, []
        for batch in batches:
            keys = list(zip(*[batch.column(g).to_pylist() for g in group]))
            done: list[tuple] = []
            for own, tag, text in zip(keys, batch.column("tag").to_pylist(), batch.column("text").to_pylist()):
                if own != key:
                    done += [(*key, p[0], p[1], p[3], k) for k, p in enumerate(patterns)]
                    key, patterns = own, []
                if len(patterns) >= n:
                    continue
                low = (text or "").lower()
                hit = next((p for p in patterns if p[0] == tag and low in p[2]), None)
                if hit:
                    hit[3] += 1
                else:
                    patterns.append([tag, text, low, 1])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow_schema.types)], schema=arrow_schema)
        if patterns:
            done = [(*key, p[0], p[1], p[3], k) for k, p in enumerate(patterns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow_schema.types)], schema=arrow_schema)

    rows = headings.select(*group, "page", "nth", "tag", "text").repartition(*group).sortWithinPartitions(*group, "page", "nth")
    return rows.mapInArrow(fold, schema)


def all_clusters(headings: DataFrame, group: Sequence[str]) -> DataFrame:
    """What heading_clusters gives without a limit on patterns, of groups of any size.

    A heading starts a pattern unless an earlier one of its tag contains it, since what contains that one contains it too. So
    the first heading that contains it, itself perhaps, is its pattern, and headings may be looked up in each other in any order.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    first = F.min(F.struct("page", "nth", "text"))
    equal = headings.groupBy(*group, "tag", low.alias("low")).agg(F.count(F.lit(1)).alias("count"), first.alias("first"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("first", "tag")).cast("long")
    held = materialise(equal.select(*group, "tag", "low", "count", F.col("first.text").alias("text"), place.alias("place")), "headings")
    keys = [*group, "tag"]
    hits = phrase_hits(held.select(*keys, F.col("place").alias("text_id"), F.col("low").alias("text")), held.select(*keys, "place", F.col("low").alias("phrase")), keys)
    nothing = {"text": F.lit(None).cast("string"), "count": F.lit(None).cast("long")}
    both = hits.select(*keys, "place", F.col("text_id").alias("pattern"), *[c.alias(n) for n, c in nothing.items()])
    both = both.unionByName(held.select(*keys, "place", F.lit(None).cast("long").alias("pattern"), "text", "count"))
    owned = both.groupBy(*keys, "place").agg(F.min("pattern").alias("pattern"), F.max("text").alias("text"), F.max("count").alias("count"))
    patterns = owned.groupBy(*keys, "pattern").agg(F.max(F.when(F.col("place") == F.col("pattern"), F.col("text"))).alias("text"), F.sum("count").alias("count"))
    nth = (F.row_number().over(Window.partitionBy(*group).orderBy("pattern")) - 1).cast("int")
    return patterns.select(*keys, "text", "count", nth.alias("first_seen"))


def ranked_patterns(patterns: DataFrame, group: Sequence[str], n: int = MAX_PATTERNS) -> DataFrame:
    """The first n patterns(count, first_seen) of each group, the most frequent first, with their place."""
    order = Window.partitionBy(*group).orderBy(F.desc("count"), F.asc("first_seen"))
    return patterns.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def relevant_headings(headings: DataFrame, least_similarity: float = LEAST_SIMILARITY) -> DataFrame:
    """headings(count, embedding, query_embedding) that are near the query or occur twice at least."""
    return headings.filter((cosine(F.col("embedding"), F.col("query_embedding")) >= least_similarity) | (F.col("count") >= 2))
