"""Which phrases of a group stand in its texts: an Aho-Corasick automaton for each group instead of a test of every pair.

Phrases and texts meet in tasks by group. A task reads a group's phrases first, builds their automaton once, and then streams
the group's texts past it. Groups with many texts are dealt over salts, each with a copy of the phrases; groups with many
phrases over shards of at most SHARD, each with a copy of the texts. A null group is a group of its own; null texts and
phrases match nothing, an empty phrase stands in every text but null. Rows that share a text_id count as parts of one text. Case
is the caller's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import chain, groupby
from operator import and_

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Phrases of one automaton at most.
SHARD = 20_000
#: A group with this share of all texts is dealt over salts, one for each such share; there are no more such groups than its inverse.
HOT_SHARE = 1e-3
#: Fewer texts than this need no salts.
FEW = 2_000
#: Texts that a task takes at once.
BATCH = 256


class Matcher:
    """The phrases of a shard, (place, label, text) each, and their automaton."""

    def __init__(self, phrases: Sequence[tuple]):
        self.phrases = phrases
        self.always = [i for i, (*_, text) in enumerate(phrases) if text == ""]
        places: dict[str, list[int]] = {}
        for i, (*_, text) in enumerate(phrases):
            if text:
                places.setdefault(text, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for text, at in places.items():
            self.automaton.add_word(text, at)
        if places:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> set[int]:
        """Places of the phrases that stand in text."""
        if text is None:
            return set()
        found = set(self.always)
        if len(self.automaton):
            for _, at in self.automaton.iter(text):
                found.update(at)
        return found


def dealt(texts: DataFrame, phrases: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, __key (group, shard, salt), __kind (0 phrase, 1 text), __id, __place, __label, __text of all rows, a copy for each shard and salt."""
    counts = texts.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    share = counts.agg((F.sum("n") * HOT_SHARE).alias("share"))
    # one row of totals; hot groups are 1 / HOT_SHARE at most
    hot = counts.filter(F.col("n") >= FEW).crossJoin(F.broadcast(share)).filter(F.col("n") >= F.col("share"))
    hot = F.broadcast(hot.select(*group, F.ceil(F.col("n") / F.greatest("share", F.lit(FEW / 2))).cast("int").alias("salts")))
    pieces = phrases.groupBy(*group).agg(F.count(F.lit(1)).alias("n_phrases"))
    split = pieces.filter(F.col("n_phrases") > SHARD).select(*group, F.ceil(F.col("n_phrases") / SHARD).cast("int").alias("shards"))

    def joined(rows: DataFrame, other: DataFrame) -> DataFrame:
        renamed = other.withColumnsRenamed({g: f"__of_{g}" for g in group})
        same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"__of_{g}")) for g in group])
        return rows.join(renamed, same, "left").drop(*[f"__of_{g}" for g in group])

    def with_counts(rows: DataFrame) -> DataFrame:
        return joined(joined(rows, hot), split).withColumns({"salts": F.coalesce("salts", F.lit(1)), "shards": F.coalesce("shards", F.lit(1))})

    mark = F.xxhash64("__id", "__text")
    t = with_counts(texts.select(*group, F.lit(1).alias("__kind"), F.col("text_id").alias("__id"), F.lit(None).cast("long").alias("__place"), F.lit(None).cast("string").alias("__label"), F.col("text").cast("string").alias("__text")))
    t = t.withColumn("salt", F.pmod(mark, F.col("salts")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    label = F.col("label" if "label" in phrases.columns else "phrase").cast("string")
    p = with_counts(phrases.select(*group, F.lit(0).alias("__kind"), F.lit(None).cast(texts.schema["text_id"].dataType).alias("__id"), F.col("place").cast("long").alias("__place"), label.alias("__label"), F.col("phrase").cast("string").alias("__text")))
    p = p.withColumn("shard", F.pmod(F.xxhash64("__place", "__text"), F.col("shards")).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    key = F.struct(*group, "shard", "salt").alias("__key")
    columns = [*group, key, "__kind", "__id", "__place", "__label", "__text"]
    return t.select(*columns).unionByName(p.select(*columns))


def scan(texts: DataFrame, phrases: DataFrame, group: Sequence[str], result: Callable[[Matcher, str | None], list[dict]], fields: str) -> DataFrame:
    """group, text_id and the fields of result(matcher, text) for each text and shard of phrases. Groups without phrases have one empty shard."""
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in group), f"text_id {kinds['text_id']}", fields])
    rows = dealt(texts, phrases, group)
    rows = rows.repartition("__key").sortWithinPartitions("__key", "__kind", "__place", "__label")
    arrow_schema = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = chain.from_iterable(b.slice(a, BATCH).to_pylist() for b in batches for a in range(0, b.num_rows, BATCH))
        for _, of_key in groupby(stream, key=lambda r: r["__key"]):
            held, matcher, made = [], None, []
            for r in of_key:
                if r["__kind"] == 0:
                    if r["__text"] is not None:
                        held.append((r["__place"], r["__label"], r["__text"]))
                    continue
                matcher = matcher or Matcher(held)
                own = {**{g: r[g] for g in group}, "text_id": r["__id"]}
                made += [{**own, **x} for x in result(matcher, r["__text"])]
                if len(made) >= BATCH:
                    yield pa.RecordBatch.from_pylist(made, schema=arrow_schema)
                    made = []
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=arrow_schema)

    return rows.mapInArrow(run, schema)


def phrase_hits(texts: DataFrame, phrases: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, text_id, place, label of every phrase(group, place, phrase, and a label if it has another name) that stands in a text(group, text_id, text)."""

    def result(matcher: Matcher, text: str | None) -> list[dict]:
        return [dict(zip(("place", "label"), matcher.phrases[i])) for i in sorted(matcher.hits(text))]

    return scan(texts, phrases, group, result, "place long, label string")


def phrase_coverage(texts: DataFrame, phrases: DataFrame, group: Sequence[str], most: int = 100) -> DataFrame:
    """group, text_id, found, total, missing (labels of the first `most` phrases by place that don't stand in it) of every text."""

    def result(matcher: Matcher, text: str | None) -> list[dict]:
        hits = matcher.hits(text)
        missing = [dict(zip(("place", "label"), p)) for i, p in enumerate(matcher.phrases) if i not in hits]
        return [{"found": len(hits), "total": len(matcher.phrases), "missing": missing[:most]}]

    parts = scan(texts, phrases, group, result, "found long, total long, missing array<struct<place:bigint,label:string>>")
    whole = parts.groupBy(*group, "text_id").agg(F.sum("found").alias("found"), F.sum("total").alias("total"), F.flatten(F.collect_list("missing")).alias("m"))
    return whole.select(*group, "text_id", "found", "total", F.transform(F.slice(F.array_sort("m"), 1, most), lambda x: x["label"]).alias("missing"))
