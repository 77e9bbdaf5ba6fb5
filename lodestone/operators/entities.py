"""Entities: decoding of token labels and merging of mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.corpus import top_rows


def decode_labels(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, start, text, label from tokens(doc, pos, piece, label with B-, I- or O).

    A B label starts an entity, unless the piece continues a word of the open one's type; an I label goes on with whatever
    is open; O ends it. Entities under three characters, with a leading # or short and lower-case ones don't count.
    """
    window = Window.partitionBy(doc).orderBy("pos")
    kind = F.regexp_extract("label", "^[BI]-(.*)$", 1)
    rows = tokens.withColumn("mark", F.substring("label", 1, 1)).withColumn("kind", kind)
    rows = rows.withColumn("glued", F.col("piece").startswith("##"))
    before = F.lag("label").over(window)
    continues = F.col("glued") & (F.regexp_extract(before, "^[BI]-(.*)$", 1) == F.col("kind")) & (before != "O")
    rows = rows.withColumn("starts", ((F.col("mark") == "B") & ~F.coalesce(continues, F.lit(False))).cast("int"))
    rows = rows.withColumn("ends", (F.col("mark") == "O").cast("int"))
    rows = rows.withColumn("nth", F.sum(F.col("starts") + F.col("ends")).over(window)).filter("mark <> 'O'")
    spans = rows.groupBy(doc, "nth").agg(F.array_sort(F.collect_list(F.struct("pos", "piece", "starts", "kind"))).alias("p"))
    opened = spans.filter(F.element_at("p", 1)["starts"] == 1)
    pieces = F.transform("p", lambda x: F.when(x["piece"].startswith("##"), F.substring(x["piece"], 3, 1000)).otherwise(F.concat(F.lit(" "), x["piece"])))
    text = F.ltrim(F.array_join(pieces, ""))
    out = opened.select(doc, F.element_at("p", 1)["pos"].alias("start"), text.alias("text"), F.element_at("p", 1)["kind"].alias("label"))
    short = F.col("text").rlike("^[a-z]") & (F.length("text") <= 3)
    return out.filter((F.length("text") >= 3) & ~F.col("text").startswith("#") & ~short)


def merge_entities(mentions: DataFrame, group: Sequence[str], order: Sequence[str], n: int = 200) -> DataFrame:
    """group, text, label, frequency, sources, documents, rank: of the first n entities seen, the most frequent first.

    sources equals frequency, as mentions count; documents are distinct ones.
    """
    first = F.min(F.struct(*order)).alias("first_seen")
    merged = mentions.groupBy(*group, "text", "label").agg(F.count(F.lit(1)).alias("frequency"), F.countDistinct(order[0]).alias("documents"), first)
    early = top_rows(merged, group, [F.asc("first_seen")], n, "seen").withColumn("sources", F.col("frequency"))
    return top_rows(early, group, [F.desc("frequency"), F.asc("first_seen")], n).select(*group, "text", "label", "frequency", "sources", "documents", "rank")


def admit_for_entities(pages: DataFrame, text: str = "page_text", least_words: int = 50) -> DataFrame:
    """Pages whose text goes to the tagger: there is some, of more than least_words words."""
    return pages.filter((F.coalesce(F.col(text), F.lit("")) != "") & (F.col("word_count") > least_words))
