"""Stored sessions: the JSON export with pages, results and knowledge graph, in one string for each keyword."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_HEADINGS = 50


def filled(text: Column) -> Column:
    """Null where nothing is there, so that JSON leaves it out."""
    return F.when(F.coalesce(text, F.lit("")) != "", text)


def page_json(pages: DataFrame) -> DataFrame:
    """keyword, pages: JSON lists of pages(keyword, place, page record, page_keywords), in order of place."""
    heads = F.transform(F.slice("headings", 1, MOST_HEADINGS), lambda h: F.struct(h["tag"].alias("tag"), h["text"].alias("text")))
    fields = [
        "domain", "url", "title", F.col("meta_description").alias("meta_desc"), F.col("word_count").alias("words"), F.size("headings").alias("headings"), "outbound", "internal",
        F.col("scrape_time").alias("scrape_time"), "is_crawled", "source_idx", F.col("used_rendering").cast("int").alias("js_fallback"), "serp_position", filled(F.col("keyword")).alias("keyword"),
        F.when(F.size("headings") > 0, heads).alias("page_headings"), F.when(F.size("page_keywords") > 0, F.col("page_keywords")).alias("page_keywords"),
    ]
    rows = pages.select(F.col("keyword").alias("k"), "place", F.to_json(F.struct(*fields)).alias("json"))
    return rows.groupBy(F.col("k").alias("keyword")).agg(listed("place").alias("pages"))


def listed(place: str) -> Column:
    parts = F.transform(F.array_sort(F.collect_list(F.struct(place, "json"))), lambda p: p["json"])
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def result_json(results: DataFrame) -> DataFrame:
    """keyword, serp_results: JSON lists of organic results, in order of page and place."""
    fields = ["position", "title", "link", "snippet", "domain", filled(F.col("date")).alias("date")]
    rows = results.select("keyword", F.struct("page", "idx").alias("place"), F.to_json(F.struct(*fields)).alias("json"))
    return rows.groupBy("keyword").agg(listed("place").alias("serp_results"))


def graph_json(graphs: DataFrame) -> DataFrame:
    """keyword, knowledge_graph: JSON of the first graph(keyword, page, title, type, description) that has a title."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = graphs.filter(F.coalesce(F.col("title"), F.lit("")) != "").select("keyword", "page", F.to_json(F.struct(text("title"), text("type"), text("description"))).alias("json"))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("keyword").orderBy("page"))).filter("nth = 1")
    return first.select("keyword", F.col("json").alias("knowledge_graph"))


def assemble(exports: DataFrame, pages: DataFrame, results: DataFrame | None = None, graphs: DataFrame | None = None) -> DataFrame:
    """keyword, json_data of exports(keyword, report: a JSON object) with the other parts behind its own fields.

    A keyword without pages has an empty list; without results it has none and no graph.
    """
    out = exports.join(page_json(pages), "keyword", "left")
    parts = [F.substr("report", F.lit(1), F.length("report") - 1), F.lit(',"pages":'), F.coalesce("pages", F.lit("[]"))]
    for table, make, name in ((results, result_json, "serp_results"), (graphs, graph_json, "knowledge_graph")):
        if table is not None:
            out = out.join(make(table), "keyword", "left")
            parts.append(F.coalesce(F.concat(F.lit(f',"{name}":'), F.col(name)), F.lit("")))
    return out.select("keyword", F.concat(*parts, F.lit("}")).alias("json_data"))
