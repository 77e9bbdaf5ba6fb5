"""Address filters, result ranks, first-wins deduplication and outbound candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import lists as L
from lodestone.functions import urls as U


def domain_table(spark, domains: Sequence[str]) -> DataFrame:
    """listed: a caller's list of domains, lower-cased, without www."""
    names = sorted({d.lower().removeprefix("www.") for d in domains})
    return spark.createDataFrame([(n,) for n in names], "listed string")


def match_domains(rows: DataFrame, listed: DataFrame, url: str = "url", how: str = "left_anti") -> DataFrame:
    """Rows whose domain is (left_semi) or isn't (left_anti) in listed, itself or behind a dot.

    The domain's suffixes are exploded, so the test is an equi-join: of the distinct domains with the list, then of
    the rows with the hits.
    """
    host = F.lower(U.domain(F.col(url)))
    hosts = rows.select(host.alias("host")).distinct()
    hits = hosts.select("host", F.explode(U.suffixes(F.col("host"))).alias("listed")).join(listed, "listed", "left_semi").select("host").distinct()
    return rows.withColumn("host", host).join(hits, "host", how).drop("host")


def drop_blocked(rows: DataFrame, blocklist: Sequence[str] = L.BLOCKLIST, url: str = "url") -> DataFrame:
    """Rows that are neither governmental nor of an advertising or blocked domain."""
    listed = domain_table(rows.sparkSession, [*L.AD_DOMAINS, *blocklist])
    return match_domains(rows.filter(~U.is_gov(F.lower(U.domain(F.col(url))))), listed, url)


def add_domains(listed: DataFrame, domains: Sequence[str]) -> DataFrame:
    return listed.unionByName(domain_table(listed.sparkSession, domains)).distinct()


def remove_domains(listed: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Names are lower-cased only, so `www.` names are not found."""
    return listed.filter(~F.col("listed").isin(*[d.lower() for d in domains])) if domains else listed


def rank_results(results: DataFrame, blocklist: Sequence[str] = L.BLOCKLIST) -> DataFrame:
    """results(keyword, page, idx, url) that aren't blocked, with rank by page and place. Ranks come before deduplication."""
    order = Window.partitionBy("keyword").orderBy("page", "idx")
    return drop_blocked(results, blocklist).withColumn("rank", F.row_number().over(order))


def first_wins(ranked: DataFrame) -> DataFrame:
    """One row for each address of a keyword, that of the lowest rank; so ranks have gaps."""
    order = Window.partitionBy("keyword", "url").orderBy("rank")
    return ranked.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def batch_bridge(ranked: DataFrame) -> DataFrame:
    """ranked(keyword_idx, keyword, page, idx, url, rank) with owner, the first keyword that has the address, and fetched.

    An address is fetched once for the whole batch; every keyword keeps its link to it, repeats included.
    """
    order = Window.partitionBy("url").orderBy("keyword_idx", "page", "idx")
    bridge = ranked.withColumn("fetched", F.row_number().over(order) == 1)
    return bridge.withColumn("owner", F.first("keyword").over(order))


def outbound_candidates(pages: DataFrame, most: int = 30, least_words: int = 50, blocklist: Sequence[str] = L.BLOCKLIST) -> DataFrame:
    """place, url, source_url of links worth crawling from pages(page_idx, url, word_count, links(url, is_outbound)).

    Outbound, valid, not blocked, no junk, no page already; the first page and link with an address wins.
    """
    links = pages.filter(F.col("word_count") > least_words).select("page_idx", F.col("url").alias("source_url"), F.posexplode("links").alias("nth", "link"))
    links = links.select("page_idx", "source_url", "nth", F.col("link.url").alias("url"), F.col("link.is_outbound").alias("is_outbound"))
    good = links.filter(F.col("is_outbound") & U.is_valid(F.col("url")) & ~U.is_junk_url(F.col("url")))
    new = drop_blocked(good, blocklist).join(pages.select("url").distinct(), "url", "left_anti")
    first = new.groupBy("url").agg(F.min(F.struct("page_idx", "nth", "source_url")).alias("first"))
    rows = first.select("url", "first.*").orderBy("page_idx", "nth").limit(most)
    return rows.withColumn("place", F.row_number().over(Window.orderBy("page_idx", "nth"))).select("place", "url", "source_url")


def stored_links(pages: DataFrame, blocklist: Sequence[str] = L.BLOCKLIST) -> DataFrame:
    """source_url, url, anchor_text of outbound links that are kept with their page."""
    links = pages.select(F.col("url").alias("source_url"), F.explode("links").alias("link")).select("source_url", "link.*")
    return drop_blocked(links.filter(F.col("is_outbound") & U.is_valid(F.col("url"))), blocklist).select("source_url", "url", F.col("text").alias("anchor_text"))


def keyword_success(bridge: DataFrame, pages: DataFrame, least_words: int = 50) -> DataFrame:
    """keyword, n_pages, n_good, retry: whether no page of the keyword has enough words."""
    joined = bridge.select("keyword", "url").distinct().join(pages.select("url", "word_count"), "url", "left")
    good = F.count_if(F.coalesce(F.col("word_count"), F.lit(0)) > least_words)
    return joined.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_pages"), good.alias("n_good")).withColumn("retry", F.col("n_good") == 0)


def run_counters(results: DataFrame, blocklist: Sequence[str] = L.BLOCKLIST) -> DataFrame:
    """keyword, n_results, n_blocked, n_duplicates."""
    kept = rank_results(results, blocklist).groupBy("keyword").agg(F.count(F.lit(1)).alias("n_kept"), F.countDistinct("url").alias("n_urls"))
    whole = results.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_results")).join(kept, "keyword", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    return whole.select("keyword", "n_results", (F.col("n_results") - count("n_kept")).alias("n_blocked"), (count("n_kept") - count("n_urls")).alias("n_duplicates"))


def chosen_links(chosen: DataFrame, links: DataFrame, per_page: int = 100, each: int = 30, most: int = 200) -> DataFrame:
    """place, url, keyword, source_url of the stored links of chosen(place, url, keyword) pages to crawl by hand.

    links has source_url, ordinal, url. Pages are taken in order, per_page links of each; the first place of an address
    counts; as many as each times the pages, most at most.
    """
    near = links.withColumn("nth", F.row_number().over(Window.partitionBy("source_url").orderBy("ordinal", "url"))).filter(F.col("nth") <= per_page)
    pages = chosen.select("place", F.col("url").alias("source_url"), "keyword")
    first = near.join(pages, "source_url").groupBy("url").agg(F.min(F.struct("place", "nth", "keyword", "source_url")).alias("first"))
    cap = min(each * chosen.count(), most)
    rows = first.select("url", "first.*").orderBy("place", "nth").limit(cap)  # a bounded list
    return rows.select(F.row_number().over(Window.orderBy("place", "nth")).alias("place"), "url", "keyword", "source_url")
