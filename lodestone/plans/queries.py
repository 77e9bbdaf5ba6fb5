"""The registered queries of the search-corpus operators. Documents are grouped by source and ordered by doc_id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import lists as L
from lodestone.functions import text as X
from lodestone.functions import urls as U
from lodestone.functions import vectors as V
from lodestone.functions import wordpiece as W
from lodestone.operators import corpus, entities, extract, filters, headings, intent, keywords, store
from lodestone.plans import reports, sessions
from lodestone.plans.literals import literal
from lodestone.sources import search
from lodestone.storage import materialise
from lodestone.streaming import pages as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
GROUP = ["source"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.admit(table(spark, sf_dir, "documents").select("source", "doc_id", "text"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.held_tokens(admitted(spark, sf_dir), GROUP)


def six(c: str) -> Column:
    return F.round(c, 6).alias(c)


@query
def tfidf_top(spark, sf_dir):
    return corpus.tfidf_keywords(tokens(spark, sf_dir), GROUP, 20).withColumn("score", F.round("score", 6))


@query
def vocab_df(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return corpus.vocabulary(corpus.tokenize(docs, GROUP), GROUP)


@query
def tokens_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query
def token_literals(spark, sf_dir):
    return literal(spark, "lit_tokens").select("id", F.array_join(X.tokens(F.col("text")), "|").alias("tokens"))


@query
def string_functions(spark, sf_dir):
    s = F.col("s")
    return literal(spark, "lit_strings").select(
        "id", X.trim(s).alias("trimmed"), X.ascii_lower(s).alias("low"), s.startswith("hello").alias("starts"), s.endswith(".txt").alias("ends"), s.contains("o w").alias("holds"),
        X.contains_any_case(s, F.lit("MIXED")).alias("holds_any_case"), X.truncate_domain(s, 8).alias("short"), U.file_stem(s).alias("stem"), F.to_json(F.struct(F.trim("s").alias("s"))).alias("json"),
    )


@query
def english_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.is_english(F.col("text")).alias("english"))


@query
def boilerplate_lines(spark, sf_dir):
    return literal(spark, "lit_lines").select("id", X.is_boilerplate(F.lower("line")).alias("boilerplate"), F.md5(X.clean_text(F.col("line"))).alias("clean_md5"))


@query
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("clean_md5"), X.word_count(X.clean_text(F.col("text"))).alias("n_words"))


@query
def corpus_admission(spark, sf_dir):
    return admitted(spark, sf_dir).select("source", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


@query
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("n_words"))


@query
def ngram_counts(spark, sf_dir):
    buckets = corpus.ngram_buckets(table(spark, sf_dir, "documents"))
    return corpus.repeated_ngrams(corpus.tokenize(admitted(spark, sf_dir), GROUP), GROUP, buckets)


@query
def ngram_top(spark, sf_dir):
    return corpus.top_ngrams(tokens(spark, sf_dir), GROUP)


@query
def keyword_union(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return corpus.keyword_union(corpus.tfidf_keywords(t, GROUP, 100), corpus.top_ngrams(t, GROUP, 50), GROUP, kind="kind").withColumn("score", F.round("score", 6))


@query
def page_keywords(spark, sf_dir):
    return corpus.page_keywords(table(spark, sf_dir, "documents"), ["doc_id"])


def page_figures(spark, sf_dir) -> DataFrame:
    """Documents with a word count and figures that stand for headings and links."""
    n = F.col("n_chars")
    docs = table(spark, sf_dir, "documents")
    return docs.select("source", X.word_count(F.col("text")).alias("word_count"), (n % 7).alias("h2"), (n % 11).alias("h3"), (n % 18).alias("headings"), (n % 5).alias("outbound"), (n % 23).alias("internal"))


@query
def content_stats(spark, sf_dir):
    out = corpus.content_stats(page_figures(spark, sf_dir), GROUP)
    return out.select("source", "n_pages", "median_words", "min_words", "max_words", *[six(c) for c in ("avg_words", "avg_h2", "avg_h3", "avg_headings", "avg_outbound", "avg_internal")])


@query
def recommendations(spark, sf_dir):
    out = corpus.recommendations(corpus.content_stats(page_figures(spark, sf_dir), GROUP))
    return out.select("source", "recommended_words", "recommended_headings", reports.upper_words(F.col("recommended_words")).alias("upper_words"))


@query
def heading_reject(spark, sf_dir):
    return literal(spark, "lit_headings").select("grp", "page", "nth", X.heading_rejected(F.col("text")).alias("rejected"))


@query
def heading_furniture(spark, sf_dir):
    return literal(spark, "lit_furniture").select("id", X.heading_rejected(F.col("text")).alias("rejected"))


@query
def heading_admission(spark, sf_dir):
    lines = F.filter(F.split("text", "\n", -1), lambda x: x != "")
    heads = F.transform(lines, lambda x: F.struct(F.lit("h2").alias("tag"), x.alias("text")))
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", X.word_count(F.col("text")).alias("word_count"), F.lit(False).alias("non_article"), heads.alias("headings"))
    return headings.admit_headings(rows, GROUP, "doc_id")


@query
def heading_patterns_exact(spark, sf_dir):
    return headings.heading_patterns(headings.reject_headings(heading_admission(spark, sf_dir)), GROUP)


@query
def heading_patterns_literal(spark, sf_dir):
    return headings.heading_patterns(headings.reject_headings(literal(spark, "lit_headings")), ["grp"])


@query
def heading_patterns_seq(spark, sf_dir):
    return headings.heading_clusters(headings.reject_headings(literal(spark, "lit_headings")), ["grp"])


@query
def heading_patterns_ranked(spark, sf_dir):
    patterns = headings.heading_clusters(headings.reject_headings(literal(spark, "lit_headings")), ["grp"])
    return headings.ranked_patterns(patterns, ["grp"], 3).select("grp", "place", "tag", "text", "count")


VOCABULARY = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "John", "john", "paul", "visit", "Visit", "##ed", "##s", "-", ",", "."]


@query
def wordpieces(spark, sf_dir):
    return literal(spark, "lit_pieces").select("id", F.array_join(W.tokenize(F.col("text"), VOCABULARY), " ").alias("pieces"))


@query
def wordpiece_ids(spark, sf_dir):
    ids = W.piece_ids(W.tokenize(F.col("text"), VOCABULARY, 6), VOCABULARY)
    return literal(spark, "lit_pieces").select("id", F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("ids"))


def windows(spark) -> DataFrame:
    return intent.text_window(literal(spark, "lit_intents"), "keyword")


@query
def text_windows(spark, sf_dir):
    docs = admitted(spark, sf_dir).withColumn("keyword", F.concat(F.lit("best "), "source"))
    return intent.text_window(docs, "keyword").select("keyword", F.md5("window").alias("window_md5"), F.octet_length("window").cast("long").alias("n_bytes"))


@query
def intent_scores(spark, sf_dir):
    return intent.intent_scores(windows(spark)).select("keyword", *intent.INTENTS, "primary_intent", F.round(F.col("confidence")["commercial"], 6).alias("commercial_share"))


@query
def intent_of_sources(spark, sf_dir):
    docs = admitted(spark, sf_dir).withColumn("keyword", F.concat(F.lit("best "), "source"))
    return intent.intent_scores(intent.text_window(docs, "keyword")).select("keyword", *intent.INTENTS, "primary_intent")


@query
def content_type(spark, sf_dir):
    return intent.content_type(windows(spark))


@query
def entailment_type(spark, sf_dir):
    return intent.primary_entailment(literal(spark, "lit_entailment"))


@query
def tone(spark, sf_dir):
    return intent.tone(windows(spark)).select("keyword", *[F.col(c).cast("long").alias(c) for c in ("formal", "casual", "technical")], "tone")


@query
def google_terms(spark, sf_dir):
    return keywords.google_terms(literal(spark, "lit_questions"), ["grp"])


@query
def google_terms_benchmark(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 5).alias("grp"), F.col("text").alias("phrase"))
    return keywords.google_terms(rows, ["grp"])


def rescored(spark, has_embeddings: bool) -> DataFrame:
    terms = keywords.google_terms(literal(spark, "lit_questions"), ["grp"])
    ranks = search.frequency_table(literal(spark, "lit_freq"))
    return keywords.rescore(literal(spark, "lit_keywords"), ["grp"], terms, ranks, has_embeddings)


SCORED = ["grp", "text", "source", "frequency", "word_rank"]


@query
def rescore_heuristic(spark, sf_dir):
    return rescored(spark, False).select(*SCORED, *[six(c) for c in ("cfr", "sem", "tfidf", "boost", "final")])


@query
def rescore_semantic(spark, sf_dir):
    return rescored(spark, True).select(*SCORED, *[six(c) for c in ("cfr", "sem", "tfidf", "boost", "final")])


@query
def junk_flags(spark, sf_dir):
    return literal(spark, "lit_keywords").select("grp", "text", X.is_junk_keyword(F.col("text"), F.col("similarity")).alias("junk"))


@query
def uniform_filter(spark, sf_dir):
    return keywords.drop_junk(rescored(spark, True), ["grp"]).select("grp", "text", "junk", six("final"))


@query
def keyword_tiers(spark, sf_dir):
    return keywords.keyword_tiers(keywords.drop_junk(rescored(spark, True), ["grp"]), ["grp"], 4, 3).select("grp", "text", "tier", "place", six("final"))


def gaps(spark) -> DataFrame:
    hs = literal(spark, "lit_headings").groupBy("grp", F.lower("text").alias("text")).agg(F.count(F.lit(1)).alias("count"), F.min(F.col("page") * 100 + F.col("nth")).alias("place"))
    stats = spark.createDataFrame([("a", 1500.0, 0), ("b", 20.0, 7)], "grp string, avg_words double, recommended_headings int")
    return keywords.content_gap(literal(spark, "lit_drafts"), literal(spark, "lit_keywords"), hs, stats, ["grp"])


@query
def gap_coverage(spark, sf_dir):
    return gaps(spark).select("grp", "draft_id", "user_words", six("keyword_coverage"), six("heading_coverage"), six("word_ratio"), "words_needed", "headings_needed")


@query
def gap_missing(spark, sf_dir):
    return gaps(spark).select("grp", "draft_id", F.array_join("missing_keywords", "|").alias("missing_keywords"), F.array_join("missing_headings", "|").alias("missing_headings"))


@query
def gap_report(spark, sf_dir):
    return reports.render_all(gaps(spark).withColumnRenamed("grp", "keyword"), "gap")


@query
def cosine_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    first = F.broadcast(rows.filter("vec_id = 0").select(F.col("embedding").alias("probe")))  # one row
    scored = rows.crossJoin(first).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("probe")), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "vec_id").limit(50)


@query
def vector_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query
def softmax3(spark, sf_dir):
    return literal(spark, "lit_logits").select("id", F.round(V.softmax(F.col("logits"), 2), 9).alias("entailment"))


@query
def mean_pool(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", "embedding", (F.col("vec_id") % 2).cast("int").alias("mask"))
    pooled = V.pool_rows(rows, ["label"], "embedding", "mask")
    return pooled.select("label", F.round(V.norm(F.col("pooled")), 6).alias("norm"), F.round(F.element_at("pooled", 1), 6).alias("first"))


@query
def token_pool(spark, sf_dir):
    """Pooling of the tokens of one text, which are a row's matrix."""
    rows = literal(spark, "lit_matrix")
    matrix = F.from_json("matrix", "array<array<double>>")
    mask = F.transform(F.split("mask", " "), lambda m: m.cast("int"))
    return rows.select("id", F.array_join(F.transform(V.mean_pool(matrix, mask), lambda x: F.round(x, 6).cast("string")), " ").alias("pooled"))


@query
def heading_prune(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 3).alias("count"), "embedding")
    probe = F.broadcast(rows.filter("vec_id = 0").select(F.col("embedding").alias("query_embedding")))  # one row
    return headings.relevant_headings(rows.crossJoin(probe)).select("vec_id", "count")


@query
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.domain(F.col("url")).alias("domain"), U.is_valid(F.col("url")).alias("valid"))


@query
def url_strip_tracking(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.strip_tracking(F.col("url")).alias("url"))


@query
def url_resolve(spark, sf_dir):
    return literal(spark, "lit_urls").select("id", U.resolve(F.col("base"), F.col("href")).alias("resolved"), U.domain(F.col("base")).alias("domain"), U.is_valid(F.col("base")).alias("valid"), U.strip_tracking(F.col("href")).alias("stripped"))


@query
def gov_filter(spark, sf_dir):
    return literal(spark, "lit_block").select("id", U.is_gov(F.lower(U.domain(F.col("url")))).alias("gov"), U.is_junk_url(F.col("url")).alias("junk"))


@query
def ad_filter(spark, sf_dir):
    return filters.match_domains(literal(spark, "lit_block"), filters.domain_table(spark, L.AD_DOMAINS), how="left_semi")


@query
def blocked_antijoin(spark, sf_dir):
    return filters.drop_blocked(literal(spark, "lit_block"))


@query
def blocked_pages(spark, sf_dir):
    own = ["site1.example", "example.org"]
    return filters.drop_blocked(table(spark, sf_dir, "pages").select("page_id", "url"), own)


@query
def blocklist_edit(spark, sf_dir):
    listed = filters.add_domains(filters.domain_table(spark, ["WWW.a.com", "b.com"]), ["b.com", "www.C.com"])
    return filters.remove_domains(listed, ["www.a.com", "B.com"])


@query
def junk_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.is_junk_url(F.col("url")).alias("junk"))


@query
def url_dedup_rank(spark, sf_dir):
    ranked = filters.rank_results(literal(spark, "lit_serp"))
    return filters.first_wins(ranked).select("keyword", "url", "rank", U.absolute_position(F.col("page"), F.col("idx") + 1).alias("absolute"))


@query
def batch_dedup_bridge(spark, sf_dir):
    return filters.batch_bridge(filters.rank_results(literal(spark, "lit_serp"))).select("keyword", "page", "idx", "url", "rank", "owner", "fetched")


@query
def run_counters(spark, sf_dir):
    return filters.run_counters(literal(spark, "lit_serp"))


@query
def keyword_success(spark, sf_dir):
    pages = literal(spark, "lit_links").select("url", "word_count").distinct()
    return filters.keyword_success(literal(spark, "lit_serp"), pages)


def linked_pages(spark) -> DataFrame:
    item = F.struct("link_nth", F.col("link").alias("url"), F.concat(F.lit("to "), "link").alias("text"), "is_outbound")
    return literal(spark, "lit_links").groupBy("page_idx", "url", "word_count").agg(F.array_sort(F.collect_list(item)).alias("links"))


@query
def outbound_candidates(spark, sf_dir):
    return filters.outbound_candidates(linked_pages(spark))


@query
def chosen_links(spark, sf_dir):
    links = literal(spark, "lit_links").select(F.col("url").alias("source_url"), F.col("link_nth").alias("ordinal"), F.col("link").alias("url"))
    return filters.chosen_links(literal(spark, "lit_chosen"), links)


@query
def stored_links(spark, sf_dir):
    return filters.stored_links(linked_pages(spark))


def queue(spark, sf_dir) -> DataFrame:
    """Events as rows of the work queue."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://host"), e % 97, F.lit(".com/"), e).alias("url"), F.col("event_type").alias("keyword"), F.concat(F.lit("host"), e % 97, F.lit(".com")).alias("domain"), F.concat(F.lit("title "), e % 13).alias("title"),
        F.lit("s").alias("snippet"), (e % 50).cast("int").alias("serp_position"), (e % 3).cast("int").alias("serp_page"), F.element_at(F.array(*map(F.lit, ("pending", "scraped", "failed", "pending"))), (e % 4 + 1).cast("int")).alias("status"),
        F.col("ts").alias("created_at"), (e % 700).cast("int").alias("word_count"), (e % 5 == 0).cast("int").alias("is_crawled"), F.lit("").alias("source_url"), e.alias("event_id"),
    )


@query
def pending_queue(spark, sf_dir):
    return store.pending(queue(spark, sf_dir), 100).select("url", "keyword", "created_at")


@query
def pending_rich(spark, sf_dir):
    return store.pending_by_keyword(queue(spark, sf_dir), 100)


@query
def pending_count(spark, sf_dir):
    return store.count_pending(queue(spark, sf_dir))


@query
def results_scan(spark, sf_dir):
    return store.results(queue(spark, sf_dir), "click").select("url", "keyword", "is_crawled", "serp_position", "status")


@query
def point_lookup(spark, sf_dir):
    return store.lookup(table(spark, sf_dir, "orders"), o_orderkey=7)


@query
def child_scan(spark, sf_dir):
    return store.children(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_linenumber", l_orderkey=7)


def new_results(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    rows = queue(spark, sf_dir).filter(e % 6 == 0)
    kept = rows.select("url", "keyword", "domain", F.when(e % 12 == 0, F.lit("changed")).otherwise(F.col("title")).alias("title"), "snippet", F.when(e % 18 == 0, 1).otherwise(F.col("serp_position")).alias("serp_position"), "serp_page")
    added = rows.filter(e % 30 == 0).select(F.concat("url", F.lit("/new")).alias("url"), "keyword", "domain", "title", "snippet", "serp_position", "serp_page")
    return kept.unionByName(added)


def stored_results(spark, sf_dir) -> DataFrame:
    return queue(spark, sf_dir).drop("event_id", "word_count", "is_crawled", "source_url")


def now() -> Column:
    return F.to_timestamp(F.lit("2026-01-01 00:00:00"))


@query
def upsert_results(spark, sf_dir):
    return store.upsert_results(stored_results(spark, sf_dir), new_results(spark, sf_dir), now())[0].select("url", "keyword", "title", "serp_position", "status", "created_at")


@query
def results_history(spark, sf_dir):
    return store.upsert_results(stored_results(spark, sf_dir), new_results(spark, sf_dir), now())[1]


@query
def insert_ignore(spark, sf_dir):
    rows = queue(spark, sf_dir).select(F.col("domain").alias("source_url"), F.col("title").alias("obl_url"), "event_id")
    e = F.col("event_id")
    new = rows.withColumn("obl_url", F.when(e % 3 == 0, F.concat("obl_url", F.lit(" "), e % 50)).otherwise(F.col("obl_url")))
    return store.insert_missing(rows, new, ["source_url", "obl_url"], ["event_id"])


@query
def replace_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("keyword"), F.col("c_acctbal").alias("value"), "c_custkey")
    new = rows.filter("c_custkey % 3 = 0").withColumn("value", F.lit(0.0)).withColumn("keyword", F.when(F.col("c_custkey") % 2 == 1, F.concat("keyword", F.lit(" new"))).otherwise(F.col("keyword")))
    return store.replace_rows(rows, new, ["keyword"])


@query
def update_scraped(spark, sf_dir):
    rows = queue(spark, sf_dir).drop("event_id")
    e = F.regexp_extract("url", "/([0-9]+)$", 1).cast("long")
    new = rows.filter(e % 7 == 0).select("url", "keyword", F.lit("scraped").alias("status"), F.lit(999).alias("word_count"), (e % 14 == 0).cast("int").alias("is_crawled"), F.when(e % 21 == 0, "https://parent").otherwise("").alias("source_url"))
    return store.update_scraped(rows, new).select("url", "keyword", "status", "word_count", "is_crawled", "source_url")


@query
def delete_pending(spark, sf_dir):
    rows = queue(spark, sf_dir)
    return store.delete_rows(rows, rows.filter("event_id % 5 = 0"), ["url", "keyword"], "pending").select("url", "keyword", "status")


@query
def cascade_delete(spark, sf_dir):
    rows = queue(spark, sf_dir)
    gone = rows.filter("event_id % 9 = 0").select("url", "keyword")
    links = rows.select(F.col("url").alias("source_url"), "keyword", "title")
    out = store.cascade_delete({"results": rows.select("url", "keyword"), "links": links}, gone)
    counts = [t.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit(name)) for name, t in out.items()]
    return counts[0].unionByName(counts[1])


@query
def purge(spark, sf_dir):
    tables = {"events": table(spark, sf_dir, "events").select("event_id"), "orders": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"))}
    gone = store.purge(tables)
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in gone.items()]
    return counts[0].unionByName(counts[1])


@query
def migrate_settings(spark, sf_dir):
    rows = literal(spark, "lit_settings")
    new, old = store.migrate_settings(rows.filter("side = 'old'").drop("side"), rows.filter("side = 'new'").drop("side"))
    return new.withColumn("side", F.lit("new")).unionByName(old.withColumn("side", F.lit("old")))


@query
def log_tail(spark, sf_dir):
    return store.log_tail(literal(spark, "lit_log"), 1)


@query
def replace_children(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("ordinal"), F.col("l_returnflag").alias("tag"))
    key = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey")).otherwise(-1 - F.col("o_orderkey"))
    parents = table(spark, sf_dir, "orders").select(key.alias("key"), F.array(F.struct(F.lit("x").alias("tag")), F.struct(F.col("o_orderstatus").alias("tag"))).alias("items"))
    return store.replace_children(lines, parents, "items", ["key"], ["tag"]).select("key", F.col("ordinal").cast("int").alias("ordinal"), "tag")


@query
def position_lag(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("keyword"), F.concat(F.lit("u"), F.col("user_id")).alias("domain"), (F.col("event_id") % 100).alias("position"), F.struct("ts", "event_id").alias("checked_at"))
    return store.position_changes(rows).select("keyword", "domain", F.col("checked_at.event_id").alias("event_id"), "position", "previous", "change")


@query
def parent_child(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("url"), F.concat(F.lit("r"), "n_regionkey").alias("source_url"), F.lit(1).alias("is_crawled"), (F.col("n_nationkey") + 100).alias("place"))
    r = table(spark, sf_dir, "region").select(F.concat(F.when(F.col("r_regionkey") < 4, "r").otherwise("x"), "r_regionkey").alias("url"), F.lit("").alias("source_url"), F.lit(0).alias("is_crawled"), F.col("r_regionkey").alias("place"))
    return store.arrange_results(r.unionByName(n)).select("url", F.col("parent_place").cast("int").alias("parent_place"), "is_child", "is_orphan", F.col("place").cast("int").alias("place"))


@query
def page_detail(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url"), F.col("o_orderstatus").alias("keyword"))
    key = ["url", "keyword"]
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("url"), F.col("l_linenumber").alias("ordinal"), "l_returnflag", "l_linestatus", "l_partkey").join(orders, "url")
    hs = lines.select(*key, "ordinal", F.col("l_returnflag").alias("tag"), F.col("l_linestatus").alias("text"))
    ls = lines.select(F.col("url").alias("source_url"), "keyword", "ordinal", F.col("l_partkey").alias("obl_url"))
    ks = lines.select(*key, "ordinal", F.col("l_returnflag").alias("page_keyword"))
    out = store.page_detail(orders, hs, ls, ks)
    return out.select(*key, F.array_join(F.transform("headings", lambda h: h["tag"]), "").alias("tags"), F.array_join(F.transform("links", lambda x: x["obl_url"].cast("string")), ",").alias("links"), F.coalesce(F.size("page_keywords"), F.lit(0)).cast("long").alias("n_keywords"))


def restored(spark) -> dict[str, DataFrame]:
    return search.session_tables(search.restore_sessions(literal(spark, "lit_sessions")))


@query
def session_keywords(spark, sf_dir):
    return restored(spark)["keywords"].select("keyword", "nth", "text", "frequency", "source")


@query
def session_questions(spark, sf_dir):
    return restored(spark)["questions"].select("keyword", "nth", "question", "link")


@query
def session_pages(spark, sf_dir):
    return restored(spark)["pages"].select("keyword", "nth", "url")


def serp_rows(spark) -> DataFrame:
    return search.parse_responses(literal(spark, "lit_serp_json"))


@query
def stored_phrases(spark, sf_dir):
    rows = serp_rows(spark)
    asked = search.questions(rows).withColumnRenamed("ordinal", "nth")
    related = search.related_searches(rows).withColumnRenamed("ordinal", "nth")
    out = search.with_phrases(rows.select("keyword").distinct(), asked, related)
    return out.select("keyword", F.to_json("questions").alias("questions"), F.to_json("related").alias("related"))


def literal_records(spark) -> DataFrame:
    return extract.extract_pages(literal(spark, "lit_html").withColumn("page_id", F.col("page_id").cast("long")), literal(spark, "lit_html_rendered").withColumn("page_id", F.col("page_id").cast("long")))


@query
def page_records(spark, sf_dir):
    """Rejection, parsing, the choice of rendering and the merge in one."""
    link = F.transform("links", lambda x: F.concat(x["url"], F.lit("|"), x["text"], F.lit("|"), x["is_outbound"].cast("string")))
    head = F.transform("headings", lambda h: F.concat(h["tag"], F.lit("|"), h["text"]))
    columns = ["page_id", "page_text", "title", "meta_description", "word_count", "p_tags", "non_article", "used_rendering", "error"]
    return literal_records(spark).select(*columns, F.array_join(head, " ").alias("headings"), F.array_join(link, " ").alias("links"))


@query
def session_json(spark, sf_dir):
    rows = serp_rows(spark).filter("keyword = 'k1'")
    words = F.array(F.lit("one"))
    pages = literal_records(spark).filter("page_id IN (1, 3)").select(
        "*", F.lit("k1").alias("keyword"), F.col("page_id").alias("place"), F.lit(0.5).alias("scrape_time"), F.lit(0).alias("is_crawled"), F.lit(-1).alias("source_idx"), F.col("page_id").alias("serp_position"),
        F.when(F.col("page_id") == 1, words).otherwise(F.array().cast("array<string>")).alias("page_keywords"),
    )
    graphs = rows.filter("response.knowledgeGraph IS NOT NULL").select("keyword", "page", "response.knowledgeGraph.*")
    exports = spark.createDataFrame([("k1", '{"keyword":"k1","keyword_count":0}'), ("k9", '{"keyword":"k9"}')], "keyword string, report string")
    return sessions.assemble(exports, pages, search.organic_results(search.take_pages(rows)), graphs)


@query
def session_round_trip(spark, sf_dir):
    """A session that has been put together can be restored, with its pages."""
    tables = search.session_tables(search.restore_sessions(session_json(spark, sf_dir)))
    return tables["pages"].select("keyword", "nth", "url", "title", "words", "serp_position")


@query
def session_summary(spark, sf_dir):
    out = search.session_summary(search.restore_sessions(literal(spark, "lit_sessions")))
    return out.select(*[F.col(c).cast("long").alias(c) if c.startswith("n_") else c for c in out.columns])


@query
def sessions_by_date(spark, sf_dir):
    return store.sessions_by_date(literal(spark, "lit_sessions"))


@query
def bio_decode(spark, sf_dir):
    return entities.decode_labels(literal(spark, "lit_bio"))


@query
def entity_admission(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", X.word_count(F.col("text")).alias("word_count"))
    return entities.admit_for_entities(docs, "text").select("doc_id", "word_count")


@query
def entity_merge(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.posexplode(F.split("p_name", " ")).alias("pos", "text"), (F.col("p_size") % 4).cast("string").alias("label"), F.col("p_brand"))
    return entities.merge_entities(words, ["p_brand"], ["doc", "pos"])


def parsed(spark, sf_dir) -> DataFrame:
    return extract.with_flags(extract.parse_pages(table(spark, sf_dir, "pages")))


@query
def page_title(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", "title", "meta_description", "error")


@query
def page_headings(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", F.explode("headings").alias("h")).select("page_id", "h.tag", "h.text")


@query
def page_links(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", F.size("links").cast("long").alias("n_links"), F.col("outbound").cast("long").alias("outbound"))


@query
def page_text(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", "page_text", "word_count", "p_tags", "non_article")


@query
def page_link_targets(spark, sf_dir):
    return parsed(spark, sf_dir).select("page_id", F.posexplode("links").alias("nth", "link")).select("page_id", "nth", "link.url", "link.text")


@query
def render_choice(spark, sf_dir):
    rows = literal(spark, "lit_pages")
    words, tags = F.col("word_count"), F.col("p_tags")
    return rows.select("page_id", extract.needs_rendering(words, extract.body_marks(F.col("html"))).alias("needs"), ((words > 200) & (tags < 3)).alias("non_article"), extract.is_binary(F.col("html")).alias("is_binary"))


@query
def render_merge(spark, sf_dir):
    empty = F.array().cast("array<string>")
    pages = literal(spark, "lit_pages").select("page_id", "word_count", "p_tags", F.lit(False).alias("non_article"), F.col("html").alias("page_text"), empty.alias("headings"), empty.alias("links"))
    new = literal(spark, "lit_rendered").select("page_id", "word_count", F.lit(9).alias("p_tags"), F.lit(True).alias("non_article"), "page_text", empty.alias("headings"), empty.alias("links"))
    return extract.merge_rendered(pages, new).select("page_id", "word_count", "p_tags", F.md5("page_text").alias("text_md5"), "used_rendering")


@query
def organic_results(spark, sf_dir):
    return search.organic_results(search.take_pages(search.parse_responses(literal(spark, "lit_serp_json"))))


@query
def questions_related(spark, sf_dir):
    rows = search.parse_responses(literal(spark, "lit_serp_json"))
    asked = search.questions(rows).select("keyword", "ordinal", F.col("question").alias("phrase"))
    return asked.unionByName(search.related_searches(rows).select("keyword", "ordinal", F.col("query").alias("phrase")))


@query
def knowledge_graph(spark, sf_dir):
    return search.knowledge_graph(search.parse_responses(literal(spark, "lit_serp_json")))


@query
def frequency_table(spark, sf_dir):
    return search.frequency_table(literal(spark, "lit_freq"))


@query
def keyword_batch(spark, sf_dir):
    return search.keyword_batch(literal(spark, "lit_input"))


@query
def proxy_lines(spark, sf_dir):
    return search.parse_proxies(literal(spark, "lit_proxies"))


@query
def outline_select(spark, sf_dir):
    hs = literal(spark, "lit_headings").groupBy(F.col("grp").alias("keyword"), "tag", F.lower("text").alias("text")).agg(F.count(F.lit(1)).alias("count"))
    return reports.select_outline(hs)


ANALYSIS = (
    "primary_intent string, content_type string, tone string, recommended_words int, recommended_headings int, avg_words double, median_words int, min_words int, max_words int, avg_h2 double, avg_h3 double, "
    "avg_headings double, avg_outbound double, avg_internal double, confidence map<string,double>, scores map<string,double>, signals map<string,array<string>>, "
    "keywords array<struct<text:string,score:double,frequency:int,source:string,cfr:double,sem:double,tfidf:double,boost:double>>, entities array<struct<text:string,label:string,frequency:int,sources:int>>, "
    "headings array<struct<tag:string,text:string,count:int>>, questions array<struct<question:string>>, related array<string>"
)


def literal_analyses(spark) -> DataFrame:
    return literal(spark, "lit_analysis").select("keyword", F.from_json("body", ANALYSIS).alias("a")).select("keyword", "a.*")


@query
def outline_passes(spark, sf_dir):
    """Shared headings, single ones on the subject, and the usual parts."""
    return reports.outlines(literal_analyses(spark))


@query
def export_round_trip(spark, sf_dir):
    """What an export keeps of the keywords, entities, headings, questions and related searches once it is restored."""
    exports = reports.render_all(literal_analyses(spark), "json").withColumnRenamed("report", "json_data")
    tables = search.session_tables(search.restore_sessions(exports))
    texts = {"keywords": ["text", "score", "frequency", "source", "cfr"], "entities": ["text", "label", "frequency", "sources"], "headings": ["tag", "text", "count"], "questions": ["question", "snippet", "link"], "related": ["query"]}
    parts = [tables[name].select("keyword", F.lit(name).alias("part"), "nth", F.concat_ws("|", *fields).alias("fields")) for name, fields in texts.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def prompt_readers(spark, sf_dir):
    return literal(spark, "lit_intent_types").select("id", reports.audience(F.col("intent"), F.col("kind")).alias("reader"))


def literal_report(kind: str) -> Query:
    return lambda spark, sf_dir: reports.render_all(literal_analyses(spark), kind)


for _kind in ("full", "keywords", "outline", "competitive", "info", "markdown", "text", "json"):
    QUERIES[f"literal_{_kind}"] = literal_report(_kind)


@query
def export_text_lines(spark, sf_dir):
    return reports.text_lines(literal(spark, "lit_keywords"), "grp")


@query
def copied_lines(spark, sf_dir):
    return reports.copied_lines(literal(spark, "lit_copy"))


def analysis_rows(spark, sf_dir, whole: bool = False) -> DataFrame:
    """Analyses of the pages, whose hosts stand for keywords."""
    from lodestone.plans.analysis import Options, analyze

    pages = materialise(parsed(spark, sf_dir).withColumn("keyword", F.concat(F.lit("guide to "), F.col("domain"))), "pages")  # read several times
    asked = pages.select("keyword", F.concat(F.lit("What is "), "title", F.lit("?")).alias("phrase")).distinct()
    return analyze(pages, asked, Options(whole=whole))


@query
def page_analysis(spark, sf_dir):
    return analysis_rows(spark, sf_dir).select("keyword", "n_pages", "avg_words", "primary_intent", "content_type", "tone", F.size("keywords").alias("n_keywords"), F.size("headings").alias("n_headings"))


@query
def prompt_full(spark, sf_dir):
    return reports.render_all(analysis_rows(spark, sf_dir, whole=True), "full")


@query
def export_bundle(spark, sf_dir):
    return reports.render_all(analysis_rows(spark, sf_dir), "bundle")


@query
def export_markdown(spark, sf_dir):
    return reports.render_all(analysis_rows(spark, sf_dir, whole=True), "markdown")


@query
def export_text(spark, sf_dir):
    return reports.render_all(analysis_rows(spark, sf_dir), "text")


@query
def event_windows(spark, sf_dir):
    return stream.event_windows(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query
def ready_keywords(spark, sf_dir):
    rows = queue(spark, sf_dir).filter(~((F.col("keyword") == "click") & (F.col("status") == "pending")))
    return stream.ready_keywords(rows, rows)


@query
def quality_by_source(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.select("doc_id", "source").join(labels, "doc_id")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("n_good"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))


@query
def latest_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return orders.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("ordered"))


from lodestone.plans import table_queries  # noqa: E402, F401 - registers its queries
