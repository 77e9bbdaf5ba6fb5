"""Registered queries that feed search results, links, keywords, sessions and files from the given tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import byte_bpe as bytewise
from lodestone.functions import text as X
from lodestone.functions import urls as U
from lodestone.functions import vectors as V
from lodestone.operators import corpus, entities, extract, filters, headings, intent, keywords, stored
from lodestone.plans import reports, runs
from lodestone.plans.queries import GROUP, analysis_rows, new_results, now, query, queue, six, table, tokens
from lodestone.sources import captured, named_files, search
from lodestone.storage import materialise, scratch_path


def byte_vocabulary() -> str:
    """Place of a public vocabulary with its merges."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def byte_encoder() -> bytewise.ByteBpe:
    return bytewise.ByteBpe(bytewise.load_vocab(byte_vocabulary()), bytewise.load_merges(byte_vocabulary()))


@query
def byte_bpe(spark, sf_dir):
    ids = bytewise.encode(F.col("text"), byte_encoder())
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_md5"))


#: Hosts of made-up results: three blocked ones, an official one, others.
HOSTS = ("www.amazon.com", "old.reddit.com", "stats.doubleclick.net", "www.nih.gov", "notamazon.com", "www.shoes.org", "blog.run.net", "a.com", "b.org", "c.net", "d.io")


def event_serp(spark, sf_dir) -> DataFrame:
    """Events as search results: a user is a keyword, ten events a page, few paths, so addresses recur."""
    e = F.col("event_id")
    host = F.element_at(F.array(*map(F.lit, HOSTS)), (e % len(HOSTS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user "), "user_id").alias("keyword"), F.col("user_id").cast("int").alias("keyword_idx"), F.floor(e / 10).cast("int").alias("page"), (e % 10).cast("int").alias("idx"),
        F.concat(F.lit("https://"), host, F.lit("/"), e % 300).alias("url"),
    )


@query
def event_url_ranks(spark, sf_dir):
    ranked = filters.rank_results(event_serp(spark, sf_dir))
    return filters.first_wins(ranked).select("keyword", "url", "rank", U.absolute_position(F.col("page"), F.col("idx") + 1).alias("absolute"))


@query
def event_batch_bridge(spark, sf_dir):
    return filters.batch_bridge(filters.rank_results(event_serp(spark, sf_dir))).select("keyword", "page", "idx", "url", "rank", "owner", "fetched")


@query
def event_run_counters(spark, sf_dir):
    return filters.run_counters(event_serp(spark, sf_dir))


@query
def event_keyword_success(spark, sf_dir):
    serp = event_serp(spark, sf_dir)
    pages = serp.select("url").distinct().withColumn("word_count", F.length("url") * 2)
    return filters.keyword_success(serp, pages)


@query
def page_gov_filter(spark, sf_dir):
    """Pages whose hosts got an official ending, one of three ways, or none."""
    host, n = U.domain(F.col("url")), F.col("page_id") % 4
    url = F.concat(F.lit("https://"), host, F.when(n == 0, ".gov").when(n == 1, ".gov.uk").when(n == 2, ".gove").otherwise(""), F.lit("/cart"))
    rows = table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    return rows.select("page_id", U.is_gov(F.lower(U.domain(F.col("url")))).alias("gov"), U.is_junk_url(F.col("url")).alias("junk"))


def linked_pages(spark, sf_dir) -> DataFrame:
    """Pages with four links each: to another page, to a new address, to a blocked one, within the site."""
    p = F.col("page_id")
    links = [
        ("mutual", F.concat(F.lit("https://page"), (p + 1) % 90, F.lit(".org/")), True), ("new", F.concat(F.lit("https://new"), p % 70, F.lit(".net/p")), True),
        ("shop", F.concat(F.lit("https://www.amazon.com/"), p % 5), True), ("own", F.concat(F.lit("https://page"), p, F.lit(".org/in")), False), ("odd", F.lit("ftp://files.org/x"), True),
    ]
    items = F.array(*[F.struct(F.lit(i).alias("link_nth"), url.alias("url"), F.lit(text).alias("text"), F.lit(outbound).alias("is_outbound")) for i, (text, url, outbound) in enumerate(links)])
    return table(spark, sf_dir, "pages").select(p.cast("int").alias("page_idx"), F.concat(F.lit("https://page"), p, F.lit(".org/")).alias("url"), (p * 13 % 120).cast("int").alias("word_count"), items.alias("links"))


@query
def page_outbound(spark, sf_dir):
    return filters.outbound_candidates(linked_pages(spark, sf_dir))


@query
def page_stored_links(spark, sf_dir):
    return filters.stored_links(linked_pages(spark, sf_dir))


@query
def page_chosen_links(spark, sf_dir):
    rows = linked_pages(spark, sf_dir)
    links = rows.select(F.col("url").alias("source_url"), F.posexplode("links").alias("ordinal", "x")).select("source_url", "ordinal", "x.url")
    chosen = rows.filter("page_idx < 3").select((F.col("page_idx") + 1).alias("place"), "url", F.concat(F.lit("k"), "page_idx").alias("keyword"))  # three pages that a user picked
    return filters.chosen_links(chosen, links)


@query
def page_url_resolve(spark, sf_dir):
    p, url = F.col("page_id"), F.col("url")
    href = F.element_at(F.array(F.lit("/a/b"), F.lit("c.html"), F.lit("//cdn.org/x"), F.lit("https://abs.org/?utm_source=a&b=2"), F.lit("?q=1&fbclid=9")), (p % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", U.resolve(url, href).alias("resolved"), U.strip_tracking(href).alias("stripped"))


@query
def document_render_choice(spark, sf_dir):
    """Documents as bodies, every third with the mark of a script."""
    html = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, "<div id=react-root>").otherwise(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", html.alias("html"), X.word_count(F.col("text")).alias("word_count"), (F.col("n_chars") % 7).alias("p_tags"))
    return rows.select("doc_id", extract.needs_rendering(F.col("word_count"), extract.body_marks(F.col("html"))).alias("needs"), ((F.col("word_count") > 200) & (F.col("p_tags") < 3)).alias("non_article"), extract.is_binary(F.col("html")).alias("is_binary"))


@query
def document_render_merge(spark, sf_dir):
    """Documents as pages; every second has a rendered form, with more words or fewer."""
    empty = F.array().cast("array<string>")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text", X.word_count(F.col("text")).alias("word_count"))
    pages = docs.select("page_id", "word_count", F.lit(1).alias("p_tags"), F.lit(False).alias("non_article"), F.col("text").alias("page_text"), empty.alias("headings"), empty.alias("links"))
    new = docs.filter("page_id % 2 = 0").select("page_id", (F.col("word_count") + F.col("page_id") % 3 - 1).alias("word_count"), F.lit(9).alias("p_tags"), F.lit(True).alias("non_article"), F.reverse("text").alias("page_text"), empty.alias("headings"), empty.alias("links"))
    return extract.merge_rendered(pages, new).select("page_id", "word_count", "p_tags", F.md5("page_text").alias("text_md5"), "used_rendering")


def source_keywords(spark, sf_dir, most_distinct: int | None = 10_000) -> DataFrame:
    """The keywords of every source, with a similarity that follows from their length; of its first so many n-grams, or of all."""
    t = tokens(spark, sf_dir)
    union = corpus.keyword_union(corpus.tfidf_keywords(t, GROUP, 100), corpus.top_ngrams(t, GROUP, 50, most_distinct), GROUP, kind="kind")
    return materialise(union.select("source", "text", "kind", "score", "frequency", ((F.length("text") * 7 % 100) / 100).alias("similarity"), "place"), "source-keywords")


def source_questions(spark, sf_dir) -> DataFrame:
    """Benchmark items as questions about the source of the document that has their number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return table(spark, sf_dir, "benchmark").join(docs, F.col("item_id") == F.col("doc_id")).select("source", F.col("text").alias("phrase"))


def word_ranks(spark, sf_dir) -> DataFrame:
    """Frequency table of the benchmark's words, the most frequent first."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).groupBy("word").count()
    lines = words.select(F.struct(-F.col("count"), "word").alias("nth"), F.concat("word", F.lit(" "), "count").alias("value"))
    return search.frequency_table(lines)


def source_scores(spark, sf_dir) -> DataFrame:
    terms = keywords.google_terms(source_questions(spark, sf_dir), GROUP)
    return keywords.rescore(source_keywords(spark, sf_dir, None), GROUP, terms, word_ranks(spark, sf_dir), True)


@query
def source_rescore(spark, sf_dir):
    return source_scores(spark, sf_dir).select("source", "text", "kind", "frequency", "word_rank", *[six(c) for c in ("cfr", "sem", "tfidf", "boost", "final")])


@query
def source_junk(spark, sf_dir):
    return keywords.drop_junk(source_scores(spark, sf_dir), GROUP).select("source", "text", "junk", six("final"))


@query
def source_tiers(spark, sf_dir):
    scored = keywords.drop_junk(source_scores(spark, sf_dir), GROUP).withColumn("final", F.round("final", 6)).withColumnsRenamed({"source": "grp", "kind": "source"})
    scored = materialise(scored.select("grp", "text", "source", "final"), "source-scores")  # the tiers read it several times
    return keywords.keyword_tiers(scored, ["grp"]).withColumnRenamed("grp", "origin")


def source_gaps(spark, sf_dir) -> DataFrame:
    """Every document as a draft on its source: against the source's TF-IDF words and its lines that occur twice."""
    docs = table(spark, sf_dir, "documents")
    words = corpus.tfidf_keywords(tokens(spark, sf_dir), GROUP, 20).select("source", F.col("word").alias("text"), F.col("rank").alias("place"))
    lines = docs.select("source", F.explode(F.split("text", "\n", -1)).alias("line")).filter("line <> ''").groupBy("source", "line").agg(F.count(F.lit(1)).alias("count"))
    shown = corpus.top_rows(lines.filter("count >= 2"), GROUP, [F.desc("count"), F.asc("line")], 40, "place").select("source", F.col("line").alias("text"), "count", "place")
    stats = docs.groupBy("source").agg(F.avg(X.word_count(F.col("text"))).alias("avg_words"), (F.count(F.lit(1)) % 9).alias("recommended_headings"))
    return keywords.content_gap(docs.select("source", F.col("doc_id").alias("draft_id"), F.col("text").alias("draft")), words, shown, stats, GROUP)


@query
def source_gap(spark, sf_dir):
    out = source_gaps(spark, sf_dir)
    return out.select("source", "draft_id", "user_words", six("keyword_coverage"), six("heading_coverage"), six("word_ratio"), "words_needed", "headings_needed", F.array_join("missing_keywords", "|").alias("missing_keywords"), F.md5(F.array_join("missing_headings", "|")).alias("missing_headings"))


@query
def source_gap_report(spark, sf_dir):
    gaps = source_gaps(spark, sf_dir).withColumn("keyword", F.col("draft_id").cast("string"))
    return reports.render_all(gaps.drop("source", "draft_id"), "gap").select("keyword", F.md5("report").alias("report_md5"))


@query
def source_text_lines(spark, sf_dir):
    rows = source_keywords(spark, sf_dir).withColumns({"grp": F.col("source"), "source": F.col("kind"), "score": F.round("score", 2)})
    return reports.text_lines(rows, "grp")


@query
def part_headings(spark, sf_dir):
    """Headings with a part's name, of seven kinds: three hold a phrase of page furniture, one ends a sentence, one calls to action, one is a byline, one stays. (A widget is page furniture too.)"""
    name, n = F.col("p_name"), F.col("p_partkey") % 7
    low = F.concat(F.lit("guide to the "), name)
    text = F.when(n == 0, F.concat(low, F.lit(": Related Articles"))).when(n == 1, F.concat(F.lit("Newsletter for the "), name)).when(n == 2, F.concat(low, F.lit(" and our privacy policy")))
    text = text.when(n == 3, F.concat(low, F.lit("."))).when(n == 4, F.concat(F.lit("Get "), low)).when(n == 5, F.initcap(name)).otherwise(low)
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("page"), F.lit(0).alias("nth"), F.lit("h2").alias("tag"), text.alias("text"))
    return headings.heading_patterns(headings.reject_headings(rows), ["p_brand"])


def made_headings(spark, sf_dir) -> DataFrame:
    """Headings of brands in which shorter names stand in longer ones, with some furniture."""
    n = F.col("p_partkey") % 4
    text = F.when(n == 0, F.concat(F.lit("How to use the "), "p_name")).when(n == 1, F.concat(F.lit("use the "), F.upper("p_name"))).when(n == 2, F.concat("p_name", F.lit(" newsletter"))).otherwise(F.concat(F.lit("About the "), F.col("p_size") % 5, F.lit(" kinds")))
    return table(spark, sf_dir, "part").select("p_brand", F.floor(F.col("p_partkey") / 10).alias("page"), (F.col("p_partkey") % 10).alias("nth"), F.when(F.col("p_size") % 3 == 0, "h3").otherwise("h2").alias("tag"), text.alias("text"))


@query
def part_heading_clusters(spark, sf_dir):
    return headings.heading_clusters(headings.reject_headings(made_headings(spark, sf_dir)), ["p_brand"])


@query
def part_heading_ranks(spark, sf_dir):
    patterns = headings.heading_clusters(headings.reject_headings(made_headings(spark, sf_dir)), ["p_brand"], 20)
    return headings.ranked_patterns(patterns, ["p_brand"], 5).select("p_brand", "place", "tag", "text", "count")


@query
def page_analysis_keywords(spark, sf_dir):
    """Keywords of the whole analysis, in order."""
    rows = analysis_rows(spark, sf_dir).select("keyword", F.posexplode("keywords").alias("nth", "k"))
    return rows.select("keyword", "nth", "k.text", F.round("k.score", 6).alias("score"), "k.frequency", "k.source")


@query
def page_analysis_headings(spark, sf_dir):
    rows = analysis_rows(spark, sf_dir).select("keyword", F.posexplode("headings").alias("nth", "h"))
    return rows.select("keyword", "nth", "h.tag", "h.text", "h.count")


@query
def page_outline_briefs(spark, sf_dir):
    return reports.render_all(analysis_rows(spark, sf_dir), "outline").select("keyword", F.md5("report").alias("report_md5"))


@query
def page_keyword_briefs(spark, sf_dir):
    return reports.render_all(analysis_rows(spark, sf_dir), "keywords").select("keyword", F.md5("report").alias("report_md5"))


@query
def page_competitive_briefs(spark, sf_dir):
    return reports.render_all(analysis_rows(spark, sf_dir), "competitive").select("keyword", F.md5("report").alias("report_md5"))


@query
def source_outline(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("keyword"), F.explode(F.split("text", "\n", -1)).alias("line")).filter("line <> ''")
    hs = lines.groupBy("keyword", F.lit("h2").alias("tag"), F.col("line").alias("text")).agg(F.count(F.lit(1)).alias("count"))
    return reports.select_outline(hs).select("keyword", "place", "count", F.md5("text").alias("text_md5"))


KINDS = ("how-to", "guide", "recipe", "health guide", "article", "review")


@query
def document_readers(spark, sf_dir):
    d = F.col("doc_id")
    at = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", reports.audience(at(intent.INTENTS, d), at(KINDS, F.floor(d / 4))).alias("reader"))


@query
def part_strings(spark, sf_dir):
    s = F.concat(F.lit(" \t"), F.initcap("p_name"), F.when(F.col("p_partkey") % 2 == 0, ".txt ").otherwise("\r\n"))
    rows = table(spark, sf_dir, "part").select("p_partkey", s.alias("s"))
    c = F.col("s")
    return rows.select(
        "p_partkey", X.trim(c).alias("trimmed"), X.ascii_lower(c).alias("low"), X.trim(c).endswith(".txt").alias("ends"), X.contains_any_case(c, F.lit("RING")).alias("holds_any_case"),
        X.truncate_domain(X.trim(c), 12).alias("short"), U.file_stem(c).alias("stem"), F.to_json(F.struct("s")).alias("json"),
    )


@query
def part_entities(spark, sf_dir):
    """Words of part names as pieces: the first begins an entity, the next goes on or is glued, the third is none, the fourth begins another."""
    words = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.split(F.initcap(F.concat("p_name", F.lit(" of rome"))), " ")).alias("pos", "word"))
    piece = F.when((F.col("pos") == 1) & (F.col("doc_id") % 2 == 0), F.concat(F.lit("##"), F.lower("word"))).otherwise(F.col("word"))
    label = F.element_at(F.array(*map(F.lit, ("B-ORG", "I-ORG", "O", "B-LOC"))), (F.col("pos") % 4 + 1).cast("int"))
    return entities.decode_labels(words.select("doc_id", "pos", piece.alias("piece"), label.alias("label")))


@query
def embedding_softmax(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 10).alias("logits"))
    return rows.select("vec_id", F.round(V.softmax(F.col("logits"), 2), 6).alias("entailment"))


@query
def document_list_copy(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.posexplode(F.split("text", "\n", -1)).alias("nth", "line"))
    marked = lines.withColumn("line", F.when(F.col("nth") % 5 == 1, F.concat(F.lit("  "), "line", F.lit("  x"))).when(F.col("nth") % 5 == 2, F.concat(F.lit("--"), "line")).otherwise(F.col("line")))
    return reports.copied_lines(marked).select("d", "nth", F.md5("line").alias("line_md5"))


def captured_files(spark, sf_dir) -> DataFrame:
    """name, content: responses with ten documents a page, for a thousand numbers of a source each; then an empty page, and one that a reader must not reach."""
    docs = table(spark, sf_dir, "documents").filter(F.col("source").isNotNull())
    docs = docs.withColumn("keyword", F.concat("source", F.lit(" & co. #"), F.floor(F.col("doc_id") / 1000)))
    placed = corpus.top_rows(docs, ["keyword"], [F.asc("doc_id")], 1 << 30, "nth")
    result = F.struct(F.concat(F.lit("title "), "doc_id").alias("title"), F.concat(F.lit("https://host"), F.col("doc_id") % 97, F.lit(".com/"), "doc_id").alias("link"), F.col("text").alias("snippet"))
    page = F.floor((F.col("nth") - 1) / 10).cast("int") + 1
    pages = placed.groupBy("keyword", page.alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", result.alias("r")))), lambda x: x["r"]).alias("organic"))
    bodies = pages.select("keyword", "page", F.to_json(F.struct("organic")).alias("body"))
    ends = pages.groupBy("keyword").agg(F.max("page").alias("last"))
    after = ends.select("keyword", F.explode(F.array(F.struct((F.col("last") + 1).alias("page"), F.lit('{"organic":[]}').alias("body")), F.struct((F.col("last") + 2).alias("page"), F.lit('{"organic":[{"title":"stray"}]}').alias("body")))).alias("x"))
    return bodies.unionByName(after.select("keyword", "x.page", "x.body")).select(captured.file_name(F.col("keyword"), F.col("page")).alias("name"), F.col("body").alias("content"))


@query
def captured_results(spark, sf_dir):
    """Responses written as files of given names, then read by keyword up to the first empty page."""
    path = scratch_path(spark, "captured")
    named_files.write_named_files(captured_files(spark, sf_dir), path)
    rows = search.organic_results(search.parse_responses(captured.read_captured(spark, path, keywords_per_partition=8)))
    return rows.select("keyword", "page", "idx", "absolute", "title", "domain", F.md5("snippet").alias("snippet_md5"))


@query
def document_files(spark, sf_dir):
    """Documents written as files in a folder of their source's stem, read back."""
    path = scratch_path(spark, "files")
    name = F.concat(U.file_stem(F.coalesce("source", F.lit("none"))), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    docs = table(spark, sf_dir, "documents").select(F.ltrim(name, F.lit("/")).alias("name"), F.col("text").alias("content"))  # a stem may be empty
    named_files.write_named_files(docs, path)
    read = named_files.read_named_files(docs, path)
    whole = F.when(F.contains("name", F.lit("/")), F.col("name")).otherwise(F.concat(F.lit("/"), "name"))
    return materialise(read.select(whole.alias("name"), F.md5("content").alias("content_md5")), "files-read")


@query
def document_line_numbers(spark, sf_dir):
    """Lines of the documents, written as text files in order, numbered over all of them."""
    path = scratch_path(spark, "lines")
    docs = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", "text").repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id")
    docs.select(F.col("text").alias("value")).write.option("lineSep", "\n").text(path)
    return search.numbered_lines(spark, path).select("nth", F.md5("value").alias("line_md5"))


@query
def observed_pages(spark, sf_dir):
    """Counters of the pages, taken in the pass that writes their domains."""
    rows = table(spark, sf_dir, "pages").withColumn("domain", U.domain(F.col("url")))
    secure = F.col("url").startswith("https://")
    counters = {"n_pages": F.count(F.lit(1)), "n_secure": runs.counted_if(secure), "n_english": runs.counted_if(F.col("url").contains("/en/")), "n_bytes": F.sum(F.octet_length("html"))}
    out, seen = runs.observed(rows, counters)
    materialise(out.select("page_id", "domain"), "observed")
    return spark.createDataFrame([(k, int(v)) for k, v in seen.get.items()], "counter string, n long")


SESSION_KINDS = ("new", "old", "mixed")


def page_sessions(spark, sf_dir) -> DataFrame:
    """A stored session for each page, in three layouts: new names, old names, and one with fields of other types and unknown ones."""
    p = F.col("page_id")
    parts = F.filter(F.split(U.domain(F.col("url")), r"\."), lambda x: x != "")
    new = F.struct(
        F.col("url").alias("keyword"), F.lit("commercial").alias("intent"), F.transform(parts, lambda x: F.struct(x.alias("text"), F.length(x).alias("freq"), F.lit("tfidf").alias("src"), F.lit(0.5).alias("score"))).alias("keywords"),
        F.array(F.struct(F.concat(F.lit("why "), p).alias("question"), F.col("url").alias("link"))).alias("people_also_ask"), F.struct((p * 10).alias("avg_words")).alias("stats"), F.array(F.struct(F.col("url"), p.alias("words"))).alias("pages"),
    )
    old = F.struct(
        F.col("url").alias("keyword"), F.lit("informational").alias("primary_intent"), F.transform(parts, lambda x: F.struct(x.alias("text"), F.length(x).alias("frequency"))).alias("keywords"),
        F.array(F.concat(F.lit("how "), p)).alias("people_also_ask"), F.struct((p * 10).alias("avg_word_count")).alias("stats"), F.array(F.struct(F.col("url"))).alias("pages"),
    )
    mixed = F.struct(
        F.col("url").alias("keyword"), F.struct(F.lit("transactional").alias("primary"), F.lit(3).alias("extra")).alias("intent"), F.transform(parts, lambda x: F.struct(x.alias("text"), F.length(x).alias("freq"), F.lit("high").alias("score"), F.array(F.lit(1)).alias("unknown"))).alias("keywords"),
        F.array(F.struct(F.concat(F.lit("who "), p).alias("question"), F.lit(5).alias("rank"))).alias("people_also_ask"), F.lit("none").alias("stats"), F.lit("none").alias("pages"), F.struct(F.lit(True).alias("b")).alias("more"),
    )
    kind = p % 3
    body = F.when(kind == 0, F.to_json(new)).when(kind == 1, F.to_json(old)).otherwise(F.to_json(mixed))
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("k"), p).alias("keyword"), body.alias("json_data"), F.timestamp_seconds(p * 86400).alias("updated_at"))


@query
def page_session_keywords(spark, sf_dir):
    return search.session_tables(search.restore_sessions(page_sessions(spark, sf_dir)))["keywords"].select("keyword", "nth", "text", "frequency", "source", "score")


@query
def page_session_questions(spark, sf_dir):
    return search.session_tables(search.restore_sessions(page_sessions(spark, sf_dir)))["questions"].select("keyword", "nth", "question", "link")


@query
def page_session_summary(spark, sf_dir):
    out = search.session_summary(search.restore_sessions(page_sessions(spark, sf_dir)))
    return out.select("keyword", F.col("n_keywords").cast("long").alias("n_keywords"), "intent", "avg_words", F.col("n_pages").cast("long").alias("n_pages"), F.col("n_questions").cast("long").alias("n_questions"))


@query
def stored_upsert(spark, sf_dir):
    """Results in stored buckets, then changes and new ones merged in, then a read of what is there."""
    tables = stored.StoredTables(spark, scratch_path(spark, "stored"), buckets=16)
    own = [f.split()[0] for f in stored.RESULTS.split(", ")]
    first = queue(spark, sf_dir).select(*own)
    tables.commit({"results": first}, range(16), 0)
    tables.upsert(new_results(spark, sf_dir), now())
    return tables.read("results").select("url", "keyword", "title", "serp_position", "status", "created_at")


@query
def stored_delete(spark, sf_dir):
    """Addresses deleted from four stored tables in one change; the rows that stay in each."""
    tables = stored.StoredTables(spark, scratch_path(spark, "stored"), buckets=16)
    rows = queue(spark, sf_dir)
    own = {
        "results": rows.select(*[f.split()[0] for f in stored.RESULTS.split(", ")]),
        "history": rows.select("url", "keyword", "serp_position", "title", F.col("created_at").alias("recorded_at")),
        "headings": rows.select("url", "keyword", F.lit(0).alias("ordinal"), F.lit("h2").alias("tag"), F.col("title").alias("text")),
        "links": rows.select(F.col("url").alias("source_url"), "keyword", F.lit(0).alias("ordinal"), F.col("domain").alias("obl_url"), F.col("title").alias("anchor_text")),
    }
    tables.commit(own, range(16), 0)
    tables.delete(rows.filter("event_id % 9 = 0").select("url", "keyword"))
    parts = [tables.read(t).select(F.lit(t).alias("t"), F.col(stored.TABLES[t][0]).alias("url"), "keyword") for t in own]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
