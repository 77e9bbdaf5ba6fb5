"""The whole analysis of many keywords in one job: admission to reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import corpus, headings, intent, keywords
from lodestone.plans import reports


KEYWORD_PARTS = ("frequency", "source", "cfr", "sem", "tfidf", "boost")


@dataclass(frozen=True)
class Options:
    """Limits of an analysis."""

    n_keywords: int = 2000
    n_ngrams: int = 200
    has_embeddings: bool = False
    skip_similarity_rules: bool = False
    #: All n-grams and patterns of headings of a keyword count, not the first 10,000 and 100.
    whole: bool = False


def analyze(
    pages: DataFrame, questions: DataFrame | None = None, options: Options = Options(), *, entities: DataFrame | None = None,
    related: DataFrame | None = None, ranks: DataFrame | None = None, similarity: DataFrame | None = None, heading_similarity: DataFrame | None = None,
    entailment: DataFrame | None = None,
) -> DataFrame:
    """One analysis row (see reports) for each keyword of pages(keyword, page_id, page_text, word_count, headings, ...).

    pages is what operators.extract gives, with the keyword that each page ranks for; questions and related searches have (keyword, phrase), entities are those of
    operators.entities.merge_entities by keyword, ranks is the word-frequency table (rank, word), and similarity has
    (keyword, text, similarity) of keyword texts and the keyword, which count if options.has_embeddings. heading_similarity
    (keyword, text, similarity) has the same of heading texts: those far from the keyword stay only if pages share them.
    entailment has (keyword, content_type, entailment) of a model, which goes before the rules if it is sure enough.
    """
    group = ["keyword"]
    docs = pages.select("keyword", F.col("page_id").alias("doc_id"), F.col("page_text").alias("text"), "non_article")
    admitted = corpus.admit(docs)
    tokens = corpus.held_tokens(admitted, group)
    grams = corpus.top_ngrams(tokens, group, options.n_ngrams, None) if options.whole else corpus.top_ngrams(tokens, group, options.n_ngrams)
    union = corpus.keyword_union(corpus.tfidf_keywords(tokens, group, options.n_keywords), grams, group, options.n_keywords)
    spark = pages.sparkSession
    asked = questions if questions is not None else spark.createDataFrame([], "keyword string, phrase string")
    searched = related if related is not None else spark.createDataFrame([], "keyword string, phrase string")
    terms = keywords.google_terms(asked.select("keyword", "phrase").unionByName(searched.select("keyword", "phrase")), group)
    if similarity is not None:
        union = union.join(similarity.groupBy("keyword", "text").agg(F.max("similarity").alias("similarity")), ["keyword", "text"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    scored = keywords.drop_junk(keywords.rescore(union, group, terms, ranks, options.has_embeddings), group, options.skip_similarity_rules)
    listed = scored.groupBy("keyword").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("final")).alias("order"), "text", *KEYWORD_PARTS))), lambda k: F.struct(k["text"].alias("text"), (-k["order"]).alias("score"), *[k[c].alias(c) for c in KEYWORD_PARTS])).alias("keywords")
    )
    shown = headings.reject_headings(headings.admit_headings(pages, group, "page_id"))
    clusters = headings.all_clusters(shown, group) if options.whole else headings.heading_clusters(shown, group)
    if heading_similarity is not None:
        near = heading_similarity.groupBy("keyword", "text").agg(F.max("similarity").alias("similarity"))
        clusters = clusters.join(near, ["keyword", "text"], "left").filter((F.coalesce("similarity", F.lit(0.0)) >= headings.LEAST_SIMILARITY) | (F.col("count") >= 2)).drop("similarity")
    patterns = clusters.groupBy("keyword").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), "first_seen", "tag", "text"))), lambda h: F.struct(h["tag"].alias("tag"), h["text"].alias("text"), (-h["order"]).alias("count"))).alias("headings")
    )
    counted = pages.withColumnRenamed("headings", "h").withColumn("headings", F.size("h"))
    stats = corpus.recommendations(corpus.content_stats(counted, group))
    windows = intent.text_window(admitted, "keyword")
    by_intent = F.map_from_arrays(F.array(*map(F.lit, intent.INTENTS)), F.array(*intent.INTENTS))
    scores = intent.intent_scores(windows).select("keyword", "primary_intent", "confidence", "signals", by_intent.alias("scores"))
    kinds, tones = intent.content_type(windows), intent.tone(windows).select("keyword", "tone")
    if entailment is not None:
        sure = intent.primary_entailment(entailment).withColumnRenamed("content_type", "entailed")
        kinds = kinds.join(sure, "keyword", "left").select("keyword", F.coalesce("entailed", "content_type").alias("content_type"))
    asked_list = asked.groupBy("keyword").agg(F.transform(F.array_sort(F.collect_set("phrase")), lambda q: F.struct(q.alias("question"))).alias("questions"))
    out = stats.join(scores, "keyword", "left").join(kinds, "keyword", "left").join(tones, "keyword", "left").join(listed, "keyword", "left").join(patterns, "keyword", "left").join(asked_list, "keyword", "left")
    empty = F.array().cast("array<struct<text:string,label:string,frequency:bigint,sources:bigint>>")
    if entities is None:
        out = out.withColumn("entities", empty)
    else:
        fields = lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"), e["frequency"].cast("long").alias("frequency"), e["sources"].cast("long").alias("sources"))
        met = entities.groupBy("keyword").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text", "label", "frequency", "sources"))), fields).alias("entities"))
        out = out.join(met, "keyword", "left").withColumn("entities", F.coalesce("entities", empty))
    others = searched.groupBy("keyword").agg(F.array_sort(F.collect_set("phrase")).alias("related"))
    out = out.join(others, "keyword", "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))
    return out.fillna({"primary_intent": "informational", "content_type": "article", "tone": "conversational"})


def reports_of(analyses: DataFrame, kind: str = "full") -> DataFrame:
    return reports.render_all(analyses, kind)


