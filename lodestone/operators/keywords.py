"""Keyword rescoring, junk filters, content gap and tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.containment import phrase_coverage, phrase_hits

RANKED_WORDS = 50_000


def google_terms(phrases: DataFrame, group: Sequence[str], column: str = "phrase") -> DataFrame:
    """group, term: distinct words of three letters and more of questions and related searches."""
    words = phrases.select(*group, F.explode(F.split(F.lower(column), "[ ?.,!;:'\"()-]+")).alias("term"))
    return words.filter(F.length("term") >= 3).distinct()


def rescore(keywords: DataFrame, group: Sequence[str], terms: DataFrame, ranks: DataFrame | None = None, has_embeddings: bool = False) -> DataFrame:
    """keywords(group, text, source, score, frequency[, similarity]) with cfr, sem, boost, tfidf and final.

    cfr is the root of a word's place in the frequency table ranks(rank, word), 0.85 if it has none; boost is for words
    of the terms. tfidf is the score over the group's highest.
    """
    rows = keywords if "similarity" in keywords.columns else keywords.withColumn("similarity", F.lit(0.0))
    if ranks is None:
        rows = rows.withColumn("word_rank", F.lit(-1))
    else:  # at most RANKED_WORDS rows
        table = F.broadcast(ranks.filter(F.col("rank") <= RANKED_WORDS).groupBy(F.col("word").alias("text")).agg(F.max("rank").alias("word_rank")))
        rows = rows.join(table, "text", "left").withColumn("word_rank", F.coalesce("word_rank", F.lit(-1)))
    parts = rows.select(*group, "text", F.explode(F.split("text", " ")).alias("term")).distinct()
    boosted = parts.join(terms.select(*group, "term"), [*group, "term"], "left_semi").select(*group, "text").distinct().withColumn("boosted", F.lit(True))
    top = F.greatest(F.max("score").over(Window.partitionBy(*group)), F.lit(0.01))
    rows = rows.join(boosted, [*group, "text"], "left").withColumn("tfidf", F.col("score") / top)
    rows = rows.withColumn("cfr", F.when(F.col("word_rank") > 0, F.sqrt(F.col("word_rank") / RANKED_WORDS)).otherwise(0.85))
    rows = rows.withColumn("sem", F.least(F.greatest("similarity", F.lit(0.0)), F.lit(1.0)) if has_embeddings else F.lit(0.0))
    rows = rows.withColumn("boost", F.when(F.col("boosted"), 0.15).otherwise(0.0))
    if has_embeddings:
        final = 0.35 * F.col("cfr") + 0.45 * F.col("sem") + 0.20 * F.col("tfidf") + F.col("boost")
    else:
        final = 0.55 * F.col("cfr") + 0.30 * F.col("tfidf") + F.col("boost")
    return rows.withColumn("final", final).drop("boosted", "similarity")


def drop_junk(scored: DataFrame, group: Sequence[str], skip_similarity_rules: bool = False) -> DataFrame:
    """scored with final set to 0 for junk and for phrases nearly as frequent as the group's most frequent one.

    Without embeddings every single word is junk by its similarity of 0; skip_similarity_rules leaves those alone.
    """
    similarity = F.when(F.lit(skip_similarity_rules), 1.0).otherwise(F.col("sem"))
    junk = X.is_junk_keyword(F.col("text"), similarity, F.col("word_rank") > 0)
    most = F.max("frequency").over(Window.partitionBy(*group))
    uniform = F.col("text").contains(" ") & (F.col("frequency") / most >= 0.80) & (similarity < 0.40)
    return scored.withColumn("junk", junk).withColumn("final", F.when(junk | uniform, 0.0).otherwise(F.col("final")))


def content_gap(drafts: DataFrame, keywords: DataFrame, headings: DataFrame, stats: DataFrame, group: Sequence[str], most: int = 100) -> DataFrame:
    """One row for each draft(group, draft_id, draft): coverage of its group's keywords and headings, and what is missing.

    keywords(group, text, place) and headings(group, text, count, place) are those of the group's analysis, at most a few
    thousand; stats has avg_words and recommended_headings.
    """
    low = drafts.select(*group, "draft_id", F.lower("draft").alias("low"), X.word_count(F.col("draft")).alias("user_words"))

    def coverage(items: DataFrame, name: str) -> DataFrame:
        phrases = items.select(*group, "place", F.lower("text").alias("phrase"), F.col("text").alias("label"))
        rows = phrase_coverage(low.withColumnsRenamed({"draft_id": "text_id", "low": "text"}), phrases, group, most)
        share = F.when(F.col("total") > 0, F.col("found") / F.col("total") * 100)
        return rows.select(*group, F.col("text_id").alias("draft_id"), share.alias(f"{name}_coverage"), F.col("missing").alias(f"missing_{name}s"))

    popular = headings.filter(F.col("count") >= 2)
    empty = F.array().cast("array<string>")
    out = low.drop("low")
    for name, items in (("keyword", keywords.select(*group, "text", "place")), ("heading", popular.select(*group, "text", "place"))):
        out = out.join(coverage(items, name), [*group, "draft_id"], "left")
        out = out.withColumn(f"{name}_coverage", F.coalesce(f"{name}_coverage", F.lit(100.0))).withColumn(f"missing_{name}s", F.coalesce(f"missing_{name}s", empty))
    out = out.join(stats.select(*group, "avg_words", "recommended_headings"), list(group), "left")
    ratio = F.when(F.col("avg_words") > 0, F.col("user_words") / F.col("avg_words")).otherwise(0.0)
    needed = F.greatest(X.truncated(F.coalesce("avg_words", F.lit(0.0)) * 1.1) - F.col("user_words"), F.lit(0).cast("long"))
    wanted = F.when(F.col("recommended_headings") > 0, F.col("recommended_headings")).otherwise(5).cast("long")
    return out.select(
        *group, "draft_id", "user_words", "keyword_coverage", "heading_coverage", "missing_keywords", "missing_headings",
        ratio.alias("word_ratio"), needed.alias("words_needed"), wanted.alias("headings_needed"),
    )


def keyword_tiers(scored: DataFrame, group: Sequence[str], primary: int = 20, secondary: int = 15) -> DataFrame:
    """group, text, tier, place: phrases and words of the first tier, then the second tier, by final score.

    More than `primary` keywords above 0.40 raise that bar. A word that is part of a phrase above 0.25 is no first-tier word.
    """
    order = Window.partitionBy(*group).orderBy(F.desc("final"), "text")
    whole = Window.partitionBy(*group)
    rows = scored.withColumn("nth", F.row_number().over(order)).withColumn("total", F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("above", F.sum((F.col("final") > 0.40).cast("int")).over(whole))
    next_score = F.max(F.when(F.col("nth") == primary + 1, F.col("final"))).over(whole)
    bar = F.when((F.col("above") > primary) & (F.col("total") > primary), next_score + 0.001).otherwise(0.40)
    rows = rows.withColumn("bar", bar).withColumn("available", F.max((F.col("final") > F.col("bar")).cast("int")).over(whole))
    phrases = rows.filter((F.col("source") == "ngram") & (F.col("final") > 0.25))
    words = rows.filter((F.col("source") == "tfidf") & (F.col("final") > 0.25) & (F.col("available") == 1))
    holders = phrases.select(*group, F.lit(0).alias("text_id"), "text")
    inside = phrase_hits(holders, words.select(*group, F.col("nth").alias("place"), F.col("text").alias("phrase")), group)
    alone = words.join(inside.select(*group, F.col("label").alias("text")).distinct(), [*group, "text"], "left_anti").withColumn("tier", F.lit("primary_word"))
    first = rows.filter((F.col("source") == "ngram") & (F.col("final") > F.col("bar"))).withColumn("tier", F.lit("primary_phrase"))
    second = rows.filter((F.col("final") > 0.25) & (F.col("final") <= F.col("bar"))).withColumn("tier", F.lit("secondary"))
    n_phrases = primary * 3 // 4
    most = F.when(F.col("tier") == "primary_phrase", n_phrases).when(F.col("tier") == "primary_word", primary - n_phrases).otherwise(secondary)
    tiers = first.unionByName(alone).unionByName(second)
    placed = tiers.withColumn("place", F.row_number().over(Window.partitionBy(*group, "tier").orderBy("nth")))
    return placed.filter(F.col("place") <= most).select(*group, "text", "tier", "place", "final")
