"""Corpus operators: admission, vocabulary, TF-IDF, n-grams, page keywords, statistics.

Rows are documents of a group (one group for each search keyword); every operator takes the group's columns, so many
groups are analysed in one job. `doc` orders the documents of a group. Scores are never formed across groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.functions import lists as L
from lodestone.functions import text as X
from lodestone.operators.packed import packer
from lodestone.storage import materialise

Group = Sequence[str]
#: Rows of n-grams that every executor may hold to look places up in.
MOST_BROADCAST = 2_000_000
#: Bytes of text whose n-grams (about a million) one task counts in memory.
TEXT_A_BUCKET = 8 << 20
#: The same in tokens.
TOKENS_A_BUCKET = 1_000_000


def admit(docs: DataFrame, least_words: int = 50) -> DataFrame:
    """Documents that are analysed: more than least_words words, an article, English. Their text comes out clean."""
    article = ~F.coalesce("non_article", F.lit(False)) if "non_article" in docs.columns else F.lit(True)
    admitted = docs.filter(F.col("text").isNotNull() & (X.word_count(F.col("text")) > least_words) & article & X.is_english(F.col("text")))
    return admitted.withColumn("text", X.clean_text(F.col("text")))


def tokenize(docs: DataFrame, group: Group, doc: str = "doc_id") -> DataFrame:
    """group, doc, tokens; documents without text are left out."""
    return docs.filter(F.col("text") != "").select(*group, F.col(doc).alias("doc"), X.tokens(F.col("text")).alias("tokens"))


def held_tokens(docs: DataFrame, group: Group, doc: str = "doc_id") -> DataFrame:
    """tokenize, written once for the operators that read it several times."""
    return materialise(tokenize(docs, group, doc), "tokens")


def vocabulary(token_rows: DataFrame, group: Group) -> DataFrame:
    """group, word, tf (occurrences), df (documents). All words and the distinct ones of a row are counted in one pass, so tasks send a row for each word."""
    both = token_rows.select(*group, F.posexplode(F.array("tokens", F.array_distinct("tokens"))).alias("once", "words"))
    words = both.select(*group, "once", F.explode("words").alias("word"))
    return words.groupBy(*group, "word").agg(F.sum(F.lit(1) - F.col("once")).alias("tf"), F.sum(F.col("once")).alias("df"))


def top_rows(rows: DataFrame, group: Group, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered; partial limits run before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def tfidf_keywords(token_rows: DataFrame, group: Group, n: int = 2000, least_score: float = 0.1) -> DataFrame:
    """group, word, score, tf, df, rank: ln(1 + tf) * df * ln(documents / df) of words in two documents at least."""
    sizes = token_rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_docs"))
    words = vocabulary(token_rows, group).filter((F.col("df") >= 2) & (F.length("word") >= 3))
    score = F.log(1.0 + F.col("tf")) * F.col("df") * F.log(F.col("n_docs") / F.col("df"))
    scored = words.join(sizes, list(group)).withColumn("score", score).filter(F.col("score") >= least_score)
    return top_rows(scored, group, [F.desc("score"), F.asc("word")], n).select(*group, "word", "score", "tf", "df", "rank")


def gram_rows(token_rows: DataFrame, group: Group, sizes: Sequence[int] = (2, 3), longest_part: int = 40) -> DataFrame:
    """group, doc, place, n, ngram of every place of an n-gram of neighbouring tokens."""
    most = max(sizes)
    names = [f"w{i}" for i in range(most)]
    shifted = [F.slice("tokens", F.lit(i + 1), F.size("tokens")).alias(n) for i, n in enumerate(names)]
    places = token_rows.filter(F.size("tokens") > 0).select(*group, "doc", F.posexplode(F.arrays_zip(*shifted)).alias("place", "w"))
    part = [F.substring(F.col(f"w.{n}"), 1, longest_part) for n in names]
    grams = [F.struct(F.lit(k).alias("n"), F.when(F.col(f"w.{names[k - 1]}").isNotNull(), F.concat_ws(" ", *part[:k])).alias("ngram")) for k in sizes]
    return places.select(*group, "doc", "place", F.explode(F.array(*grams)).alias("g")).filter("g.ngram IS NOT NULL").select(*group, "doc", "place", "g.n", "g.ngram")


def place_of(token_rows: DataFrame) -> Column:
    """What orders places of n-grams by document, size and place."""
    if isinstance(token_rows.schema["doc"].dataType, T.IntegralType):
        within = F.col("n").cast("long") * (1 << 32) + F.col("place")
        return F.col("doc").cast("decimal(19,0)") * F.lit(1 << 40).cast("decimal(13,0)") + within.cast("decimal(13,0)")
    return F.struct("doc", "n", "place")


def ngrams(token_rows: DataFrame, group: Group, sizes: Sequence[int] = (2, 3), longest_part: int = 40) -> DataFrame:
    """group, ngram, n, occurrences, first_seen of every n-gram of neighbouring tokens.

    first_seen orders by document, size and place. For whole-number documents it is one decimal, which tasks aggregate
    without sorting; else it is a struct.
    """
    made = gram_rows(token_rows, group, sizes, longest_part)
    return made.groupBy(*group, "ngram").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("occurrences"), F.min(place_of(token_rows)).alias("first_seen"))


def ngram_buckets(docs: DataFrame) -> int:
    """Into how many tasks the n-grams of docs(text) are dealt: as many as Spark shuffles to, more for much text."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TEXT_A_BUCKET))


def token_buckets(token_rows: DataFrame) -> int:
    """ngram_buckets of tokens."""
    n = token_rows.agg(F.sum(F.size("tokens").cast("long"))).first()[0] or 0
    return max(int(token_rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TOKENS_A_BUCKET))


def repeated_ngrams(token_rows: DataFrame, group: Group, buckets: int, least: int = 2, longest_part: int = 40) -> DataFrame:
    """group, ngram, occurrences of the n-grams of two and three neighbouring tokens that occur so often.

    Tasks count the trigrams of many documents and send them packed, dealt by group and first two tokens. A bigram needs no row
    of its own, since the trigrams that it begins are all in one bucket.
    """
    fields = [*[token_rows.schema[g] for g in group], T.StructField("bucket", T.IntegerType()), T.StructField("times", T.LongType()), T.StructField("lines", T.StringType())]
    schema = T.StructType(fields)
    packed = token_rows.select(*group, "tokens").mapInArrow(packer(group, to_arrow_schema(schema), buckets, longest_part), schema)
    lines = packed.repartitionById(buckets, "bucket").select(*group, "bucket", "times", F.explode(F.split("lines", "\n")).alias("line"))
    both = F.array_distinct(F.array(F.substring_index("line", " ", 2), "line"))
    grams = lines.select(*group, "bucket", "times", F.explode(both).alias("ngram"))
    counted = grams.groupBy("bucket", *group, "ngram").agg(F.sum("times").alias("occurrences"))
    return counted.filter(F.col("occurrences") >= least).select(*group, "ngram", "occurrences")


def of_groups(rows: DataFrame, groups: DataFrame, group: Group, also: Sequence[str] = ()) -> DataFrame:
    """rows with the other columns of groups, for those that are there; null is a value like others."""
    keys = [*group, *also]
    other = groups.withColumnsRenamed({k: f"__{k}" for k in keys})
    return rows.join(other, reduce(and_, [rows[k].eqNullSafe(other[f"__{k}"]) for k in keys])).drop(*[f"__{k}" for k in keys])


def first_ngrams(token_rows: DataFrame, group: Group, n: int) -> list[DataFrame]:
    """Tables of group, ngram, first_seen: the first n distinct n-grams of each group, a group in one table.

    Only as many documents are cut into n-grams, in their order, as have n distinct ones. How many that takes shows in their
    numbers of n-grams; groups whose first documents repeat too much go on with eight times as many n-grams.
    """
    made = F.greatest(2 * F.size("tokens") - 3, F.lit(0)).cast("long")
    sizes = token_rows.groupBy(*group, "doc").agg(F.sum(made).alias("made"))
    upto = Window.partitionBy(*group).orderBy("doc")
    placed = materialise(sizes.withColumn("upto", F.sum("made").over(upto)), "ngram-sizes")
    out, wanted, short = [], 4 * n, None
    while True:
        own = placed if short is None else of_groups(placed, short, group)
        enough = F.min(F.when(F.col("upto") >= wanted, F.col("doc")))
        cut = materialise(own.groupBy(*group).agg(enough.alias("last"), (F.max("upto") > F.min(F.when(F.col("upto") >= wanted, F.col("upto")))).alias("more")), "ngram-cuts")
        early = of_groups(token_rows, cut, group).filter(F.col("last").isNull() | F.col("doc").isNull() | (F.col("doc") <= F.col("last")))
        found = top_rows(ngrams(early, group), group, [F.asc("first_seen")], n, "seen").select(*group, "ngram", "first_seen")
        found = materialise(found, "first-ngrams")
        counted = found.groupBy(*group).agg(F.count(F.lit(1)).alias("found"))
        short = materialise(of_groups(counted, cut.filter("more"), group).filter(F.col("found") < n).select(*group), "ngram-groups")
        if short.isEmpty():
            return [*out, found]
        other = short.withColumnsRenamed({g: f"__{g}" for g in group})
        out.append(found.join(other, reduce(and_, [found[g].eqNullSafe(other[f"__{g}"]) for g in group]), "left_anti"))
        wanted *= 8


def ngram_rejected(ngram: Column) -> Column:
    """Too short, an edge word at an end, a word twice, furniture, or a filler in a bigram."""
    words = F.split(ngram, " ")
    edge = F.element_at(words, 1).isin(*L.NGRAM_EDGE_WORDS) | F.element_at(words, -1).isin(*L.NGRAM_EDGE_WORDS)
    repeated = F.size(F.array_distinct(words)) < F.size(words)
    filler = (F.size(words) == 2) & F.exists(words, lambda w: w.isin(*L.NGRAM_FILLERS))
    return (F.length(ngram) < 5) | edge | repeated | ngram.rlike(X.any_of(L.NGRAM_CHROME)) | filler


def top_ngrams(token_rows: DataFrame, group: Group, n: int = 200, most_distinct: int | None = 10_000) -> DataFrame:
    """group, ngram, occurrences, rank: the most frequent n-grams, one for each set of words.

    Of a group the first most_distinct n-grams count, or all.
    """
    if most_distinct is None:
        early = frequent_ngrams(token_rows, group, n)
    else:
        early = reduce(DataFrame.unionByName, first_ngrams(token_rows, group, most_distinct)).filter(~ngram_rejected(F.col("ngram")))
    early = materialise(early, "early-ngrams")
    # places of other n-grams end where they are made
    small = early.count() <= MOST_BROADCAST
    other = F.broadcast(early) if small else early
    if most_distinct is None:
        places = gram_rows(token_rows, group).select(*group, "ngram", place_of(token_rows).alias("first_seen"))
        kept = of_groups(places, other, group, ["ngram"]).groupBy(*group, "ngram").agg(F.min("occurrences").alias("occurrences"), F.min("first_seen").alias("first_seen"))
    else:
        met = of_groups(gram_rows(token_rows, group).select(*group, "ngram"), other, group, ["ngram"])
        kept = met.groupBy(*group, "ngram").agg(F.count(F.lit(1)).alias("occurrences"), F.min("first_seen").alias("first_seen")).filter("occurrences >= 2")
    order = [F.desc("occurrences"), F.asc("first_seen")]
    distinct = top_rows(kept.withColumn("word_set", word_set(F.col("ngram"))), [*group, "word_set"], order, 1, "same_words")
    return top_rows(distinct, group, order, n).select(*group, "ngram", "occurrences", "rank")


def word_set(ngram: Column) -> Column:
    return F.array_join(F.array_sort(F.split(ngram, " ")), " ")


def frequent_ngrams(token_rows: DataFrame, group: Group, n: int) -> DataFrame:
    """group, ngram, occurrences of all n-grams that are as frequent as the n-th set of words of their group; of them the first places decide."""
    counted = repeated_ngrams(token_rows, group, token_buckets(token_rows)).filter(~ngram_rejected(F.col("ngram")))
    counted = materialise(counted, "repeated-ngrams")
    sets = counted.groupBy(*group, word_set(F.col("ngram")).alias("word_set")).agg(F.max("occurrences").alias("most"))
    bars = top_rows(sets, group, [F.desc("most"), F.asc("word_set")], n).groupBy(*group).agg(F.min("most").alias("bar"))
    return of_groups(counted, materialise(bars, "ngram-bars"), group).filter(F.col("occurrences") >= F.col("bar")).drop("bar")


def keyword_union(tfidf: DataFrame, grams: DataFrame, group: Group, n: int = 2000, kind: str = "source") -> DataFrame:
    """group, text, kind, score, frequency, place: TF-IDF words, then n-grams that are not among them."""
    words = tfidf.select(*group, F.col("word").alias("text"), F.lit("tfidf").alias(kind), "score", F.col("df").alias("frequency"), "rank")
    own = grams.select(*group, F.col("ngram").alias("text"), F.lit("ngram").alias(kind), F.col("occurrences").cast("double").alias("score"), F.col("occurrences").alias("frequency"), "rank")
    fresh = own.join(words.select(*group, "text"), [*group, "text"], "left_anti").select(*words.columns)
    order = [F.desc(kind), F.asc("rank")]
    return top_rows(words.unionByName(fresh), group, order, n, "place").drop("rank")


def page_keywords(docs: DataFrame, keys: Sequence[str], n: int = 30, least_words: int = 50) -> DataFrame:
    """keys, word, occurrences, rank: words of four letters and more that a page has twice at least."""
    pages = docs.filter(F.col("text").isNotNull() & (X.word_count(F.col("text")) > least_words))
    words = pages.select(*keys, F.posexplode(F.filter(X.tokens(F.col("text")), lambda t: F.length(t) >= 4)).alias("place", "word"))
    counted = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("occurrences"), F.min("place").alias("first_seen")).filter("occurrences >= 2")
    return top_rows(counted, keys, [F.desc("occurrences"), F.asc("first_seen")], n).select(*keys, "word", "occurrences", "rank")


def content_stats(pages: DataFrame, group: Group, least_words: int = 50) -> DataFrame:
    """Averages, extremes and the upper median over pages(word_count, h2, h3, headings, outbound, internal) with enough words.

    Pages are counted by word count first; the median is found among the distinct counts.
    """
    figures = ["h2", "h3", "headings", "outbound", "internal"]
    kept = pages.filter(F.col("word_count") > least_words)
    counted = kept.groupBy(*group, "word_count").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in figures])
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("word_count"))
    middle = F.floor(F.sum("n").over(Window.partitionBy(*group)) / 2) + 1
    placed = counted.withColumn("upto", upto).withColumn("middle", middle)
    n = F.sum("n")
    return placed.groupBy(*group).agg(
        n.alias("n_pages"), (F.sum(F.col("word_count") * F.col("n")) / n).alias("avg_words"), F.min(F.when(F.col("upto") >= F.col("middle"), F.col("word_count"))).alias("median_words"),
        F.min("word_count").alias("min_words"), F.max("word_count").alias("max_words"), *[(F.sum(c) / n).alias(f"avg_{c}") for c in figures],
    )


def recommendations(stats: DataFrame) -> DataFrame:
    """stats with recommended_words (a tenth above the average) and recommended_headings (5 to 15)."""
    words = X.truncated(F.col("avg_words") * 1.1)
    headings = F.least(F.greatest(F.floor(F.col("avg_h2") + 2), F.lit(5)), F.lit(15)).cast("long")
    return stats.withColumn("recommended_words", words).withColumn("recommended_headings", headings)
