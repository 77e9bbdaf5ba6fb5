"""Intent, content type and tone of a keyword and the texts that rank for it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import lists as L
from lodestone.functions import text as X

INTENTS = ("informational", "commercial", "transactional", "navigational")
SIGNALS = {"informational": L.INTENT_INFORMATIONAL, "commercial": L.INTENT_COMMERCIAL, "transactional": L.INTENT_TRANSACTIONAL, "navigational": L.INTENT_NAVIGATIONAL}
#: Bytes of the text window, of a page in it, and what must be free for another page.
WINDOW, PER_PAGE, ROOM = 8192, 500, 500


def text_window(docs: DataFrame, keyword: str, doc: str = "doc_id") -> DataFrame:
    """keyword, window: the lower-cased keyword and the first bytes of each text in order, as far as they fit.

    Each page adds a byte at least and PER_PAGE + 1 at most, so only the first pages of a group can be in its window:
    they are cut out before texts are gathered.
    """
    most = WINDOW  # pages, if each has no more than its blank
    start = docs.select(F.col(keyword).alias("keyword"), F.col(doc).alias("doc"), X.first_bytes(F.col("text"), PER_PAGE).alias("part"))
    order = Window.partitionBy("keyword").orderBy("doc")
    start = start.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)
    before = F.coalesce(F.sum(F.octet_length("part") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = start.withColumn("before", F.octet_length("keyword") + 1 + before).filter(F.col("before") < WINDOW - ROOM)
    parts = fits.groupBy("keyword").agg(F.array_sort(F.collect_list(F.struct("nth", "part"))).alias("parts"))
    return parts.select("keyword", F.lower(F.concat(F.col("keyword"), F.lit(" "), F.array_join(F.transform("parts", lambda p: F.concat(p["part"], F.lit(" "))), ""))).alias("window"))


def _either(keyword: Column, window: Column, phrase: str) -> Column:
    return F.when(keyword.contains(phrase), 3.0).when(window.contains(phrase), 1.0).otherwise(0.0)


def intent_scores(windows: DataFrame) -> DataFrame:
    """keyword, window, one score for each intent, signals (map of the phrases found), confidence (map), primary_intent."""
    key, window = F.lower("keyword"), F.col("window")
    overridden = key.rlike(X.any_of(L.INFO_OVERRIDES))
    out = windows
    for intent in INTENTS:
        score = sum((_either(key, window, s) for s in SIGNALS[intent]), F.lit(0.0))
        if intent in ("commercial", "transactional"):
            score = F.when(overridden, F.greatest(score - 2.0, F.lit(0.0))).otherwise(score)
        out = out.withColumn(intent, score)
    total = F.greatest(sum((F.col(i) for i in INTENTS), F.lit(0.0)), F.lit(1.0))
    best = F.greatest(*[F.col(i) for i in INTENTS])
    primary = F.coalesce(*[F.when(F.col(i) == best, F.lit(i)) for i in INTENTS])
    found = [F.slice(F.filter(F.array(*[F.lit(s) for s in SIGNALS[i]]), lambda s: F.col("window").contains(s)), 1, 20) for i in INTENTS]
    names = F.array(*[F.lit(i) for i in INTENTS])
    return (
        out.withColumn("primary_intent", primary)
        .withColumn("confidence", F.map_from_arrays(names, F.array(*[F.col(i) / total for i in INTENTS])))
        .withColumn("signals", F.map_from_arrays(names, F.array(*found)))
    )


def content_type(windows: DataFrame) -> DataFrame:
    """keyword and content_type by rules on the keyword and signals of the window; ties go to the first type."""
    key, window = F.lower("keyword"), F.col("window")
    scores = {t: F.lit(0) for t in L.CONTENT_TYPES}
    for phrases, gains in L.TYPE_KEYWORD_RULES:
        hit = key.rlike(X.any_of(phrases))
        for kind, gain in gains.items():
            scores[kind] = scores[kind] + F.when(hit, gain).otherwise(0)
    for kind, phrases in L.TYPE_PAGE_SIGNALS.items():
        scores[kind] = scores[kind] + F.when(X.count_hits(window, phrases) >= 2, 1).otherwise(0)
    scores["article"] = F.lit(1)
    best = F.greatest(*scores.values())
    return windows.select("keyword", F.coalesce(*[F.when(s == best, F.lit(t)) for t, s in scores.items()]).alias("content_type"))


def weighted_hits(text: Column, weights: dict[int, Sequence[str]]) -> Column:
    return sum((X.count_hits(text, phrases) * w for w, phrases in weights.items()), F.lit(0))


def tone(windows: DataFrame) -> DataFrame:
    """keyword, formal, casual, technical, tone."""
    window = F.col("window")
    scored = windows.select(
        "keyword", weighted_hits(window, {3: L.TONE_FORMAL_3, 1: L.TONE_FORMAL_1}).alias("formal"),
        weighted_hits(window, {3: L.TONE_CASUAL_3, 1: L.TONE_CASUAL_1}).alias("casual"), weighted_hits(window, {2: L.TONE_TECHNICAL_2}).alias("technical"),
    )
    kind = F.when((F.col("technical") > F.col("formal")) & (F.col("technical") > F.col("casual")), "technical").when(F.col("formal") > F.col("casual"), "formal").otherwise("conversational")
    return scored.withColumn("tone", kind)


def primary_entailment(rows: DataFrame, least: float = 0.10) -> DataFrame:
    """keyword and content_type from rows(keyword, content_type, entailment): the best, if it reaches least."""
    best = rows.groupBy("keyword").agg(F.max(F.struct("entailment", "content_type")).alias("best"))
    return best.select("keyword", F.when(F.col("best.entailment") >= least, F.col("best.content_type")).alias("content_type"))
