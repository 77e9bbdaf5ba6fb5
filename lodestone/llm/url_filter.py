"""Verdicts on web addresses: rules for hosts and paths, and a logistic regression where no rule fits.

Features are the character n-grams of host and path, hashed into a vector; the model is trained on a small labelled table of
addresses (labelled_urls unless the caller has one), at most MOST_LABELLED rows of it. Everything runs in the JVM: columns
cut addresses and n-grams, Spark ML hashes and fits. Rows are judged one by one, so no key is hot.

A null address, or one without ://, has an empty host and path and no rule. Letters A-Z of hosts are lowered, nothing else is.
Repeated rows are judged alike; an empty table gives an empty result. `judge` replaces columns of docs that have the names it
adds; other columns stay.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZES = (3, 4, 5)
BUCKETS = 1 << 14
#: Bound on the labelled rows that are fitted.
MOST_LABELLED = 20_000
RIDGE = 0.01
ALLOW, BLOCK = "allow", "block"


class Rule(NamedTuple):
    """A host (with all its subdomains), how paths begin, and the verdict."""

    host: str
    path: str
    verdict: str


#: The rules of the registered query.
RULES = (
    Rule("com", "/", ALLOW),
    Rule("example.com", "/en/", BLOCK),
    Rule("www.example.com", "/en/", ALLOW),
    Rule("net", "/es/", BLOCK),
    Rule("net", "/fr/", BLOCK),
)

#: Names of labelled hosts: shops, games, advertising and link trade are blocked, people and institutions allowed.
BLOCKED_NAMES = (
    "cheap-watches", "cheap-meds", "pills-shop", "discount-pills", "casino-royal", "online-casino", "win-big", "poker-win", "free-spins", "sports-bets", "bets-today", "betting-tips",
    "adult-videos", "adult-chat", "xxx-adult", "hot-x", "ads-server", "track-ads", "banner-ads", "click-track", "spam-links", "link-farm", "content-farm", "buy-backlinks", "spam-mail",
    "free-iphone", "loan-cheap", "payday-cash", "replica-bags", "popup-ads", "lottery-win", "diet-pills",
)
ALLOWED_NAMES = (
    "library", "museum", "garden", "weather", "history", "university", "physics", "newspaper", "kitchen", "travel", "theatre", "hospital", "cityhall", "astronomy", "orchestra", "railway",
    "school", "geology", "archive", "parliament", "cycling", "forest", "mathematics", "farming", "health", "chess", "painting", "ocean", "language", "engineering", "poetry", "court",
    "north-harbour", "old-town", "open-science", "river-valley", "green-energy", "city-choir", "first-aid", "village-school", "art-history", "sea-birds", "hill-walkers", "bread-baking",
    "house-plans", "winter-sports", "free-software", "public-radio", "book-reviews", "family-tree", "bird-watching", "stone-bridge", "local-history", "night-sky", "water-mill", "clock-maker",
    "carpentry", "mountain-rescue", "grammar", "beekeeping", "sailing-club", "folk-songs", "fire-station", "textiles",
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table: url, block. Schemes, subdomains, domains and paths come in turn for both kinds, so only names tell them apart."""
    rows = []
    for names, block in ((BLOCKED_NAMES, True), (ALLOWED_NAMES, False)):
        for i, name in enumerate(names):
            before, domain, language, end = (("", "www.", "m.", "blog.")[i % 4], ("com", "net", "org")[i % 3], ("en", "de", "fr", "es")[i // 4 % 4], ("", "/", ".html")[i // 2 % 3])
            url = f"http{'s' * (i % 2)}://{before}{name}.example.{domain}/{language}/{i * 37 % 1000}{end}"
            rows.append(F.struct(F.lit(url).alias("url"), F.lit(block).alias("block")))
    return spark.range(1, numPartitions=1).select(F.explode(F.array(*rows)).alias("r")).select("r.url", "r.block")


def host(url: Column) -> Column:
    """From behind the first :// up to a slash, question mark, hash or the end, with A-Z lowered."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct of rule (host and path in one string) and verdict of the longest rule that fits, or null. Of equally long ones the one with the longer host."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def grams(host: Column, path: Column, sizes: Sequence[int] = SIZES) -> Column:
    """All runs of so many characters of the host between marks, and of the path; those of the path carry a mark of their own."""

    def runs(text: Column, n: int, mark: str) -> Column:  # a look-ahead finds overlapping runs in one pass
        found = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        return F.transform(found, lambda g: F.concat(F.lit(mark), g)) if mark else found

    framed = F.concat(F.lit("^"), host, F.lit("$"))
    return F.concat(*[runs(framed, n, "") for n in sizes], *[runs(path, n, " ") for n in sizes])


def hashing() -> HashingTF:
    return HashingTF(inputCol="__grams", outputCol="__features", numFeatures=BUCKETS, binary=True)


def train(labelled: DataFrame, most: int = MOST_LABELLED) -> LogisticRegressionModel:
    """A ridge logistic regression over labelled(url, block); of more than `most` rows those with the smallest hashes of their address."""
    rows = labelled.filter(F.col("block").isNotNull()).select("url", F.col("block").cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(most).withColumn("__grams", grams(host(F.col("url")), path(F.col("url")))).coalesce(1)
    regression = LogisticRegression(featuresCol="__features", labelCol="label", regParam=RIDGE, standardization=False, maxIter=200, tol=1e-9)
    return regression.fit(hashing().transform(rows))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """pages(url) with host, path, rule, score (the model's probability of a blocked address) and verdict."""
    model = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    url = F.col("url").cast("string")
    cut = pages.withColumns({"host": host(url), "path": path(url)})
    ruled = cut.withColumns({"__ruled": matched_rule(F.col("host"), F.col("path"), rules), "__grams": grams(F.col("host"), F.col("path"))})
    model.setFeaturesCol("__features").setProbabilityCol("__probability").setRawPredictionCol("").setPredictionCol("")
    scored = model.transform(hashing().transform(ruled)).withColumn("score", vector_to_array("__probability")[1])
    own = F.when(F.col("score") >= threshold, BLOCK).otherwise(ALLOW)
    judged = scored.withColumns({"rule": F.col("__ruled.rule"), "verdict": F.coalesce(F.col("__ruled.verdict"), own)})
    return judged.drop("__ruled", "__grams", "__features", "__probability")
