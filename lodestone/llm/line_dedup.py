"""Removal of lines that many sites share.

Lines are trimmed of spaces, tabs and carriage returns; empty ones never go. For each line's 128-bit hash, tasks sketch
the sites that they see (HyperLogLog), so that a frequent line is one row for each task before the shuffle, and the
sketches merge by aggregation. Lines of one site, by minimum and maximum, are done. Estimates far from the
threshold decide; near it, the distinct sites are counted exactly. A document is put together
again from the lines that stay.

Null text has no lines and stays null, with the digest of nothing; a null site is no site. Rows that repeat a doc_id
and text are treated alike. Other columns pass `dedup_lines`, but n_lines and n_removed are its own. An empty table gives
an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.storage import materialise

MIN_SITES = 5
LG_K = 10
#: Standard errors of a sketch within which sites are counted exactly.
SIGMAS = 5.0
BLANKS = " \t\r"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_hashes(docs: DataFrame, site: str) -> DataFrame:
    """doc_id, text_hash, pos, h1, h2, site of every line that is not empty."""
    lines = docs.filter(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.col(site).cast("string").alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    line = trimmed(F.col("line"))
    return lines.filter(line != "").select("doc_id", "text_hash", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"), "site")


def widespread_lines(hashes: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 of the lines with min_sites distinct sites at least."""
    sited = hashes.filter(F.col("site").isNotNull()).select("h1", "h2", "site")
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K)))
    merged = sited.groupBy("h1", "h2").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), sketch.alias("sites"))
    sketches = merged.filter("lo < hi" if min_sites > 1 else "true").select("h1", "h2", "sites")
    sketches = materialise(sketches, "line-sites")
    band = SIGMAS * 1.04 / math.sqrt(2**LG_K)
    low, high = math.floor(min_sites * (1 - band)) - 1, math.ceil(min_sites * (1 + band)) + 1
    near = sketches.filter((F.col("sites") >= low) & (F.col("sites") <= high)).select("h1", "h2")
    exact = sited.join(near, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").count().filter(F.col("count") >= min_sites)
    return sketches.filter(F.col("sites") > high).select("h1", "h2").unionByName(exact.select("h1", "h2"))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with the text left, and n_lines, n_removed as further columns (instead of columns of those names)."""
    hashes = materialise(line_hashes(docs, site), "line-hashes")
    gone = hashes.join(widespread_lines(hashes, min_sites), ["h1", "h2"], "left_semi")
    per_doc = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text"), "gone")
    text, own = docs["text"], per_doc["gone"]  # by table: docs may have columns of any name
    same = docs["doc_id"].eqNullSafe(per_doc["gone_id"]) & (F.xxhash64(text) == per_doc["gone_text"])
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), own)
    left = F.when(own.isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(own.isNull(), 0).otherwise(F.size(own)).cast("long")
    passing = [left.alias(c) if c == "text" else docs[c] for c in docs.columns if c not in ("n_lines", "n_removed")]
    return docs.join(per_doc, same, "left").select(*passing, n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def line_dedup_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 for every row of docs."""
    out = dedup_lines(docs.select("doc_id", "text", "source"), **options)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
