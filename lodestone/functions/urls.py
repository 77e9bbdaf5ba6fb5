"""Address columns: domains, links, tracking parameters and what is no content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import lists as L
from lodestone.functions.text import any_of


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def domain(url: Column) -> Column:
    """What lies between the first :// (or the start) and the next slash, without a leading www."""
    return strip_www(F.regexp_extract(url, r"^(?:.*?://)?([^/]*)", 1))


def is_valid(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def resolve(base: Column, link: Column) -> Column:
    """Absolute links stay; rooted ones (also //host ones) go behind the base's host, others behind its last slash."""
    host = F.regexp_extract(base, r"^((?:[^/]*://)?[^/]*)", 1)
    folder = F.when(F.regexp_extract(base, r"^(?:[^/]*://)?[^/]*(/.*)$", 1) != "", F.regexp_extract(base, r"^(.*/)", 1)).otherwise(F.concat(base, F.lit("/")))
    return F.when(is_valid(link), link).when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(folder, link))


def strip_tracking(url: Column) -> Column:
    """Without query parameters that only track; the order of the others stays, a lone ? goes."""
    head, query = F.split_part(url, F.lit("?"), F.lit(1)), F.regexp_extract(url, r"^[^?]*\?(.*)$", 1)
    tracking = any_of([f"{p}=" for p in L.TRACKING_PARAMS], prefix=True)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(tracking)), "&")
    return F.when(~url.contains("?"), url).when(kept == "", head).otherwise(F.concat(head, F.lit("?"), kept))


def is_gov(host: Column) -> Column:
    return host.endswith(".gov") | host.contains(".gov.")


def is_junk_url(url: Column) -> Column:
    return F.lower(url).rlike(any_of(L.JUNK_URL))


def suffixes(host: Column) -> Column:
    """The host and every shorter name that it ends in behind a dot."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def absolute_position(page_index: Column, position: Column) -> Column:
    return page_index * 10 + position


def file_stem(keyword: Column) -> Column:
    """A keyword as a file name: all but letters, digits and hyphens become underscores, none at the end."""
    return F.regexp_replace(F.regexp_replace(keyword, "[^A-Za-z0-9-]", "_"), "_+$", "")
