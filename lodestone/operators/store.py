"""The stored tables as DataFrames: scans, upserts with history, replacement of children, deletion.

Every function takes tables and returns the new ones; the caller writes them. Keys are (url, keyword) unless given.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("url", "keyword")
#: What a new search result brings; the rest of a stored row stays.
RESULT_FIELDS = ("domain", "title", "snippet", "serp_position", "serp_page")


def lookup(table: DataFrame, **keys) -> DataFrame:
    """Rows with the given values; the predicate reaches the scan."""
    out = table
    for name, value in keys.items():
        out = out.filter(F.col(name) == F.lit(value))
    return out


def sessions_by_date(sessions: DataFrame, most: int | None = None) -> DataFrame:
    """keyword, updated_at, updated (to the minute), the latest first."""
    rows = sessions.select("keyword", "updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm").alias("updated")).orderBy(F.desc("updated_at"), "keyword")
    return rows.limit(most) if most is not None else rows


def pending(queue: DataFrame, most: int) -> DataFrame:
    """The oldest pending rows."""
    return queue.filter(F.col("status") == "pending").orderBy("created_at", *KEY).limit(most)


def pending_by_keyword(queue: DataFrame, most: int) -> DataFrame:
    rows = queue.filter(F.col("status") == "pending").select("url", "keyword", *[F.coalesce(c, F.lit("")).alias(c) for c in ("domain", "title")], F.coalesce("serp_position", F.lit(0)).alias("serp_position"))
    return rows.orderBy("keyword", "serp_position", "url").limit(most)


def count_pending(queue: DataFrame) -> DataFrame:
    return queue.filter(F.col("status") == "pending").agg(F.count(F.lit(1)).alias("n_pending"))


def results(queue: DataFrame, keyword: str | None = None) -> DataFrame:
    """Scraped and failed rows by keyword, crawled ones last, by position."""
    rows = queue.filter(F.col("status").isin("scraped", "failed"))
    rows = rows if keyword is None else lookup(rows, keyword=keyword)
    return rows.orderBy("keyword", "is_crawled", "serp_position", "url")


def children(table: DataFrame, order: str = "ordinal", **keys) -> DataFrame:
    return lookup(table, **keys).orderBy(order)


def _latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("nth = 1").drop("nth")


def upsert_results(stored: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The table with new results merged in, and the history rows of those whose position or title changed.

    stored has KEY, RESULT_FIELDS, status and created_at; new has KEY and RESULT_FIELDS, one row for each key. One full
    outer join serves both.
    """
    old = stored.select(*[F.col(c).alias(f"old_{c}") for c in stored.columns])
    same = [new[k] == old[f"old_{k}"] for k in KEY]
    joined = new.withColumn("is_new", F.lit(True)).join(old, same, "full_outer")
    fresh = F.col("is_new").isNotNull()
    kept = {"status": F.lit("pending"), "created_at": now}
    columns = []
    for c in stored.columns:
        if c in KEY:
            columns.append(F.coalesce(new[c], F.col(f"old_{c}")).alias(c))
        elif c in RESULT_FIELDS:
            columns.append(F.when(fresh, new[c]).otherwise(F.col(f"old_{c}")).alias(c))
        else:
            missing = F.col("old_url").isNull()
            columns.append(F.when(missing, kept.get(c, F.lit(None).cast(stored.schema[c].dataType))).otherwise(F.col(f"old_{c}")).alias(c))
    changed = fresh & F.col("old_url").isNotNull() & (~new["serp_position"].eqNullSafe(F.col("old_serp_position")) | ~new["title"].eqNullSafe(F.col("old_title")))
    history = joined.filter(changed).select(*[F.col(f"old_{k}").alias(k) for k in KEY], F.col("old_serp_position").alias("serp_position"), F.col("old_title").alias("title"), now.alias("recorded_at"))
    return joined.select(*columns), history


def replace_rows(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows take the place of stored ones with their keys; nothing of the old row stays."""
    return stored.join(new.select(*keys), list(keys), "left_anti").select(*stored.columns).unionByName(new)


def insert_missing(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """New rows whose keys aren't stored, the first of each by order."""
    fresh = _latest(new, keys, [F.asc(o) for o in order]).select(*stored.columns)
    return stored.unionByName(fresh.join(stored.select(*keys), list(keys), "left_anti").select(*stored.columns))


def update_scraped(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Status and counts of updates(KEY, status, word_count, is_crawled, source_url); is_crawled and source_url only if set."""
    new = updates.select(*[F.col(c).alias(f"new_{c}") for c in updates.columns])
    joined = stored.join(new, [stored[k] == new[f"new_{k}"] for k in KEY], "left")
    hit = F.col("new_url").isNotNull()
    values = {
        "status": F.when(hit, F.col("new_status")).otherwise(stored["status"]),
        "word_count": F.when(hit, F.col("new_word_count")).otherwise(stored["word_count"]),
        "is_crawled": F.when(F.coalesce("new_is_crawled", F.lit(0)) != 0, F.col("new_is_crawled")).otherwise(stored["is_crawled"]),
        "source_url": F.when(F.coalesce("new_source_url", F.lit("")) != "", F.col("new_source_url")).otherwise(stored["source_url"]),
    }
    return joined.select(*[values.get(c, stored[c]).alias(c) for c in stored.columns])


def delete_rows(stored: DataFrame, gone: DataFrame, keys: Sequence[str], status: str | None = None) -> DataFrame:
    """Without the rows of gone's keys; with status, only rows of that status go."""
    rows = gone.select(*keys).distinct()
    if status is not None:
        rows = rows.join(stored.filter(F.col("status") == status).select(*keys).distinct(), list(keys), "left_semi")
        kept = stored.filter(F.col("status") != status)
        return kept.unionByName(stored.filter(F.col("status") == status).join(rows, list(keys), "left_anti").select(*stored.columns))
    return stored.join(rows, list(keys), "left_anti").select(*stored.columns)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without what belongs to gone(url, keyword); links are found by source_url."""
    out = {}
    for name, table in tables.items():
        keys = [("source_url" if "url" not in table.columns else "url"), "keyword"]
        own = gone.select(F.col("url").alias(keys[0]), "keyword")
        out[name] = delete_rows(table, own, keys)
    return out


def replace_children(stored: DataFrame, parents: DataFrame, items: str, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The child table with the children of parents(keys, items: array of structs) in place of their old ones."""
    rows = parents.select(*keys, F.posexplode(items).alias("ordinal", "item")).select(*keys, "ordinal", *[F.col(f"item.{f}").alias(f) for f in fields])
    return stored.join(parents.select(*keys).distinct(), list(keys), "left_anti").select(*keys, "ordinal", *fields).unionByName(rows)


def position_changes(positions: DataFrame) -> DataFrame:
    """positions(keyword, domain, position, checked_at) with the position before and the change."""
    window = Window.partitionBy("keyword", "domain").orderBy("checked_at")
    return positions.withColumn("previous", F.lag("position").over(window)).withColumn("change", F.col("position") - F.col("previous"))


def arrange_results(rows: DataFrame) -> DataFrame:
    """Search results, each followed by the pages crawled from it (latest first); then pages without a parent.

    rows has url, source_url, is_crawled and place; the result has parent_place, is_child and order.
    """
    parents = rows.filter(F.col("is_crawled") == 0).groupBy(F.col("url").alias("parent_url")).agg(F.min("place").alias("parent_place"))
    joined = rows.join(parents, (rows["is_crawled"] != 0) & (rows["source_url"] == parents["parent_url"]), "left")
    child = F.col("parent_url").isNotNull()
    orphan = (F.col("is_crawled") != 0) & ~child
    out = joined.select(*rows.columns, F.when(child, F.col("parent_place")).otherwise(F.col("place")).alias("parent_place"), child.cast("int").alias("is_child"), orphan.alias("is_orphan"))
    return out.orderBy("is_orphan", "parent_place", "is_child", F.when(F.col("is_child") == 1, -F.col("place")).otherwise(F.col("place")))


def page_detail(parents: DataFrame, headings: DataFrame, links: DataFrame, keywords: DataFrame) -> DataFrame:
    """Each parent row with its headings, at most 100 links and 30 page keywords, all in order."""

    def gathered(table: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str, most: int | None = None) -> DataFrame:
        if most is not None:  # before anything is collected
            table = table.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal", *fields))).filter(F.col("nth") <= most)
        return table.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ordinal", *fields))).alias(name))

    out = parents.join(gathered(headings, KEY, ["tag", "text"], "headings"), list(KEY), "left")
    own_links = gathered(links.withColumnRenamed("source_url", "url"), KEY, ["obl_url"], "links", 100)
    return out.join(own_links, list(KEY), "left").join(gathered(keywords, KEY, ["page_keyword"], "page_keywords", 30), list(KEY), "left")


def purge(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The same tables without rows; the caller writes them over the stored ones."""
    return {name: table.filter(F.lit(False)) for name, table in tables.items()}


def migrate_settings(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new table with the old settings(key, value) that it lacks, and what is left of the old one: nothing, if any row moved."""
    whole = old.filter(F.col("key").isNotNull() & F.col("value").isNotNull()).select("key", "value")
    return insert_missing(new.select("key", "value"), whole, ["key"], ["value"]), old.join(whole.limit(1).select(F.lit(1).alias("moved")), F.lit(True), "left_anti")


LEVELS = ("debug", "info", "warn", "error")


def log_tail(entries: DataFrame, last_seq: int, shown: Sequence[str] = LEVELS[1:], most: int = 100) -> DataFrame:
    """seq, line of the entries(seq, at, level, message) after last_seq among the newest ones, of the levels shown."""
    newest = entries.orderBy(F.desc("seq")).limit(most).filter((F.col("seq") > last_seq) & F.col("level").isin(*shown))
    mark = F.coalesce(*[F.when(F.col("level") == name, tag) for name, tag in (("debug", "DBG "), ("warn", "WARN"), ("error", "ERR "))], F.lit("INFO"))
    at = F.coalesce(F.date_format("at", "HH:mm:ss"), F.lit("??:??:??"))
    return newest.select("seq", F.concat(F.lit("["), at, F.lit("] "), mark, F.lit("  "), "message").alias("line"))
