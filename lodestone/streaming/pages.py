"""Streaming: pages are parsed as they arrive, results merge into the stored table, keywords become ready."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import extract, store
from lodestone.operators.stored import StoredTables

PAGES = "page_id long, url string, html string"


def parse_arrivals(spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_batch: int = 64) -> StreamingQuery:
    """Parse new Parquet files of pages under source into sink, exactly once; the sink is a file table with a commit log."""
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    parsed = extract.with_flags(extract.parse_pages(pages))
    return parsed.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_results(arrivals: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Merge a stream of search results into the stored table, with history.

    read gives the stored table; write takes the new table, the history rows and the batch number, by which it tells a
    repeated batch.
    """

    def merge(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(*store.KEY).agg(F.max_by(F.struct(*store.RESULT_FIELDS), "arrived").alias("r")).select(*store.KEY, "r.*")
        table, history = store.upsert_results(read(), newest, F.current_timestamp())
        write(table, history, number)

    return arrivals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_into(arrivals: DataFrame, tables: StoredTables, checkpoint: str) -> StreamingQuery:
    """Merge a stream of search results (as merge_results takes them) into stored tables, with history.

    A batch reads and rewrites the buckets of its addresses only; one that is repeated after a restart changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(*store.KEY).agg(F.max_by(F.struct(*store.RESULT_FIELDS), "arrived").alias("r")).select(*store.KEY, "r.*")
        tables.upsert(newest, F.current_timestamp(), number)

    return arrivals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ready_keywords(bridge: DataFrame, queue: DataFrame) -> DataFrame:
    """Keywords whose pages have all been scraped or given up."""
    joined = bridge.select("keyword", "url").distinct().join(queue.select("url", "status").distinct(), "url", "left")
    done = F.count_if(F.coalesce(F.col("status"), F.lit("pending")).isin("scraped", "failed"))
    return joined.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"), done.alias("done")).filter("n = done").select("keyword")


def watch_ready(arrivals: DataFrame, bridge: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Merge a stream of states(url, status, arrived) into the stored queue(url, status); tell which keywords became ready.

    read gives the stored queue; write takes the new one, the keywords that are ready now and were not before, and the
    batch number, by which it tells a repeated batch.
    """

    def merge(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("url").agg(F.max_by("status", "arrived").alias("status"))
        before = read().select("url", "status")
        after = before.join(newest, "url", "left_anti").unionByName(newest)
        write(after, ready_keywords(bridge, after).join(ready_keywords(bridge, before), "keyword", "left_anti"), number)

    return arrivals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of tumbling windows; works on streams (with a watermark) and tables alike."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    grouped = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")
