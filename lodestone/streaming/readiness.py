"""Analysis of a keyword when its last page has arrived, with one more try if none of its pages has content.

The state of a keyword is the set of addresses that have arrived, with their word counts, and how often it was tried: a few
numbers a page, no texts. When all addresses of the bridge are there, the keyword is ready if a page has enough words. Else its
pages are asked for again, the state is emptied and a timer is set; when they have come without content, or the timer fires, the
keyword is skipped (or ready with the pages that did come). Time is that of the arrivals: a timer fires with the first batch
after one that had an arrival so much later. A page that arrives twice counts once, with its larger word count;
what arrives after the end of a keyword changes nothing. Pages without a keyword are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodestone.plans.analysis import Options, analyze
from lodestone.storage import materialise

READY, RETRY, SKIPPED = "ready", "retry", "skipped"
OUTCOME = "keyword string, url string, page_id long, outcome string, tries int"
ARRIVAL = "url string, page_id long, word_count long, arrived timestamp"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Readiness(StatefulProcessor):
    def __init__(self, least_words: int, retries: int, wait_ms: int):
        self.least_words, self.retries, self.wait_ms = least_words, retries, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "url string", "page_id long, word_count long")
        self.run = handle.getValueState("run", "tries int, done boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        tries, done = self.run.get() if self.run.exists() else (0, False)
        expected = latest = 0
        for r in rows:
            expected, latest = r["expected"], max(latest, r["at"])
            if done:
                continue
            words = r["word_count"] or 0
            if not self.pages.containsKey((r["url"],)) or self.pages.getValue((r["url"],))[1] < words:
                self.pages.updateValue((r["url"],), (r["page_id"], words))
        if not done:
            held = self.held()
            if len(held) >= expected:
                yield from self.end(key[0], held, tries, latest, tries >= self.retries)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        tries, done = self.run.get() if self.run.exists() else (0, False)
        if not done:
            yield from self.end(key[0], self.held() or [(None, None, 0)], tries, 0, True)

    def held(self) -> list[tuple]:
        return sorted((k[0], v[0], v[1]) for k, v in self.pages.iterator())

    def end(self, keyword: str, held: list[tuple], tries: int, at: int, last: bool) -> Iterator[Row]:
        good = any(words > self.least_words for _, _, words in held)
        outcome = READY if good else SKIPPED if last else RETRY
        self.pages.clear()
        self.run.update((tries + (outcome == RETRY), outcome != RETRY))
        if outcome == RETRY:
            self.handle.registerTimer(at + self.wait_ms)
        for url, page_id, _ in held:
            yield Row(keyword=keyword, url=url, page_id=page_id, outcome=outcome, tries=tries + 1)

    def close(self) -> None:
        pass


def outcomes(arrivals: DataFrame, bridge: DataFrame, least_words: int = 50, retries: int = 1, wait_ms: int = 60_000) -> DataFrame:
    """OUTCOME rows of a stream of arrivals(ARRIVAL), one for each page of a keyword that ended; bridge(keyword, url) is a table.

    Arrivals from before the latest one of an earlier batch are too late and left out, so `arrived` is best the time of reading.
    """
    links = bridge.select("keyword", "url").distinct()
    counts = links.groupBy("keyword").agg(F.count(F.lit(1)).alias("expected"))
    timed = arrivals.withWatermark("arrived", "0 seconds").withColumn("at", F.unix_millis("arrived"))
    rows = timed.join(links.join(counts, "keyword"), "url").select("keyword", "url", "page_id", "word_count", "expected", "arrived", "at")
    return rows.groupBy("keyword").transformWithState(Readiness(least_words, retries, wait_ms), OUTCOME, "Append", "EventTime")


def analyze_when_ready(
    spark: SparkSession, parsed_path: str, bridge: DataFrame, write: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, options: Options = Options(), wait_ms: int = 60_000, files_per_batch: int = 64,
) -> StreamingQuery:
    """Follow the parsed pages under parsed_path (see pages.parse_arrivals) and analyse the keywords that become ready.

    write takes the analyses, the outcomes (of retried and skipped keywords too) and the batch number, by which it tells a
    repeated batch. Asks for the RocksDB state store in this session.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    stored = spark.read.parquet(parsed_path)
    arrivals = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", files_per_batch).parquet(parsed_path)
    arrivals = arrivals.select("url", "page_id", F.col("word_count").cast("long").alias("word_count"), F.current_timestamp().alias("arrived"))

    def finish(batch: DataFrame, number: int) -> None:
        ended = materialise(batch, "outcomes")  # once: the batch has state
        ready = ended.filter(F.col("outcome") == READY).select("keyword", "url").distinct()
        latest = spark.read.parquet(parsed_path).groupBy("url").agg(F.max_by(F.struct(*stored.columns), F.struct("word_count", "page_id")).alias("page")).select("page.*")
        write(analyze(latest.join(ready, "url"), options=options), ended, number)

    return outcomes(arrivals, bridge, wait_ms=wait_ms).writeStream.foreachBatch(finish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
