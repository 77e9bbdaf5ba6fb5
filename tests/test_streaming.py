from pyspark.sql import functions as F

from lodestone.operators import store
from lodestone.streaming import pages


def test_pages_are_parsed_once(spark, small, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = spark.read.parquet(f"{small}/pages.parquet")
    rows.filter("page_id < 20").write.parquet(source)
    pages.parse_arrivals(spark, source, sink, check).awaitTermination()
    rows.filter("page_id >= 20").write.mode("append").parquet(source)
    pages.parse_arrivals(spark, source, sink, check).awaitTermination()
    assert spark.read.parquet(sink).count() == rows.count() == spark.read.parquet(sink).select("page_id").distinct().count()


def test_results_merge(spark, tmp_path):
    schema = "url string, keyword string, domain string, title string, snippet string, serp_position int, serp_page int, status string, created_at timestamp"
    held = {"table": spark.createDataFrame([], schema), "history": 0, "batches": set()}

    def write(table, history, number):
        if number not in held["batches"]:
            held["history"] += history.count()
            held["table"] = spark.createDataFrame(table.collect(), table.schema)
            held["batches"].add(number)

    new = spark.createDataFrame([("u", "k", "d", "one", "s", 1, 0, 1), ("u", "k", "d", "two", "s", 2, 0, 2)], "url string, keyword string, domain string, title string, snippet string, serp_position int, serp_page int, arrived int")
    for n in range(2):
        new.withColumn("title", F.concat("title", F.lit(str(n)))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
        pages.merge_results(stream, lambda: held["table"], write, str(tmp_path / "check")).awaitTermination()
    assert [(r["title"], r["status"]) for r in held["table"].collect()] == [("two1", "pending")] and held["history"] == 1
    assert store.count_pending(held["table"]).first()["n_pending"] == 1


def test_event_windows_stream(spark, small, tmp_path):
    table = spark.read.parquet(f"{small}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = pages.event_windows(stream).writeStream.format("memory").queryName("event_windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("event_windows").agg(F.sum("n")).first()[0] == table.count()


def test_keywords_become_ready(spark, tmp_path):
    held = {"queue": [("a", "pending"), ("b", "pending"), ("c", "scraped")], "ready": [], "batches": set()}
    bridge = spark.createDataFrame([("k1", "a"), ("k1", "c"), ("k2", "a"), ("k2", "b"), ("k3", "c")], "keyword string, url string")

    def write(queue, ready, number):
        if number not in held["batches"]:
            held["ready"].append(sorted(r["keyword"] for r in ready.collect()))
            held["queue"] = [tuple(r) for r in queue.collect()]
            held["batches"].add(number)

    schema = "url string, status string, arrived int"
    for rows in ([("a", "failed", 2), ("a", "pending", 1)], [("b", "scraped", 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        pages.watch_ready(stream, bridge, lambda: spark.createDataFrame(held["queue"], "url string, status string"), write, str(tmp_path / "check")).awaitTermination()
    assert held["ready"] == [["k1"], ["k2"]] and dict(held["queue"]) == {"a": "failed", "b": "scraped", "c": "scraped"}
