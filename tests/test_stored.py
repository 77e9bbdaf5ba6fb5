"""Stored tables: buckets, versions, changes that become visible at once."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators.stored import TABLES, StoredTables
from lodestone.streaming import pages

def now():
    return F.to_timestamp(F.lit("2026-01-02 00:00:00"))


def result(url, keyword="k", title="t", position=1):
    return (url, keyword, "d", title, "s", position, 0)


def frame(spark, rows):
    return spark.createDataFrame(rows, "url string, keyword string, domain string, title string, snippet string, serp_position int, serp_page int")


def titles(tables, **how):
    return {(r["url"], r["keyword"]): (r["title"], r["status"]) for r in tables.read("results", **how).collect()}


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    tables = StoredTables(spark, str(tmp_path / "t"), buckets=8)
    assert tables.version() == 0 and tables.read("results").count() == 0
    tables.upsert(frame(spark, [result(f"u{i}") for i in range(40)]), now())
    before = tables.snapshot()["tables"]["results"]
    assert tables.version() == 1 and len(before) == 8 and len(set(before.values())) == 1
    tables.upsert(frame(spark, [result("u3", title="new"), result("u3", "k2")]), now())
    after = tables.snapshot()["tables"]["results"]
    assert sum(after[b] != before[b] for b in after) == 1
    assert sum(1 for p in (tmp_path / "t/results").glob("2-*/*") if p.is_dir()) == 1
    got = titles(tables)
    assert len(got) == 41 and got["u3", "k"] == ("new", "pending") and got["u4", "k"] == ("t", "pending")
    assert [tuple(r) for r in tables.read("history").select("url", "title").collect()] == [("u3", "t")]
    assert len(titles(tables, version=1)) == 40 and tables.read("results", tables.touched(frame(spark, [result("u3")]))).filter("url = 'u3'").count() == 2


def test_a_batch_counts_once(spark, tmp_path):
    tables = StoredTables(spark, str(tmp_path / "t"), buckets=4)
    for batch, title in ((0, "a"), (0, "again"), (1, "b"), (0, "late")):
        tables.upsert(frame(spark, [result("u", title=title)]), now(), batch)
    assert titles(tables) == {("u", "k"): ("b", "pending")} and tables.version() == 2


def test_four_tables_change_at_once(spark, tmp_path):
    tables = StoredTables(spark, str(tmp_path / "t"), buckets=4)
    tables.upsert(frame(spark, [result(f"u{i}") for i in range(12)]), now())
    tables.upsert(frame(spark, [result(f"u{i}", title="changed") for i in range(12)]), now())
    item = "array<struct<tag:string,text:string>>"
    tables.replace_children("headings", spark.createDataFrame([(f"u{i}", "k", [("h2", "one"), ("h3", "two")]) for i in range(12)], f"url string, keyword string, items {item}"), "items", ["tag", "text"])
    tables.replace_children("headings", spark.createDataFrame([("u1", "k", [("h2", "only")])], f"url string, keyword string, items {item}"), "items", ["tag", "text"])
    tables.replace_children("links", spark.createDataFrame([(f"u{i}", "k", [("o", "a")]) for i in range(12)], "url string, keyword string, items array<struct<obl_url:string,anchor_text:string>>"), "items", ["obl_url", "anchor_text"])
    count = lambda **how: {t: tables.read(t, **how).count() for t in TABLES}
    assert count() == {"results": 12, "history": 12, "headings": 23, "links": 12}
    version = tables.version()
    tables.delete(spark.createDataFrame([("u1", "k"), ("u2", "k"), ("u3", "other"), ("absent", "k")], "url string, keyword string"))
    assert count() == {"results": 10, "history": 10, "headings": 20, "links": 10} and tables.version() == version + 1
    assert count(version=version) == {"results": 12, "history": 12, "headings": 23, "links": 12}
    kept = count()
    tables.vacuum()
    assert count() == kept and [p.name for p in (tmp_path / "t/versions").iterdir() if p.suffix == ".json"] == [f"{version + 1}.json"]
    needed = json.loads((tmp_path / f"t/versions/{version + 1}.json").read_text())["tables"]
    assert sum(p.is_dir() for p in (tmp_path / "t/results").glob("*/*")) == len(needed["results"])


def test_a_change_that_fails_is_not_seen(spark, tmp_path):
    tables = StoredTables(spark, str(tmp_path / "t"), buckets=4)
    tables.upsert(frame(spark, [result("u0"), result("u1")]), now())

    def fail(batches):
        raise RuntimeError("died")
        yield from batches

    rows = tables.read("results")
    with pytest.raises(Exception, match="died"):
        tables.commit({"history": tables.read("history"), "results": rows.mapInPandas(fail, rows.schema)}, range(4), 1)
    assert tables.version() == 1 and len(titles(tables)) == 2
    tables.upsert(frame(spark, [result("u2")]), now())  # over what the failed change left
    assert len(titles(tables)) == 3


def test_of_two_writers_one_fails(spark, tmp_path):
    one, two = (StoredTables(spark, str(tmp_path / "t"), buckets=4) for _ in range(2))
    one.upsert(frame(spark, [result("u0")]), now())
    rows = one.read("results")
    two.upsert(frame(spark, [result("u1")]), now())
    with pytest.raises(RuntimeError, match="another change"):
        one.commit({"results": rows}, range(4), 1)
    with pytest.raises(ValueError, match="outside the buckets"):
        one.commit({"results": one.read("results")}, [], 2)
    assert len(titles(one)) == 2 and not list(Path(tmp_path / "t/versions").glob("*.draft"))
    assert one.upsert(frame(spark, []), now()) == one.delete(frame(spark, [])) == 2


def test_a_stream_merges_into_buckets(spark, tmp_path):
    """Two runs of a stream; a batch that is written again after a lost checkpoint changes nothing."""
    tables = StoredTables(spark, str(tmp_path / "t"), buckets=8)
    schema = "url string, keyword string, domain string, title string, snippet string, serp_position int, serp_page int, arrived int"

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        assert pages.merge_into(stream, tables, str(tmp_path / checkpoint)).awaitTermination(120)

    for rows in ([(*result("a", title="old"), 1), (*result("a", title="new"), 2), (*result("b"), 1)], [(*result("a", title="newest"), 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run("check")
    assert titles(tables) == {("a", "k"): ("newest", "pending"), ("b", "k"): ("t", "pending")} and tables.version() == 2
    assert [tuple(r) for r in tables.read("history").select("url", "title").collect()] == [("a", "new")]
    run("other check")  # batches 0 and 1 again
    assert tables.version() == 2
