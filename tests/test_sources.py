"""Named files, captured responses and line numbers."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.plans import queries, reports
from lodestone.sources import captured, named_files, search


def listing(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_files_have_their_names(spark, tmp_path):
    rows = [(f"k{i % 7}/f {i}.txt", "é\n" * i) for i in range(50)] + [("top", None), ("a/b/c/d.md", "x")]
    named_files.write_named_files(spark.createDataFrame(rows, named_files.SCHEMA).repartition(6), str(tmp_path / "out"))
    assert listing(tmp_path / "out") == sorted(n for n, _ in rows)
    assert all((tmp_path / "out" / n).read_text() == (c or "") for n, c in rows)
    assert [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith(".")] == []


def test_files_that_are_there(spark, tmp_path):
    path = str(tmp_path / "out")
    write = lambda rows, **o: named_files.write_named_files(spark.createDataFrame(rows, named_files.SCHEMA), path, **o)
    write([("a", "1"), ("b", "2")])
    with pytest.raises(Exception, match="one name"):
        write([("c", "9"), ("b", "9")])
    with pytest.raises(Exception, match="one name"):
        write([("c", "9"), ("c", "8")])
    assert listing(path) == ["a", "b"]
    write([("b", "3"), ("c", "4")], overwrite=True)
    assert {n: Path(path, n).read_text() for n in listing(path)} == {"a": "1", "b": "3", "c": "4"}
    write([])
    assert listing(path) == ["a", "b", "c"]


@pytest.mark.parametrize("name", [None, "", "/abs", "a//b", "../up", "a/./b", "a/"])
def test_names_stay_below_the_folder(spark, tmp_path, name):
    rows = spark.createDataFrame([("fine", "x"), (name, "y")], named_files.SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="relative file name"):
        named_files.write_named_files(rows, str(tmp_path / "out"))
    assert listing(tmp_path) == []


def test_a_task_that_dies_leaves_no_file(spark, tmp_path):
    """Tasks write some files before one of them fails, slowly enough for the others to have begun."""

    def fail(batches):
        for b in batches:
            yield b.head(3)
            time.sleep(1)
            if b["name"].str.contains("39").any():
                raise RuntimeError("died")
            yield b.tail(len(b) - 3)

    rows = spark.range(40).repartitionByRange(4, "id").select(F.concat(F.lit("d/"), "id").alias("name"), F.repeat(F.lit("x"), 1000).alias("content"))
    with pytest.raises(Exception, match="died"):
        named_files.write_named_files(rows.mapInPandas(fail, named_files.SCHEMA), str(tmp_path / "out"))
    assert listing(tmp_path) == []


def test_exports_have_the_names_of_their_keywords(spark, tmp_path):
    analyses = queries.literal_analyses(spark)
    reports.write_exports(analyses, str(tmp_path / "out"))
    want = {}
    for kind, ending in (("json", "json"), ("markdown", "md"), ("text", "txt")):
        for r in reports.render_all(analyses, kind).collect():
            stem = "".join(c if c.isascii() and (c.isalnum() or c == "-") else "_" for c in r["keyword"]).rstrip("_")
            want[f"{stem}/{stem}.{ending}"] = r["report"]
    assert {n: (tmp_path / "out" / n).read_text() for n in listing(tmp_path / "out")} == want and len(want) >= 6
    reports.write_exports(analyses, str(tmp_path / "out"))  # again, over the old ones


def page(*links, **more):
    return json.dumps({"organic": [{"link": x} for x in links], **more})


@pytest.fixture
def capture(spark, tmp_path):
    files = {
        ("plain", 1): page("a"), ("plain", 2): page("b", "c"), ("ends early", 1): page("d"), ("ends early", 2): page(peopleAlsoAsk=[{"question": "q"}]), ("ends early", 3): page("never"),
        ("ü/*.~ +%", 1): page("e"), ("gap", 1): page("f"), ("gap", 3): page("never"), ("broken", 1): page("g"), ("broken", 2): "{", ("broken", 3): page("never"), ("list", 1): "[1]", ("no list", 1): '{"organic":{"a":1}}', (".dot", 1): page("h"), ("..", 1): page("i"),
    }
    rows = spark.createDataFrame([(k, p, b) for (k, p), b in files.items()], "keyword string, page int, body string")
    named_files.write_named_files(rows.select(captured.file_name(F.col("keyword"), F.col("page")).alias("name"), F.col("body").alias("content")), str(tmp_path / "c"))
    return str(tmp_path / "c"), files


def read(rows):
    return sorted((r["keyword"], r["page"]) for r in rows.collect())


def test_pages_are_read_up_to_the_first_without_results(spark, capture):
    path, files = capture
    rows = captured.read_captured(spark, path)
    want = sorted([("plain", 1), ("plain", 2), ("ends early", 1), ("ends early", 2), ("ü/*.~ +%", 1), ("gap", 1), ("broken", 1), ("no list", 1), (".dot", 1), ("..", 1)])
    assert read(rows) == want
    assert all(files[r["keyword"], r["page"]] == r["body"] for r in rows.collect())
    assert rows.rdd.getNumPartitions() == len({k for k, _ in files}) and captured.read_captured(spark, path, keywords_per_partition=4).rdd.getNumPartitions() == 3
    assert read(captured.read_captured(spark, path, pages=1)) == sorted(k for k in want if k[1] == 1)
    assert search.organic_results(search.parse_responses(rows)).count() == 9


def test_keyword_filters_choose_partitions(spark, capture):
    path, _ = capture
    rows = captured.read_captured(spark, path)
    one = rows.filter("keyword = 'plain' AND page > 1")
    assert read(one) == [("plain", 2)] and one.rdd.getNumPartitions() == 1
    two = rows.filter(F.col("keyword").isin("plain", "ü/*.~ +%", "absent"))
    assert read(two) == [("plain", 1), ("plain", 2), ("ü/*.~ +%", 1)] and two.rdd.getNumPartitions() == 2
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter" in line and "PushedFilters" not in line]
    assert "BatchScan" in plan and "plain" not in "".join(filters)  # the source has taken it
    assert read(rows.filter("keyword = 'absent'")) == [] == read(rows.filter("keyword = 'plain' AND keyword = 'gap'"))


def test_no_files(spark, tmp_path):
    assert captured.read_captured(spark, str(tmp_path / "none")).count() == 0


def test_lines_are_numbered_over_splits(spark, tmp_path):
    """Files of several splits each; one has no line feed at its end, one is empty."""
    texts = {"a.txt": "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(5000)), "b.txt": "", "c.txt": "\r\n\nlast", "d.txt": "".join(f"ü{i}\r\n" for i in range(3000))}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    want = [(n, line.rstrip("\r")) for n in sorted(texts) for line in (texts[n].removesuffix("\n").split("\n") if texts[n] else [])]
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for size in ("4096", "1000", "134217728"):
            spark.conf.set(names[0], size)
            spark.conf.set(names[1], "10")
            rows = search.numbered_lines(spark, str(tmp_path))
            got = sorted((r["nth"], Path(r["file"]).name, r["value"]) for r in rows.collect())
            assert [n for n, _, _ in got] == list(range(1, len(want) + 1)) and [(f, v) for _, f, v in got] == want
            assert size != "4096" or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "words").write_text("the 9\nno\nof 8\nThe 7\n")
    assert sorted(tuple(r) for r in search.read_frequency_table(spark, str(tmp_path / "f")).collect()) == [("of", 2), ("the", 3)]
