"""Headings keep their whole text, however long the line is."""

import random

from pyspark.sql import functions as F

from lodestone.operators import containment, headings
from lodestone.plans.analysis import Options, analyze
from lodestone.plans.queries import QUERIES


def long_documents(spark, tmp_path) -> str:
    line = "what a runner needs to know " * 40
    text = "\n".join([line + "at first", line + "at last", "word " * 100])
    spark.createDataFrame([("s", 1, text)], "source string, doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return text


def test_admission_keeps_whole_lines(spark, tmp_path):
    text = long_documents(spark, tmp_path)
    got = QUERIES["heading_admission"](spark, str(tmp_path)).orderBy("nth").collect()
    assert [r["text"] for r in got] == text.split("\n")


def test_patterns_of_long_headings_differ(spark, tmp_path):
    text = long_documents(spark, tmp_path)
    got = QUERIES["heading_patterns_exact"](spark, str(tmp_path)).collect()
    assert {(r["text"], r["count"]) for r in got} == {(x, 1) for x in text.split("\n")}


def test_long_sentences_are_no_headings(spark, tmp_path):
    """Their last character decides; cut at 510 bytes they would have passed for headings."""
    line = "what a runner needs to know " * 40
    text = "\n".join([line + "at last", line + "at last.", "word " * 100])
    spark.createDataFrame([("s", 1, text)], "source string, doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["heading_patterns_exact"](spark, str(tmp_path)).collect()
    assert {r["text"] for r in got} == {line + "at last", "word " * 100}


def test_patterns_beyond_a_hundred(spark, monkeypatch):
    """Headings looked up in each other give the patterns of the fold without its limit, also of groups dealt over shards."""
    draw = random.Random(4)
    rows = []
    for group in ("a", "b", None):
        for page in range(120):
            for nth in range(draw.randrange(9)):
                text = " ".join(draw.choice(["How", "to", "run", "Fast", "shoes"]) for _ in range(draw.randrange(1, 7)))
                rows.append((group, page, nth, draw.choice(["h2", "h3"]), draw.choice([text, f"{text} {draw.randrange(400)}", None if page % 40 == 0 else ""])))
    shown = spark.createDataFrame(rows, "keyword string, page long, nth int, tag string, text string")
    columns = ["keyword", "tag", "text", "count", "first_seen"]
    plain = lambda df: {tuple(r) for r in df.select(*columns).collect()}
    monkeypatch.setattr(containment, "SHARD", 50)
    want = plain(headings.heading_clusters(shown, ["keyword"], 1 << 60))
    assert plain(headings.all_clusters(shown, ["keyword"])) == want and max(r[4] for r in want) > 100


def test_whole_analyses_have_all_patterns(spark):
    words = "the shoes that runners like are light and they have a soft sole which is good for long runs on roads and trails "
    of = lambda page: [("h2", f"Cushioning for {page} long {n} runs", 2) for n in range(5)]
    rows = [("shoes", p, words * 6, 120, 5, 0, 0, 5, 3, False, of(p)) for p in range(60)]
    pages = spark.createDataFrame(rows, "keyword string, page_id long, page_text string, word_count int, h2 int, h3 int, outbound int, n_headings int, p_tags int, non_article boolean, headings array<struct<tag:string,text:string,level:int>>").withColumn("internal", F.lit(0))
    sizes = [analyze(pages, options=Options(whole=w)).select(F.size("headings")).first()[0] for w in (False, True)]
    assert sizes == [100, 300]
