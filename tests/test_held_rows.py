"""Tasks hold few pages and analyses, however many rows a batch has."""

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import extract
from lodestone.plans import reports
from lodestone.plans.queries import literal_analyses


def handed_on(monkeypatch, df, make):
    """The function that make hands to Spark over df."""
    seen = []
    plain = type(df).mapInArrow

    def watched(self, f, schema, *more, **named):
        seen.append(f)
        return plain(self, f, schema, *more, **named)

    monkeypatch.setattr(type(df), "mapInArrow", watched)
    make(df)
    return seen[0]


def test_pages_are_parsed_in_pieces(spark, monkeypatch):
    pages = spark.range(3).select(F.col("id").alias("page_id"), F.lit("https://a.com/").alias("url"), F.lit("<p>x</p>").alias("html"))
    run = handed_on(monkeypatch, pages, extract.parse_pages)
    n = 4 * extract.PAGES_HELD + 1
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "url": ["https://a.com/"] * n, "html": ["<h1>A&ampB</h1><a href='/x'>l</a>"] * n, "binary": [False] * n})
    out = list(run(iter([batch])))
    assert max(b.num_rows for b in out) <= extract.PAGES_HELD
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["page_id"] for r in rows] == list(range(n))
    assert rows[-1]["headings"] == [{"tag": "h1", "text": "A&B", "level": 1}] and rows[-1]["links"] == [{"url": "https://a.com/x", "text": "l", "is_outbound": False}]


def test_reports_are_made_in_pieces(spark, monkeypatch):
    analyses = literal_analyses(spark)
    run = handed_on(monkeypatch, analyses, lambda df: reports.render_all(df, "keywords"))
    whole = analyses.toArrow().combine_chunks()
    batch = pa.concat_tables([whole] * 50).combine_chunks().to_batches()[0]
    out = list(run(iter([batch])))
    assert max(b.num_rows for b in out) <= 8 and sum(b.num_rows for b in out) == batch.num_rows
