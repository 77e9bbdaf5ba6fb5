import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import urls as U
from lodestone.functions import vectors as V
from lodestone.operators import corpus, extract, filters, headings, intent, keywords, store
from lodestone.plans import reports
from lodestone.sources import search

SHOES = [
    "best running shoes for marathon training nike adidas", "running shoes review nike brooks cushioning", "marathon running tips and training plan for shoes",
    "adidas running shoe technology and brooks stability", "trail running shoes guide",
]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://www.example.com/page", "example.com"), ("https://api.example.com/v1", "api.example.com"), ("x.org:80?q", "x.org:80?q"), ("", "")],
)
def test_domain(spark, url, want):
    assert one(spark, U.domain(F.col("u")), u=url) == want


def test_tracking(spark):
    assert one(spark, U.strip_tracking(F.col("u")), u="https://a.com/?q=test&utm_source=google&fbclid=abc") == "https://a.com/?q=test"
    assert one(spark, U.strip_tracking(F.col("u")), u="https://a.com/?utm_source=x") == "https://a.com/"


def test_tfidf(spark):
    docs = spark.createDataFrame([("k", i, t) for i, t in enumerate(SHOES)], "g string, doc_id int, text string")
    tokens = corpus.tokenize(docs, ["g"])
    found = {r["word"]: r for r in corpus.tfidf_keywords(tokens, ["g"], 20).collect()}
    assert "running" not in found  # in all documents
    assert found["nike"]["score"] == pytest.approx(math.log(3) * 2 * math.log(2.5))
    assert found["shoes"]["df"] == 4


def test_intent(spark):
    rows = [("best running shoes", 1, "We review the top shoes."), ("how to train for marathon", 1, "A guide with tips.")]
    windows = intent.text_window(spark.createDataFrame(rows, "keyword string, doc_id int, text string"), "keyword")
    got = {r["keyword"]: r["primary_intent"] for r in intent.intent_scores(windows).collect()}
    assert got == {"best running shoes": "commercial", "how to train for marathon": "informational"}


def test_window_cuts_at_bytes(spark):
    rows = [("k", i, "é" * 400) for i in range(40)]
    window = intent.text_window(spark.createDataFrame(rows, "keyword string, doc_id int, text string"), "keyword").first()["window"]
    assert "�" not in window and len(window.encode()) < 8192


def test_gap(spark):
    kw = spark.createDataFrame([("k", "running shoes", 1), ("k", "cushioning", 2), ("k", "pronation", 3)], "g string, text string, place int")
    hs = spark.createDataFrame([("k", "best running shoes", 3, 1)], "g string, text string, count int, place int")
    stats = spark.createDataFrame([("k", 1500.0, 0)], "g string, avg_words double, recommended_headings int")
    drafts = spark.createDataFrame([("k", 1, "These running shoes are great for daily runs on any kind of road")], "g string, draft_id int, draft string")
    row = keywords.content_gap(drafts, kw, hs, stats, ["g"]).first()
    assert row["keyword_coverage"] == pytest.approx(100 / 3) and row["missing_keywords"] == ["cushioning", "pronation"]
    assert row["heading_coverage"] == 0 and row["words_needed"] == 1650 - row["user_words"] and row["headings_needed"] == 5
    assert "MISSING KEYWORDS" in reports.gap_report(row.asDict())


def test_heading_clusters_follow_order(spark):
    rows = [("g", 1, 0, "h2", "All about shoes"), ("g", 1, 1, "h2", "Shoes"), ("g", 2, 0, "h3", "Shoes"), ("g", 2, 1, "h2", "")]
    got = headings.heading_clusters(spark.createDataFrame(rows, "grp string, page int, nth int, tag string, text string"), ["grp"]).collect()
    assert [(r["tag"], r["text"], r["count"]) for r in sorted(got, key=lambda r: r["first_seen"])] == [("h2", "All about shoes", 3), ("h3", "Shoes", 1)]


def test_blocked(spark):
    urls = ["https://en.wikipedia.org/x", "https://amazon.com", "https://notamazon.com", "https://cdc.gov/a", "https://mybusiness.com"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r["url"] for r in filters.drop_blocked(rows).collect()} == {"https://notamazon.com", "https://mybusiness.com"}


def test_upsert_keeps_status_and_writes_history(spark):
    stored = spark.createDataFrame([("u", "k", "d", "old", "s", 3, 0, "scraped", "t")], "url string, keyword string, domain string, title string, snippet string, serp_position int, serp_page int, status string, created_at string")
    new = spark.createDataFrame([("u", "k", "d", "new", "s", 1, 0), ("v", "k", "d", "x", "s", 2, 0)], "url string, keyword string, domain string, title string, snippet string, serp_position int, serp_page int")
    table, history = store.upsert_results(stored, new, F.lit("now"))
    assert {(r["url"], r["title"], r["status"], r["created_at"]) for r in table.collect()} == {("u", "new", "scraped", "t"), ("v", "x", "pending", "now")}
    assert [(r["url"], r["title"], r["serp_position"]) for r in history.collect()] == [("u", "old", 3)]


HTML = """<html><head><title> T &amp; U </title><meta name="Description" content="about"><script>var a = "</p>";</script></head><body>
<nav><h2>Menu of things</h2><a href="/nav">n</a></nav><div class="sidebar">noise</div>
<article><h1>Main <b>title</b></h1><p>First para<p>Second <a href="https://out.com/x">out</a> text</p><ul><li>one<li>two</ul><a href="rel.html">rel</a><a href="#x">skip</a></article></body></html>"""


def test_parse_page():
    text, title, description, _, paragraphs, found, links, error = extract.parse_page("https://www.own.com/a/b.html", HTML)
    assert (title, description, paragraphs, error) == ("T & U", "about", 2, "")
    assert "noise" not in text and "Menu" not in text and text.startswith("Main") and "two" in text
    assert [h[:2] for h in found] == [("h2", "Menu of things"), ("h1", "Main title")]
    assert links == [("https://www.own.com/nav", "n", False), ("https://out.com/x", "out", True), ("https://www.own.com/a/rel.html", "rel", False)]


def test_two_articles_take_the_document():
    text = extract.parse_page("u", "<body><article>one</article><p>between</p><article>two</article></body>")[0]
    assert text == "one between two"


def test_deep_and_broken_html():
    assert extract.parse_page("u", "<div>" * 5000 + "x")[0] == "x"
    assert extract.parse_page("u", "<a href='x'>&bogus; <p <b>")[7] == ""


def test_sources(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# c\n WWW.Site.com \n\nb.org\n")
    assert {r["listed"] for r in search.read_domains(spark, str(tmp_path / "list.txt")).collect()} == {"site.com", "b.org"}
    (tmp_path / "freq.txt").write_text("the 9\nbad\nThe 3\nshoe 1\n")
    assert {r["word"]: r["rank"] for r in search.read_frequency_table(spark, str(tmp_path / "freq.txt")).collect()} == {"the": 2, "shoe": 3}


def test_reports_and_restore(spark):
    row = {
        "keyword": 'best "shoes"', "primary_intent": "commercial", "content_type": "listicle", "tone": "conversational", "recommended_words": 1500, "recommended_headings": 8, "avg_words": 1200.0, "median_words": 1100,
        "min_words": 800, "max_words": 2000, "keywords": [{"text": "tab\tshoe", "score": 0.9, "frequency": 3, "source": "tfidf"}], "entities": [], "headings": [{"tag": "h2", "text": "Types", "count": 2}],
        "questions": [{"question": "Why?"}], "related": ["r"], "confidence": {"commercial": 0.8},
    }
    for template in reports.TEMPLATES:
        assert 'best "shoes"' in reports.render(row, reports.PromptOptions(template=template))
    stored = spark.createDataFrame([("k", "2026-01-02 00:00:00", reports.export_bundle(row))], "keyword string, updated_at string, json_data string").withColumn("updated_at", F.to_timestamp("updated_at"))
    back = search.restore_sessions(stored)
    assert back.first()["session"]["keywords"][0]["text"] == "tab\tshoe"
    summary = search.session_summary(back).first()
    assert (summary["n_keywords"], summary["intent"], summary["n_related"], summary["updated"]) == (1, "commercial", 1, "Jan 2")
    assert reports.export_markdown(row).startswith("# best") and "[KEYWORDS]" in reports.export_text(row)


def test_written_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a b!", "text\nlines")], "keyword string, report string")
    reports.write_reports(rows, str(tmp_path / "out"))
    assert (tmp_path / "out" / "folder=a_b").exists()


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(V.norm(F.col("a")), V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("a"))).first()
    assert tuple(row) == (5.0, 0.0, 1.0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=8))
def test_token_and_clean_properties(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows.select("t", X.tokens(F.col("t")).alias("k"), F.octet_length(X.clean_text(F.col("t"))).alias("n"), F.octet_length("t").alias("m")).collect():
        assert all(2 <= len(w) <= 62 and set(w) <= set("abcdefghijklmnopqrstuvwxyz'") for w in r["k"])
        assert r["n"] == r["m"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "source string, doc_id long, text string")
    tokens = corpus.tokenize(corpus.admit(docs), ["source"])
    assert corpus.tfidf_keywords(tokens, ["source"]).count() == 0 and corpus.top_ngrams(tokens, ["source"]).count() == 0


def test_analysis_takes_captured_columns(spark, small):
    from lodestone.plans.analysis import Options, analyze
    from lodestone.plans.queries import parsed

    pages = parsed(spark, small).withColumn("keyword", F.lit("guide"))
    plain = analyze(pages).collect()[0]
    assert plain["entities"] == [] and plain["related"] == []
    text = next(k["text"] for k in plain["keywords"] if " " not in k["text"])
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    row = analyze(
        pages, options=Options(has_embeddings=True), related=frame([("guide", f"{text} near me"), ("guide", "a b")], "keyword string, phrase string"),
        entities=frame([("guide", "Berlin", "LOC", 2, 2, 2), ("guide", "Ada", "PER", 5, 5, 1)], "keyword string, text string, label string, frequency long, sources long, rank int"),
        ranks=frame([(50_000, text)], "rank int, word string"), similarity=frame([("guide", text, 0.9)], "keyword string, text string, similarity double"),
    ).collect()[0]
    assert [tuple(e) for e in row["entities"]] == [("Ada", "PER", 5, 5), ("Berlin", "LOC", 2, 2)] and row["related"] == ["a b", f"{text} near me"]
    score = next(k["score"] for k in row["keywords"] if k["text"] == text)
    assert score >= 0.35 + 0.45 * 0.9 + 0.15  # its rank, similarity and boost


def test_analysis_takes_models_columns(spark, small):
    """Headings far from the keyword go unless pages share them; a sure entailment goes before the rules."""
    from lodestone.plans.analysis import analyze
    from lodestone.plans.queries import parsed

    pages = parsed(spark, small).withColumn("keyword", F.lit("guide"))
    plain = analyze(pages).collect()[0]
    single = [h["text"] for h in plain["headings"] if h["count"] == 1]
    assert len(single) >= 2
    near = spark.createDataFrame([("guide", single[0], 0.2), ("guide", single[1], 0.1)], "keyword string, text string, similarity double")
    sure = spark.createDataFrame([("guide", "recipe", 0.5)], "keyword string, content_type string, entailment double")
    row = analyze(pages, heading_similarity=near, entailment=sure).collect()[0]
    assert [h["text"] for h in row["headings"]] == [h["text"] for h in plain["headings"] if h["count"] >= 2 or h["text"] == single[0]]
    assert row["content_type"] == "recipe" and plain["content_type"] != "recipe"
    unsure = sure.withColumn("entailment", F.lit(0.05))
    assert analyze(pages, entailment=unsure).collect()[0]["content_type"] == plain["content_type"]


def test_phrases_of_headings_hold_in_reports(spark):
    from lodestone.operators import headings

    rows = [("k", 1, 0, "h2", "Contact us today for shoes"), ("k", 1, 1, "h2", "Cushioning for long runs"), ("k", 2, 0, "h2", "How we test cushioning here")]
    kept = headings.reject_headings(spark.createDataFrame(rows, "keyword string, page int, nth int, tag string, text string"))
    assert [r["text"] for r in headings.heading_clusters(kept, ["keyword"]).collect()] == ["Cushioning for long runs"]


def test_user_agents_are_a_bounded_list(spark, tmp_path):
    from lodestone.sources import search

    (tmp_path / "agents.txt").write_text("# agents\n\n" + "\n".join(f"  agent {i}  " for i in range(150)) + "\n")
    found = [r["line"] for r in search.read_user_agents(spark, str(tmp_path / "agents.txt")).collect()]
    assert len(found) == 100 and all(a.startswith("agent ") and a == a.strip() for a in found)


def test_sessions_of_odd_layouts(spark):
    """Fields of other types, unknown ones and broken JSON don't touch their neighbours."""
    bodies = {
        "types": '{"keyword_count":"many","intent":["x"],"keywords":[{"text":5,"freq":"3","score":"high"},7,{"frequency":2.0,"source":null}],"stats":[1],"pages":{"url":"u"}}',
        "mixed": '{"people_also_ask":["plain?",{"question":"why?","link":"l","snippet":{"a":1}},null,{"snippet":"s"}],"related_searches":["r",5],"pages":[{"url":"u","is_crawled":1},{"url":"v","words":"12"}],"more":{"keywords":[{"text":"no"}]}}',
        "broken": '{"keywords":[', "list": "[1,2]", "null": None, "empty": "",
    }
    rows = search.restore_sessions(spark.createDataFrame([(k, b) for k, b in bodies.items()], "keyword string, json_data string").withColumn("updated_at", F.lit("2026-01-05").cast("timestamp")))
    tables = search.session_tables(rows)
    assert [tuple(r) for r in tables["keywords"].select("nth", "text", "frequency", "source", "score").orderBy("nth").collect()] == [(0, "5", 3, "saved", None), (1, None, None, "saved", None), (2, None, 2, "saved", None)]
    assert [tuple(r) for r in tables["questions"].select("nth", "question", "link").orderBy("nth").collect()] == [(0, "plain?", None), (1, "why?", "l"), (2, None, None), (3, None, None)]
    assert [r["query"] for r in tables["related"].orderBy("nth").collect()] == ["r", "5"]
    assert [tuple(r) for r in tables["pages"].select("keyword", "url", "words").orderBy("nth").collect()] == [("mixed", "u", None), ("mixed", "v", 12)]
    summary = {r["keyword"]: (r["n_keywords"], r["n_pages"], r["n_questions"], r["avg_words"]) for r in search.session_summary(rows).collect()}
    assert summary == {"types": (3, 0, 0, 0.0), "mixed": (0, 1, 4, 0.0), "broken": (0, 0, 0, 0.0), "list": (0, 0, 0, 0.0), "null": (0, 0, 0, 0.0), "empty": (0, 0, 0, 0.0)}
