"""Small literal tables for branches that the data sets don't reach; the same rows serve queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (columns with types, rows)
TABLES: dict[str, tuple[str, list[tuple]]] = {
    "lit_strings": ("id int, s string", [(1, "  hello world  "), (2, "   "), (3, "hello.txt"), (4, "\tTab\x0bs\r\n"), (5, "MiXeD Ünï"), (6, "")]),
    "lit_urls": (
        "id int, base string, href string",
        [
            (1, "https://www.example.com/page", "/a"), (2, "https://api.example.com/v1/x/y.html", "z.html"), (3, "http://h.com", "rel"), (4, "http://h.com/a/b", "//cdn.h.com/s"),
            (5, "example.org:8080/p?q=1", "https://abs.org/?utm_source=a&b=2&&gclid=3"), (6, "https://WWW.Upper.com?x=1", "q?fbclid=1"), (7, "ftp://files.net/d/", "../up"), (8, "https://www.cdc.gov/x", "http://a.b/?_ga=1"),
        ],
    ),
    "lit_block": (
        "id int, url string",
        [
            (1, "https://en.wikipedia.org/wiki/X"), (2, "https://www.amazon.com/dp/1"), (3, "https://old.reddit.com/r/a"), (4, "https://www.youtube.com/watch"), (5, "https://mybusiness.com/"),
            (6, "https://www.nih.gov/health"), (7, "https://stats.doubleclick.net/x"), (8, "https://notamazon.com/"), (9, "https://x.gov.uk/a"), (10, "https://T.CO/abc"), (11, "https://shop.com/cart"), (12, "https://shop.com/Login?x"),
        ],
    ),
    "lit_tokens": ("id int, text string", [(1, "don't won't rock'n'roll"), (2, "it’s ‘quoted’ text"), (3, "x" * 70 + " tail"), (4, "naïve café résumé"), (5, "'''"), (6, "The As Won best-of"), (7, "")]),
    "lit_lines": (
        "id int, line string",
        [
            (1, "Photo: someone"), (2, "Photo by " + "x" * 95), (3, "Copyright 2020 Someone"), (4, "copyright " + "x" * 75), (5, "12 likes"), (6, "a long line about likes and other things here"), (7, "https://a.b"),
            (8, "see file.pdf"), (9, "see file.pdf " + "x" * 120), (10, "Total Fat 3g, Cholesterol 2mg"), (11, "total fat only"), (12, "We use cookies to improve"), (13, "Jane Doe is a writer in Rome"), (14, "An ordinary line of text."),
            (15, "x" * 505 + " unsplash"), (16, "© 2021"), (17, ""), (18, "via someone"), (19, "viable option"), (20, "Sign up for our list"),
        ],
    ),
    "lit_headings": (
        "grp string, page int, nth int, tag string, text string",
        [
            ("a", 1, 0, "h2", "How to choose running shoes"), ("a", 1, 1, "h2", "Running Shoes"), ("a", 1, 2, "h3", "Running shoes"), ("a", 1, 3, "h2", "Read more stories"), ("a", 2, 0, "h2", "running shoes"),
            ("a", 2, 1, "h2", "This is a sentence."), ("a", 2, 2, "h2", "Get started"), ("a", 2, 3, "h2", "Jane Miller"), ("a", 2, 4, "h3", "Size: big"), ("a", 3, 0, "h2", "Types of cushioning"), ("a", 3, 1, "h2", ""),
            ("b", 1, 0, "h2", "Cushioning"), ("b", 1, 1, "h2", "cushioning and pronation explained well"), ("b", 1, 2, "h2", "CUSHIONING"), ("b", 2, 0, "h2", "1. Simple fit guide here"), ("b", 2, 1, "h2", "1. Simple fit guide here"),
            ("b", 2, 2, "h4", "Brand (R) trail shoes tested by us"),
        ],
    ),
    # headings and whether they are furniture, by hand
    "lit_furniture": (
        "id int, text string, expected boolean",
        [
            (1, "Contact us for a quote on your shoes", True), (2, "Our methodology for choosing winners", True), (3, "Privacy policy of this shoe site", True), (4, "How we test every pair of shoes", True), (5, "How to test a pair of shoes at home", False),
            (6, "Acme (tm) trail shoes for you", True), (7, "Acme (r) trail shoes for you", True), (8, "Acme (TM) trail shoes for you", True), (9, "Frequently asked questions on fit", True), (10, "Frequent questions on fit and size", False),
            (11, "The bottom line on cushioning", True), (12, "Why trust this advice on running", True), (13, "Treatment in winter for sore feet", True), (14, "Winter treatment for sore feet", False), (15, "Save 20% off your running shoes", True),
            (16, "Meet the team behind the marathon", True), (17, "The team behind the marathon plan", False), (18, "WRITE A REVIEW of these shoes", True), (19, "What makes a shoe good for trails", True), (20, "What a good shoe for trails needs", False),
            (21, "Your cart is empty, keep walking", True), (22, "We're sorry for the wait today", True), (23, "Key takeaways on marathon training", True), (24, "Stay up to date on race days", True), (25, "Learning to pace a marathon", False), (26, "Add to cart or keep looking", True),
        ],
    ),
    "lit_matrix": (
        "id int, matrix string, mask string",
        [(1, "[[3.0,4.0],[100.0,-7.0],[3.0,4.0]]", "1 0 1"), (2, "[[1.0,0.0,0.0],[0.0,1.0,0.0]]", "1 1"), (3, "[[5.0,5.0]]", "0")],
    ),
    "lit_settings": ("side string, key string, value string", [("old", "threads", "16"), ("old", "theme", "dark"), ("old", "broken", None), ("new", "theme", "light")]),
    "lit_log": (
        "seq int, at timestamp, level string, message string",
        [(1, "2026-03-31 09:00:01", "info", "seen"), (2, "2026-03-31 09:00:02", "debug", "hidden"), (3, None, "warn", "slow"), (4, "2026-03-31 09:00:04", "error", "failed"), (5, "2026-03-31 23:59:59", "info", "done")],
    ),
    "lit_chosen": ("place int, url string, keyword string", [(1, "https://b.com/2", "k2"), (2, "https://a.com/1", "k1"), (3, "https://none.com/", "k3")]),
    "lit_intent_types": (
        "id int, intent string, kind string",
        [(1, "informational", "how-to"), (2, "informational", "guide"), (3, "informational", "recipe"), (4, "informational", "health guide"), (5, "informational", "article"), (6, "commercial", "how-to"), (7, "transactional", "review"), (8, "navigational", "guide")],
    ),
    # text, and its pieces by a vocabulary of the query, by hand
    "lit_pieces": (
        "id int, text string, pieces string",
        [
            (1, "John visited", "[CLS] John visit ##ed [SEP]"), (2, "JOHN-paul, (visits)!", "[CLS] JOHN - paul , visit ##s [SEP]"), (3, "zzz visitzz", "[CLS] zzz visit visitzz [SEP]"), (4, "", "[CLS] [SEP]"), (5, "John John John John John", "[CLS] John John John John John [SEP]"),
            (6, "  Visited\tjohn\n", "[CLS] Visit ##ed john [SEP]"),
        ],
    ),
    "lit_analysis": (
        "keyword string, body string",
        [
            ("best running shoes", '{"primary_intent":"commercial","content_type":"review","tone":"conversational","recommended_words":1320,"recommended_headings":8,"avg_words":1200.0,"median_words":1100,"min_words":800,"max_words":2000,"avg_h2":6.5,"avg_h3":2.0,"avg_outbound":4.25,"confidence":{"commercial":0.8,"informational":0.2},"scores":{"commercial":4.0,"informational":1.0},"signals":{"commercial":["best","top"]},"keywords":[{"text":"running shoes","score":0.62,"frequency":9,"source":"ngram","cfr":0.8504},{"text":"cushioning","score":0.41,"frequency":4,"source":"tfidf"},{"text":"shoes","score":0.3,"frequency":7,"source":"tfidf"},{"text":"old","score":0.1,"frequency":1,"source":"tfidf"}],"entities":[{"text":"Acme","label":"ORG","frequency":3,"sources":2}],"headings":[{"tag":"h2","text":"how to choose","count":3},{"tag":"h3","text":"Sizing","count":2},{"tag":"h2","text":"1. Acme One","count":2},{"tag":"h2","text":"Running on trails","count":1},{"tag":"h2","text":"Storage","count":1}],"questions":[{"question":"What is pronation?"}],"related":["trail shoes"]}'),
            ("how to bake", '{"primary_intent":"informational","content_type":"how-to","tone":"informal","recommended_words":0,"recommended_headings":5,"avg_words":0.0,"median_words":0,"min_words":0,"max_words":0,"avg_h2":0.0,"avg_h3":0.0,"keywords":[],"entities":[],"headings":[{"tag":"h2","text":"Bake it well","count":1}],"questions":[],"related":[]}'),
        ],
    ),
    "lit_html": (
        "page_id int, url string, html string",
        [
            (1, "https://www.a.com/x/y.html", "<html><head><title> T </title><meta name='description' content='D'></head><body><nav>menu</nav><main><h1>Head</h1><p>One two</p><p>three <b>four</b></p><a href='z.html'>z</a><a href='http://b.com/q'>b</a></main><footer>foot</footer></body></html>"),
            (2, "https://b.com/f.pdf", "%PDF-1.4 <p>not html</p>"), (3, "https://c.com/", "<div id='content'><p>few</p></div><p>outside</p>"), (4, "https://d.com/", "<p>a&amp;b</p><script>var x = '<p>no</p>'</script><ul><li>one<li>two</ul>"), (5, "https://e.com/", "x\0" + "y" * 600),
        ],
    ),
    "lit_html_rendered": ("page_id int, url string, html string", [(2, "https://b.com/f.pdf", "<p>never used</p>"), (3, "https://c.com/", "<main><h2>Rendered part</h2><p>now there are more words here</p></main>"), (4, "https://d.com/", "<p>less</p>")]),
    "lit_serp": (
        "keyword string, keyword_idx int, page int, idx int, url string",
        [
            ("best shoes", 0, 0, 0, "https://a.com/1"), ("best shoes", 0, 0, 1, "https://www.amazon.com/x"), ("best shoes", 0, 0, 2, "https://b.com/2"), ("best shoes", 0, 1, 0, "https://a.com/1"), ("best shoes", 0, 1, 1, "https://c.com/3"),
            ("how to run", 1, 0, 0, "https://c.com/3"), ("how to run", 1, 0, 1, "https://d.gov/4"), ("how to run", 1, 0, 2, "https://e.com/5"), ("how to run", 1, 0, 3, "https://e.com/5"), ("empty", 2, 0, 0, "https://youtube.com/v"),
        ],
    ),
    "lit_serp_json": (
        "keyword string, page int, body string",
        [
            ("k1", 0, '{"organic":[{"position":1,"title":"T1","link":"https://www.a.com/x","snippet":"s"},{"title":"T2","link":"https://b.com"}],"peopleAlsoAsk":[{"question":"What is a shoe?","snippet":"s","link":"l"}],"relatedSearches":[{"query":"trail shoes"},{"query":"cheap shoes"}],"knowledgeGraph":{"title":"Shoe","type":"Thing"}}'),
            ("k1", 1, '{"organic":[{"position":4,"link":"https://c.com/z"}]}'), ("k1", 2, '{"organic":[]}'), ("k1", 3, '{"organic":[{"link":"https://late.com"}]}'), ("k2", 0, '{"error":"quota"}'),
        ],
    ),
    "lit_links": (
        "page_idx int, url string, word_count int, link string, link_nth int, is_outbound boolean",
        [
            (0, "https://a.com/1", 300, "https://b.com/2", 0, True), (0, "https://a.com/1", 300, "https://new.com/p", 1, True), (0, "https://a.com/1", 300, "https://a.com/in", 2, False), (0, "https://a.com/1", 300, "https://shop.com/checkout", 3, True),
            (1, "https://b.com/2", 200, "https://new.com/p", 0, True), (1, "https://b.com/2", 200, "ftp://x.com", 1, True), (1, "https://b.com/2", 200, "https://bit.ly/1", 2, True), (1, "https://b.com/2", 200, "https://other.org/q", 3, True),
            (2, "https://thin.com/3", 10, "https://thin.org/z", 0, True),
        ],
    ),
    "lit_freq": ("nth int, value string", [(0, "the 1000"), (1, "bad line here"), (2, "shoe 900"), (3, "Shoe 800"), (4, "running 700"), (5, ""), (6, "cushion 5")]),
    "lit_input": ("input string", [("first keyword\r\n  second one  \n\n\tthird\r",)]),
    "lit_proxies": ("value string", [("http://u:p@h1.com:8080",), ("h2.com:3128",), ("# no",), ("h3.com:1080:user:pass",), ("socks5://h4.com:9",), ("broken",)]),
    "lit_bio": (
        "doc_id int, pos int, piece string, label string",
        [
            (1, 0, "John", "B-PER"), (1, 1, "Smith", "I-PER"), (1, 2, "##son", "I-PER"), (1, 3, "visited", "O"), (1, 4, "New", "B-LOC"), (1, 5, "York", "I-LOC"), (1, 6, "Ac", "B-ORG"), (1, 7, "##me", "B-ORG"), (1, 8, "in", "I-PER"), (1, 9, "x", "O"), (1, 10, "ab", "B-LOC"),
            (2, 0, "lone", "I-LOC"), (2, 1, "O", "O"), (2, 2, "abc", "B-ORG"), (2, 3, "#tag", "B-PER"), (2, 4, "Rome", "B-LOC"), (2, 5, "Rome", "B-LOC"),
        ],
    ),
    "lit_keywords": (
        "grp string, text string, source string, score double, frequency bigint, similarity double, place int",
        [
            ("a", "cushioning", "tfidf", 3.2, 4, 0.61, 1), ("a", "pronation", "tfidf", 2.0, 3, 0.33, 2), ("a", "amazon", "tfidf", 1.5, 5, 0.2, 3), ("a", "running shoes", "ngram", 9.0, 9, 0.8, 4), ("a", "want build", "ngram", 4.0, 4, 0.3, 5),
            ("a", "trail running", "ngram", 8.0, 8, 0.2, 6), ("a", "visit site.com", "ngram", 2.0, 2, 0.1, 7), ("a", "Julian Chokkattu", "ngram", 2.0, 2, 0.05, 8), ("a", "shoe", "tfidf", 1.0, 2, 0.02, 9), ("b", "marathon", "tfidf", 2.0, 2, 0.5, 1),
            ("b", "rock'n", "tfidf", 2.0, 2, 0.5, 2), ("b", "reviewed by experts", "ngram", 2.0, 2, 0.5, 3), ("b", "photo by someone", "ngram", 2.0, 2, 0.5, 4), ("b", "marathon plan", "ngram", 1.0, 1, 0.45, 5),
        ],
    ),
    "lit_questions": ("grp string, phrase string", [("a", "What is the best trail shoe?"), ("a", "pronation (explained)"), ("b", "How long is a marathon"), ("b", "to be or")]),
    "lit_sessions": (
        "keyword string, updated_at timestamp, json_data string",
        [
            ("new", "2026-03-31 10:20:30", '{"keyword":"new","keyword_count":3,"intent":{"primary":"commercial","content_type":"review","tone":"formal"},"stats":{"avg_words":1200.0},"keywords":[{"text":"a"}],"people_also_ask":[{"question":"q"}],"related_searches":["r","s"],"pages":[{"url":"u","is_crawled":0},{"url":"v","is_crawled":1}]}'),
            ("old", "2025-12-01 00:00:00", '{"keyword":"old","primary_intent":"informational","content_type":"guide","tone":"casual","stats":{"avg_word_count":800.5},"keywords":[{"text":"a"},{"text":"b"}],"pages":[{"url":"u"}]}'), ("bad", "2025-01-05 23:59:59", "no json"),
            ("own", "2026-04-05 06:07:08", '{"keyword":"own","intent":"transactional","content_type":"product","tone":"casual","keyword_count":1,"keywords":[{"text":"k","score":0.5,"freq":3,"src":"ngram","cfr":0.8,"sem":0.1,"tfidf":0.2,"boost":0.15}],"people_also_ask":["plain?",{"question":"why?","snippet":"s","link":"l"}],"related_searches":[]}'),
        ],
    ),
    "lit_drafts": ("grp string, draft_id int, draft string", [("a", 1, "Best running shoes need cushioning for trail use, and some more words"), ("a", 2, ""), ("b", 1, "marathon")]),
    "lit_logits": ("id int, logits array<double>", [(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0]), (3, [-5.5, 900.0, 899.0])]),
    "lit_intents": (
        "keyword string, doc_id int, text string",
        [
            ("best running shoes", 1, "We review the top shoes. Compare price and buy today with free shipping."), ("best running shoes", 2, "Honestly awesome shoes, super easy to love."), ("how to train for marathon", 1, "A step by step tutorial with instructions. This guide has tips."),
            ("how to train for marathon", 2, "Research and analysis of the study findings. Login to your account."), ("api tutorial", 1, "The algorithm and api endpoint protocol implementation framework."), ("flu symptoms", 1, "Diagnosis, treatment, medication. Buy now, order here."),
        ],
    ),
    "lit_entailment": (
        "keyword string, content_type string, entailment double",
        [("a", "review", 0.4), ("a", "guide", 0.7), ("a", "listicle", 0.1), ("b", "review", 0.09), ("b", "guide", 0.01), ("c", "recipe", 0.1)],
    ),
    "lit_copy": ("nth int, line string", [(0, "==== head"), (1, "  alpha beta  0.5  x3"), (2, ""), (3, "-----"), (4, "gamma"), (5, "delta  e  f")]),
    "lit_pages": (
        "page_id int, word_count int, p_tags int, html string",
        [(1, 250, 1, "<p>x</p>"), (2, 250, 3, "<html>"), (3, 0, 0, "x" * 600), (4, 0, 0, "x"), (5, 300, 5, "<div id=__NEXT_DATA__>"), (6, 150, 5, "<p>"), (7, 600, 9, "enable javascript"), (8, 0, 0, "%PDF-1.4"), (9, 0, 0, "GIF89a..")],
    ),
    "lit_rendered": ("page_id int, word_count int, page_text string", [(1, 100, "fewer"), (3, 50, "found")]),
}


def literal(spark: SparkSession, name: str) -> DataFrame:
    columns, rows = TABLES[name]
    if "timestamp" in columns:
        from pyspark.sql import functions as F

        out = spark.createDataFrame(rows, columns.replace("timestamp", "string"))
        stamps = [c.split()[0] for c in columns.split(", ") if c.endswith("timestamp")]
        return out.withColumns({c: F.to_timestamp(c) for c in stamps})
    return spark.createDataFrame(rows, columns)


def literal_sql(*names: str) -> str:
    """CTE definitions of literal tables, each with a trailing comma."""

    def value(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, list):
            return "[" + ", ".join(map(value, v)) + "]"
        return repr(v)

    kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "array<double>": "DOUBLE[]"}
    out = ""
    for name in names:
        columns, rows = TABLES[name]
        parts = [c.split(" ", 1) for c in columns.split(", ")]
        casts = ", ".join(f"c{n}::{kinds[kind]} AS {c}" for n, (c, kind) in enumerate(parts))
        heads = ", ".join(f"c{n}" for n in range(len(parts)))
        body = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)
        out += f"{name} AS (SELECT {casts} FROM (VALUES {body}) v({heads})), "
    return out
