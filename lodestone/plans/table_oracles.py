"""DuckDB SQL for the queries of table_queries, with values of its own in place of the package's lists."""

from __future__ import annotations

from lodestone.plans.oracles import ANALYSIS_OF_PAGES, FREQ, GRAMS, ORACLE_SQL, QUEUE, SPLIT, TERMS, TFIDF, TOKENS, TOP_GRAMS, UNESCAPE, clusters, domain, junk, recursive, sql, words

# blocked: the first four of eleven hosts, which the event's number tells
SERP = """sr AS (SELECT 'user ' || user_id AS keyword, user_id::INT AS keyword_idx, (event_id // 10)::INT AS page, (event_id % 10)::INT AS idx, event_id % 11 < 4 AS blocked,
        'https://' || ['www.amazon.com', 'old.reddit.com', 'stats.doubleclick.net', 'www.nih.gov', 'notamazon.com', 'www.shoes.org', 'blog.run.net', 'a.com', 'b.org', 'c.net', 'd.io'][event_id % 11 + 1] || '/' || event_id % 300 AS url FROM events),
    rk AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY page, idx)::INT AS rank FROM sr WHERE NOT blocked), """
sql("event_url_ranks", "SELECT keyword, url, rank, page * 10 + idx + 1 AS absolute FROM (SELECT *, row_number() OVER (PARTITION BY keyword, url ORDER BY rank) AS nth FROM rk) WHERE nth = 1", SERP)
sql(
    "event_batch_bridge",
    "SELECT keyword, page, idx, url, rank, first(keyword) OVER w AS owner, row_number() OVER w = 1 AS fetched FROM rk WINDOW w AS (PARTITION BY url ORDER BY keyword_idx, page, idx)",
    SERP,
)
sql(
    "event_run_counters",
    """SELECT keyword, count(*) AS n_results, count(*) FILTER (WHERE blocked) AS n_blocked, count(*) FILTER (WHERE NOT blocked) - count(DISTINCT url) FILTER (WHERE NOT blocked) AS n_duplicates
    FROM sr GROUP BY keyword""",
    SERP,
)
sql(
    "event_keyword_success",
    "SELECT keyword, count(DISTINCT url) AS n_pages, count(DISTINCT url) FILTER (WHERE length(url) > 25) AS n_good, count(*) FILTER (WHERE length(url) > 25) = 0 AS retry FROM sr GROUP BY keyword",
    SERP,
)
sql("page_gov_filter", "SELECT page_id, page_id % 4 < 2 AS gov, TRUE AS junk FROM pages")
LINKS = """lk AS (SELECT page_id::INT AS page_idx, 'https://page' || page_id || '.org/' AS url, page_id * 13 % 120 AS word_count, 'https://page' || (page_id + 1) % 90 || '.org/' AS mutual,
        'https://new' || page_id % 70 || '.net/p' AS fresh, 'https://page' || page_id || '.org/in' AS own FROM pages), """
sql(
    "page_outbound",
    "SELECT row_number() OVER (ORDER BY page_idx, nth)::INT AS place, link AS url, url AS source_url FROM f WHERE again = 1 ORDER BY page_idx, nth LIMIT 30",
    LINKS + """c AS (SELECT page_idx, url, 0 AS nth, mutual AS link FROM lk WHERE word_count > 50 AND mutual NOT IN (SELECT url FROM lk) UNION ALL SELECT page_idx, url, 1, fresh FROM lk WHERE word_count > 50),
    f AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_idx, nth) AS again FROM c), """,
)
sql("page_stored_links", "SELECT url AS source_url, mutual AS url, 'mutual' AS anchor_text FROM lk UNION ALL SELECT url, fresh, 'new' FROM lk", LINKS)
sql(
    "page_chosen_links",
    "SELECT row_number() OVER (ORDER BY page_idx, nth)::INT AS place, link AS url, 'k' || page_idx AS keyword, url AS source_url FROM f WHERE again = 1",
    LINKS + """c AS (SELECT page_idx, url, unnest([mutual, fresh, 'https://www.amazon.com/' || page_idx % 5, own, 'ftp://files.org/x']) AS link, unnest(range(5)) AS nth FROM lk WHERE page_idx < 3),
    f AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_idx, nth) AS again FROM c), """,
)
sql(
    "page_url_resolve",
    r"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN origin || '/a/b' WHEN 1 THEN folder || 'c.html' WHEN 2 THEN origin || '//cdn.org/x' WHEN 3 THEN 'https://abs.org/?utm_source=a&b=2' ELSE folder || '?q=1&fbclid=9' END AS resolved,
        ['/a/b', 'c.html', '//cdn.org/x', 'https://abs.org/?b=2', '?q=1'][page_id % 5 + 1] AS stripped FROM u""",
    r"u AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin, regexp_extract(url, '^(.*/)', 1) AS folder FROM pages), ",
)
sql(
    "document_render_choice",
    "SELECT doc_id, (w > 0 AND (w < 200 OR (w < 500 AND doc_id % 3 = 0))) OR (w = 0 AND strlen(coalesce(text, '')) > 500) AS needs, w > 200 AND n_chars % 7 < 3 AS non_article, FALSE AS is_binary FROM d",
    f"d AS (SELECT *, {words('text')} AS w FROM documents), ",
)
sql(
    "document_render_merge",
    """SELECT doc_id AS page_id, w + (doc_id % 2 = 0 AND doc_id % 3 = 2)::INT AS word_count, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 2 THEN 9 ELSE 1 END AS p_tags,
        md5(CASE WHEN doc_id % 2 = 0 THEN array_to_string(list_reverse(regexp_extract_all(text, '(?s).')), '') ELSE text END) AS text_md5, doc_id % 2 = 0 AND doc_id % 3 = 2 AS used_rendering FROM d""",
    f"d AS (SELECT *, {words('text')} AS w FROM documents), ",
)
KEYWORDS = TOKENS + TFIDF + GRAMS + TOP_GRAMS + """kw AS (SELECT source, word AS text, 'tfidf' AS kind, score, df AS frequency, rank AS place FROM tfidf WHERE rank <= 100
        UNION ALL SELECT source, ngram, 'ngram', occurrences::DOUBLE, occurrences, rank + (SELECT count(*) FROM tfidf t WHERE t.source = g.source AND t.rank <= 100) FROM grams g WHERE rank <= 50),
    lit_keywords AS (SELECT source AS grp, text, kind AS source, score, frequency, (length(text) * 7 % 100)::DOUBLE / 100 AS similarity, place FROM kw), """
# these queries take all n-grams of a source
SCORES = KEYWORDS.replace("seen <= 10000 AND ", "") + """lit_questions AS (SELECT source AS grp, b.text AS phrase FROM benchmark b JOIN documents ON doc_id = item_id),
    bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) GROUP BY word),
    lit_freq AS (SELECT row_number() OVER (ORDER BY n DESC, word) AS nth, word || ' ' || n AS value FROM bw), """ + TERMS + FREQ + """
    r1 AS (SELECT k.grp, text, source, score, frequency, coalesce(f.rank, -1) AS word_rank, similarity AS sem, score / greatest(max(score) OVER (PARTITION BY k.grp), 0.01) AS tfidf,
        CASE WHEN EXISTS (SELECT 1 FROM gt WHERE gt.grp = k.grp AND list_contains(string_split(text, ' '), term)) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM lit_keywords k LEFT JOIN freq f ON f.word = k.text),
    r2 AS (SELECT *, CASE WHEN word_rank > 0 THEN sqrt(word_rank / 50000.0) ELSE 0.85::DOUBLE END AS cfr FROM r1),
    r3 AS (SELECT *, 0.35 * cfr + 0.45 * sem + 0.20 * tfidf + boost AS final FROM r2), """
sql("source_rescore", f"SELECT grp AS source, text, source AS kind, frequency, word_rank, {', '.join(f'round({c}, 6) AS {c}' for c in ('cfr', 'sem', 'tfidf', 'boost', 'final'))} FROM r3", SCORES)
JUNKED = SCORES + f"""jk AS (SELECT grp, text, source, {junk('text', 'sem', 'word_rank > 0')} AS junk, round(CASE WHEN {junk('text', 'sem', 'word_rank > 0')}
        OR (contains(text, ' ') AND frequency::DOUBLE / max(frequency) OVER (PARTITION BY grp) >= 0.80 AND sem < 0.40) THEN 0.0::DOUBLE ELSE final END, 6) AS final FROM r3), """
sql("source_junk", "SELECT grp AS source, text, junk, final FROM jk", JUNKED)
sql(
    "source_tiers",
    "SELECT grp AS origin, text, tier, place, final FROM pl WHERE place <= CASE tier WHEN 'primary_word' THEN 5 ELSE 15 END",
    JUNKED + """k1 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY final DESC, text) AS nth, count(*) OVER (PARTITION BY grp) AS total, count(*) FILTER (WHERE final > 0.40) OVER (PARTITION BY grp) AS above FROM jk),
    k2 AS (SELECT *, CASE WHEN above > 20 AND total > 20 THEN max(CASE WHEN nth = 21 THEN final END) OVER (PARTITION BY grp) + 0.001 ELSE 0.40 END AS bar FROM k1),
    k3 AS (SELECT *, max((final > bar)::INT) OVER (PARTITION BY grp) AS available FROM k2),
    tr AS (SELECT grp, text, 'primary_phrase' AS tier, nth, final FROM k3 WHERE source = 'ngram' AND final > bar
        UNION ALL SELECT grp, text, 'primary_word', nth, final FROM k3 w WHERE source = 'tfidf' AND final > 0.25 AND available = 1
            AND NOT EXISTS (SELECT 1 FROM k3 p WHERE p.grp = w.grp AND p.source = 'ngram' AND p.final > 0.25 AND contains(p.text, w.text))
        UNION ALL SELECT grp, text, 'secondary', nth, final FROM k3 WHERE final > 0.25 AND final <= bar),
    pl AS (SELECT *, row_number() OVER (PARTITION BY grp, tier ORDER BY nth) AS place FROM tr), """,
)
GAPS = TOKENS + TFIDF + f"""dr AS (SELECT source, doc_id, lower(text) AS low, {words('text')} AS w FROM documents),
    ln AS (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY ALL HAVING count(*) >= 2),
    hd AS (SELECT source, line, row_number() OVER (PARTITION BY source ORDER BY n DESC, line) AS place FROM ln),
    kc AS (SELECT d.doc_id, avg(contains(low, word)::INT) * 100 AS c, list(word ORDER BY rank) FILTER (WHERE NOT contains(low, word)) AS m FROM dr d JOIN tfidf t ON t.source = d.source AND t.rank <= 20 GROUP BY ALL),
    hc AS (SELECT d.doc_id, avg(contains(low, lower(line))::INT) * 100 AS c, list(line ORDER BY place) FILTER (WHERE NOT contains(low, lower(line))) AS m FROM dr d JOIN hd h ON h.source = d.source AND h.place <= 40 GROUP BY ALL),
    st AS (SELECT source, avg(w) AS aw, count(*) % 9 AS rh FROM dr GROUP BY source),
    gp AS (SELECT d.source, d.doc_id AS draft_id, w AS user_words, coalesce(k.c, 100.0) AS kcov, coalesce(h.c, 100.0) AS hcov, w / aw AS ratio, greatest(floor(round(aw * 1.1, 4))::BIGINT - w, 0) AS words_needed,
        (CASE WHEN rh > 0 THEN rh ELSE 5 END)::BIGINT AS headings_needed, coalesce(k.m, []) AS mk, coalesce(h.m, []) AS mh FROM dr d JOIN st USING (source) LEFT JOIN kc k USING (doc_id) LEFT JOIN hc h USING (doc_id)), """
sql(
    "source_gap",
    """SELECT source, draft_id, user_words, round(kcov, 6) AS keyword_coverage, round(hcov, 6) AS heading_coverage, round(ratio, 6) AS word_ratio, words_needed, headings_needed,
        array_to_string(mk, '|') AS missing_keywords, md5(array_to_string(mh, '|')) AS missing_headings FROM gp""",
    GAPS,
)
sql(
    "source_gap_report",
    """SELECT draft_id::VARCHAR AS keyword, md5(concat('Coverage: keywords ', round_even(kcov, 0)::INT, '%, headings ', round_even(hcov, 0)::INT, '%', chr(10), 'Words: ', user_words, ', ', words_needed, ' more needed; headings: ', headings_needed, chr(10),
        CASE WHEN len(mk) > 0 THEN concat('MISSING KEYWORDS', chr(10), array_to_string(list_transform(mk[1:30], lambda x: '  - ' || x || chr(10)), '')) ELSE '' END,
        CASE WHEN len(mh) > 0 THEN concat('MISSING HEADINGS', chr(10), array_to_string(list_transform(mh[1:15], lambda x: '  - ' || x || chr(10)), '')) ELSE '' END)) AS report_md5 FROM gp""",
    GAPS,
)
sql("source_text_lines", "SELECT grp, place, concat(text, '|', printf('%.3f', round(score, 2)), '|', frequency, '|', source) AS line FROM lit_keywords", KEYWORDS)
sql(
    "source_outline",
    "SELECT source AS keyword, place, n AS count, md5(line) AS text_md5 FROM p WHERE place <= 12",
    """c AS (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, line)::INT AS place FROM c WHERE n >= 2 AND NOT regexp_matches(line, '^[0-9]{1,2}\\.')), """,
)
sql(
    "document_readers",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['beginners', 'learners', 'cooks', 'patients', 'everyone', 'everyone'][doc_id // 4 % 6 + 1] WHEN 1 THEN 'comparers' WHEN 2 THEN 'buyers' ELSE 'everyone' END AS reader FROM documents""",
)
sql(
    "part_strings",
    r"""SELECT p_partkey, bare AS trimmed, lower(s) AS low, p_partkey % 2 = 0 AS ends, contains(p_name, 'ring') AS holds_any_case, CASE WHEN length(bare) > 12 THEN substr(bare, 1, 10) || '..' ELSE bare END AS short,
        regexp_replace(regexp_replace(s, '[^A-Za-z0-9-]', '_', 'g'), '_+$', '') AS stem, to_json({'s': s})::VARCHAR AS json FROM p""",
    """n AS (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part),
    p AS (SELECT p_partkey, lower(p_name) AS p_name, title || CASE WHEN p_partkey % 2 = 0 THEN '.txt' ELSE '' END AS bare, ' ' || chr(9) || title || CASE WHEN p_partkey % 2 = 0 THEN '.txt ' ELSE chr(13) || chr(10) END AS s FROM n), """,
)
sql(
    "part_entities",
    "SELECT doc_id, 0 AS start, w[1] || CASE WHEN doc_id % 2 = 0 THEN lower(w[2]) ELSE ' ' || w[2] END AS text, 'ORG' AS label FROM n UNION ALL SELECT doc_id, 3, 'Rome', 'LOC' FROM n",
    "n AS (SELECT p_partkey AS doc_id, list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])) AS w FROM part), ",
)
sql("part_headings", "SELECT p_brand, 'h2' AS tag, 'guide to the ' || p_name AS text, count(*) AS count, count(*) AS pages FROM part WHERE p_partkey % 7 = 6 AND NOT contains(p_name, 'widget') GROUP BY p_brand, p_name")
sql(
    "embedding_softmax",
    "SELECT vec_id, round(exp(l[3] - list_max(l)) / (exp(l[1] - list_max(l)) + exp(l[2] - list_max(l)) + exp(l[3] - list_max(l))), 6) AS entailment FROM e",
    "e AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: x::DOUBLE * 10) AS l FROM embeddings), ",
)
sql(
    "document_list_copy",
    "SELECT d, nth::INT AS nth, md5(regexp_extract(ltrim(line, ' '), '^(.*?)(?:  |$)', 1)) AS line_md5 FROM m WHERE line <> '' AND NOT starts_with(line, '=') AND NOT starts_with(line, '-')",
    """l AS (SELECT doc_id AS d, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS nth FROM documents),
    m AS (SELECT d, nth, CASE nth % 5 WHEN 1 THEN '  ' || raw || '  x' WHEN 2 THEN '--' || raw ELSE raw END AS line FROM l), """,
)
sql(
    "captured_results",
    """SELECT keyword, ((nth - 1) // 10 + 1)::INT AS page, ((nth - 1) % 10)::INT AS idx, ((nth - 1) // 10 * 10 + 10 + (nth - 1) % 10 + 1)::INT AS absolute, 'title ' || doc_id AS title, 'host' || doc_id % 97 || '.com' AS domain, md5(coalesce(text, '')) AS snippet_md5 FROM k""",
    "k AS (SELECT *, source || ' & co. #' || doc_id // 1000 AS keyword, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) AS nth FROM documents WHERE source IS NOT NULL), ",
)
sql("document_files", "SELECT regexp_replace(regexp_replace(coalesce(source, 'none'), '[^A-Za-z0-9-]', '_', 'g'), '_+$', '') || '/' || doc_id || '.txt' AS name, md5(coalesce(text, '')) AS content_md5 FROM documents")
sql(
    "document_line_numbers",
    "SELECT row_number() OVER (ORDER BY doc_id, pos) AS nth, md5(rtrim(line, chr(13))) AS line_md5 FROM l",
    "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL), ",
)
sql(
    "observed_pages",
    """SELECT 'n_pages' AS counter, count(*) AS n FROM pages UNION ALL SELECT 'n_secure', count(*) FILTER (WHERE starts_with(url, 'https://')) FROM pages
    UNION ALL SELECT 'n_english', count(*) FILTER (WHERE contains(url, '/en/')) FROM pages UNION ALL SELECT 'n_bytes', sum(strlen(html))::BIGINT FROM pages""",
)
PARTS = f"pt AS (SELECT page_id, url, page_id % 3 AS kind, list_filter(string_split({domain('url')}, '.'), lambda x: x <> '') AS parts FROM pages), "
sql(
    "page_session_keywords",
    """SELECT 'k' || page_id AS keyword, nth::INT AS nth, text, length(text)::INT AS frequency, CASE WHEN kind = 0 THEN 'tfidf' ELSE 'saved' END AS source, CASE WHEN kind = 0 THEN 0.5::DOUBLE END AS score
    FROM (SELECT page_id, kind, unnest(parts) AS text, unnest(range(len(parts))) AS nth FROM pt)""",
    PARTS,
)
sql("page_session_questions", "SELECT 'k' || page_id AS keyword, 0 AS nth, ['why ', 'how ', 'who '][kind + 1] || page_id AS question, CASE WHEN kind = 0 THEN url END AS link FROM pt", PARTS)
sql(
    "page_session_summary",
    """SELECT 'k' || page_id AS keyword, len(parts) AS n_keywords, ['commercial', 'informational', 'transactional'][kind + 1] AS intent, CASE WHEN kind < 2 THEN page_id * 10.0::DOUBLE ELSE 0.0::DOUBLE END AS avg_words,
        (kind < 2)::BIGINT AS n_pages, 1::BIGINT AS n_questions FROM pt""",
    PARTS,
)
ORACLE_SQL["stored_upsert"] = ORACLE_SQL["upsert_results"]
sql("stored_delete", "SELECT t, url, keyword FROM qu, (VALUES ('results'), ('history'), ('headings'), ('links')) v(t) WHERE event_id % 9 <> 0", QUEUE)
MADE = """mh AS (SELECT p_brand, p_partkey // 10 AS page, p_partkey % 10 AS nth, CASE WHEN p_size % 3 = 0 THEN 'h3' ELSE 'h2' END AS tag,
        CASE p_partkey % 4 WHEN 0 THEN 'How to use the ' || p_name WHEN 1 THEN 'use the ' || upper(p_name) ELSE 'About the ' || p_size % 5 || ' kinds' END AS text
    FROM part WHERE p_partkey % 4 < 2 AND NOT contains(p_name, 'widget')), """
# a name in capitals with "use the" links words, so it is no byline; `about` and `widget` are furniture
recursive("part_heading_clusters", "SELECT g AS p_brand, p.tag AS tag, p.text AS text, p.n AS count, k::INT AS first_seen FROM cl", MADE + clusters("mh", "p_brand"))
recursive(
    "part_heading_ranks",
    "SELECT * FROM (SELECT g AS p_brand, row_number() OVER (PARTITION BY g ORDER BY p.n DESC, k)::INT AS place, p.tag AS tag, p.text AS text, p.n AS count FROM cl) WHERE place <= 5",
    MADE + clusters("mh", "p_brand", 20),
)
#: The keywords of the analysis with their final scores; no embeddings, so every single word is junk.
ANALYSIS_KEYWORDS = ANALYSIS_OF_PAGES + f"""ka AS (SELECT source AS grp, word AS text, 'tfidf' AS kind, score, df AS frequency, rank AS place FROM tfidf WHERE rank <= 2000
        UNION ALL SELECT source, ngram, 'ngram', occurrences::DOUBLE, occurrences, 2000 + rank FROM grams g WHERE rank <= 200 AND NOT EXISTS (SELECT 1 FROM tfidf t WHERE t.source = g.source AND t.word = g.ngram AND t.rank <= 2000)),
    kl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY place) AS first_at FROM ka) WHERE first_at <= 2000),
    qu AS (SELECT DISTINCT 'guide to ' || {domain('url')} AS grp, 'What is ' || {UNESCAPE.format('title')} || '?' AS question FROM pages),
    qt AS (SELECT DISTINCT grp, term FROM (SELECT grp, unnest(string_split_regex(lower(question), {SPLIT})) AS term FROM qu) WHERE length(term) >= 3),
    kf AS (SELECT *, 0.55 * 0.85 + 0.30 * (score / greatest(max(score) OVER (PARTITION BY grp), 0.01))
        + CASE WHEN EXISTS (SELECT 1 FROM qt WHERE qt.grp = kl.grp AND list_contains(string_split(text, ' '), term)) THEN 0.15 ELSE 0.0 END AS final, max(frequency) OVER (PARTITION BY grp) AS most FROM kl),
    kz AS (SELECT grp, text, kind, frequency, CASE WHEN {junk('text', '0.0')} OR (contains(text, ' ') AND frequency::DOUBLE / most >= 0.80) THEN 0.0::DOUBLE ELSE final::DOUBLE END AS final FROM kf),
    kn AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY final DESC, text) - 1 AS nth FROM kz),
    hn AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY p.n DESC, k) - 1 AS nth, p.tag AS tag, p.text AS text, p.n AS n FROM cl), """
recursive("page_analysis_keywords", "SELECT k.grp AS keyword, nth::INT AS nth, text, round(final, 6) AS score, frequency, kind AS source FROM kn k JOIN stp ON stp.keyword = k.grp", ANALYSIS_KEYWORDS)
recursive("page_analysis_headings", "SELECT g AS keyword, nth::INT AS nth, tag, text, n AS count FROM hn JOIN stp ON stp.keyword = g", ANALYSIS_KEYWORDS)
recursive(
    "page_outline_briefs",
    """SELECT s.keyword, md5(concat('Outline: ', s.keyword, chr(10), coalesce((SELECT string_agg(upper(tag) || ': ' || text || ' (' || n || ')' || chr(10), '' ORDER BY nth) FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY nth) AS j FROM hn WHERE n >= 2) WHERE g = s.keyword AND j <= 12), ''),
        coalesce((SELECT 'H2: Frequently asked questions' || chr(10) || string_agg('  H3: ' || question || chr(10), '' ORDER BY question) FROM qu WHERE grp = s.keyword), ''))) AS report_md5 FROM stp s""",
    ANALYSIS_KEYWORDS,
)
recursive(
    "page_competitive_briefs",
    """SELECT s.keyword, md5(concat('Competition: ', s.keyword, chr(10), 'Average length ', round_even(avg_words, 0)::BIGINT, ' words, longest ', m.w, chr(10),
        coalesce((SELECT string_agg('  - ' || text || ' (x' || frequency || ')' || chr(10), '' ORDER BY nth) FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY nth) AS j FROM kn WHERE frequency >= 2) WHERE j <= 10) WHERE grp = s.keyword), ''))) AS report_md5
    FROM stp s JOIN (SELECT keyword, max(word_count) AS w FROM pg WHERE word_count > 50 GROUP BY keyword) m ON m.keyword = s.keyword""",
    ANALYSIS_KEYWORDS,
)
recursive(
    "page_keyword_briefs",
    """SELECT s.keyword, md5(concat('Keywords: ', s.keyword, chr(10), 'Primary:', chr(10), coalesce(any_value(l) FILTER (WHERE band = 1), ''), 'Secondary:', chr(10), coalesce(any_value(l) FILTER (WHERE band = 2), ''))) AS report_md5
    FROM stp s LEFT JOIN (SELECT grp, band, string_agg('  - ' || text || ' (' || round_even(final * 100, 0)::INT || '%, x' || frequency || ')' || chr(10), '' ORDER BY nth) AS l
        FROM (SELECT *, row_number() OVER (PARTITION BY grp, band ORDER BY nth) AS j FROM (SELECT *, CASE WHEN final > 0.40 THEN 1 WHEN final > 0.25 THEN 2 END AS band FROM kn)) WHERE j <= 30 AND band IS NOT NULL GROUP BY grp, band) b ON b.grp = s.keyword
    GROUP BY s.keyword""",
    ANALYSIS_KEYWORDS,
)
