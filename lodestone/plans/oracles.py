"""DuckDB SQL for the registered queries, written against the same Parquet tables and literal rows."""

from __future__ import annotations

from lodestone.functions import lists as L
from lodestone.functions.text import any_of
from lodestone.operators.intent import SIGNALS
from lodestone.plans.literals import literal_sql

ORACLE_SQL: dict[str, str] = {}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(column: str, words) -> str:
    return f"{column} IN ({', '.join(map(q, words))})"


def finds(text: str, phrases, prefix: bool = False) -> str:
    """Any phrase occurs (or is a prefix), one test for each."""
    test = "starts_with" if prefix else "contains"
    return "(" + " OR ".join(f"{test}({text}, {q(p)})" for p in phrases) + ")"


def hits(text: str, phrases) -> str:
    return "(" + " + ".join(f"contains({text}, {q(p)})::INT" for p in phrases) + ")"


BLANK = r"[ \t\n\x0B\f\r]"
LOWER_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def toks(text: str) -> str:
    runs = f"regexp_extract_all(translate({text}, '’‘', ''''''), '[A-Za-z'']+')"
    cut = f"list_filter(list_transform({runs}, lambda w: lower(substr(w, 1, 62))), lambda w: length(w) >= 2)"
    stems = f"list_transform({cut}, lambda w: regexp_replace(w, '''[^'']*$', ''))"
    return f"list_filter({stems}, lambda w: length(w) >= 2 AND NOT ({among('w', L.STOP_WORDS)}))"


def words(text: str) -> str:
    return rf"len(regexp_extract_all(coalesce({text}, ''), '[^ \t\n\x0B\f\r]+'))"


def english(text: str) -> str:
    sample = f"list_slice(regexp_extract_all({text}, '[A-Za-z]+'), 1, 2000)"
    found = f"len(list_filter({sample}, lambda w: {among('lower(w)', L.ENGLISH_MARKERS)}))"
    return f"(len({sample}) < 50 OR {found}::DOUBLE / len({sample}) >= 0.08)"


def furniture(line: str) -> str:
    pairs = " OR ".join(f"(contains({line}, {q(a)}) AND contains({line}, {q(b)}))" for a, b in L.LINE_PAIRS)
    size = f"strlen({line})"
    return f"""({finds(line, L.LINE_CONTAINS)} OR {finds(line, L.LINE_URL_PREFIX, True)} OR {pairs}
        OR ({size} < 100 AND ({finds(line, L.LINE_PREFIX_100, True)} OR {finds(line, L.LINE_BIO_100)}))
        OR ({size} < 120 AND {finds(line, L.LINE_URL_120)}) OR ({size} < 80 AND {finds(line, L.LINE_PREFIX_80, True)}) OR ({size} < 40 AND {finds(line, L.LINE_SOCIAL_40)}))"""


def clean(text: str) -> str:
    return f"array_to_string(list_transform(string_split({text}, chr(10)), lambda l: CASE WHEN strlen(l) BETWEEN 1 AND 511 AND {furniture('lower(l)')} THEN repeat(' ', strlen(l)) ELSE l END), chr(10))"


def domain(url: str) -> str:
    return rf"regexp_replace(regexp_extract({url}, '^(?:.*?://)?([^/]*)', 1), '^www\.', '')"


def rejected(text: str) -> str:
    ws = f"list_filter(string_split({text}, ' '), lambda w: w <> '')"
    linking = finds(text, [" to ", " for ", " and ", " of ", " the ", " in ", ":", "?", "!"])
    byline = f"(strlen({text}) < 40 AND len({ws}) BETWEEN 2 AND 3 AND len(list_filter({ws}, lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0 AND NOT {linking})"
    return f"""({finds(f'lower({text})', L.HEADING_BLACKLIST)} OR ends_with({text}, '.') OR starts_with(lower({text}), 'get ') OR {finds(text, ['(R)', '(TM)', '(r)', '(tm)', '®', '™'])}
        OR {byline} OR (strlen({text}) < 15 AND contains({text}, ':')))"""


def valid(url: str) -> str:
    return f"(starts_with({url}, 'http://') OR starts_with({url}, 'https://'))"


def stripped(url: str) -> str:
    kept = f"array_to_string(list_filter(string_split(regexp_extract({url}, '^[^?]*\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT {finds('p', [f'{t}=' for t in L.TRACKING_PARAMS], True)}), '&')"
    return f"CASE WHEN NOT contains({url}, '?') THEN {url} WHEN {kept} = '' THEN split_part({url}, '?', 1) ELSE concat(split_part({url}, '?', 1), '?', {kept}) END"


def listed(host: str, names) -> str:
    return "(" + " OR ".join(f"{host} = {q(n)} OR ends_with({host}, {q('.' + n)})" for n in names) + ")"


def blocked(url: str, names=L.BLOCKLIST) -> str:
    host = f"lower({domain(url)})"
    return f"(ends_with({host}, '.gov') OR contains({host}, '.gov.') OR {listed(host, [*L.AD_DOMAINS, *names])})"


def junk(text: str, similarity: str, known: str = "FALSE") -> str:
    low, phrase = f"lower({text})", f"contains({text}, ' ')"
    ws = f"list_filter(string_split({text}, ' '), lambda w: w <> '')"
    name = f"(length({text}) < 40 AND {phrase} AND len({ws}) BETWEEN 2 AND 3 AND len(list_filter({ws}, lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0)"
    edges = " OR ".join(f"starts_with({low}, {q(w + ' ')}) OR ends_with({low}, {q(' ' + w)})" for w in L.JUNK_EDGE_FILLERS)
    same = among(low, [*L.JUNK_CONTRACTIONS, *L.JUNK_PUBLISHERS, *L.JUNK_TICKERS, *L.JUNK_CHROME])
    return f"""(length({text}) < 2 OR contains({text}, '''') OR {finds(low, L.JUNK_URL_PARTS)} OR {same} OR {finds(low, L.JUNK_CREDIT_PREFIXES, True)}
        OR ({name} AND ({similarity} < 0.10 OR NOT ({known}))) OR (contains({low}, ' by ') AND {finds(low, L.JUNK_BY_PHRASES)})
        OR ({phrase} AND ({edges} OR {finds(low, L.JUNK_PUBLISHER_PARTS)})) OR (NOT {phrase} AND {similarity} < 0.05))"""


ADMITTED = f"adm AS (SELECT source, doc_id, {clean('text')} AS text FROM documents WHERE text IS NOT NULL AND {words('text')} > 50 AND {english('text')}), "
TOKENS = ADMITTED + f"tk AS (SELECT source, doc_id AS doc, {toks('text')} AS t FROM adm WHERE text <> ''), "
VOCAB = "u AS (SELECT source, doc, unnest(t) AS word FROM tk), v AS (SELECT source, word, count(*) AS tf, count(DISTINCT doc) AS df FROM u GROUP BY ALL), "
TFIDF = VOCAB + """n AS (SELECT source, count(*) AS n FROM tk GROUP BY source),
    sc AS (SELECT source, word, ln(1.0 + tf) * df * ln(n::DOUBLE / df) AS score, tf, df FROM v JOIN n USING (source) WHERE df >= 2 AND length(word) >= 3),
    tfidf AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, word) AS rank FROM sc WHERE score >= 0.1), """
GRAMS = """gr AS (
        SELECT source, doc, k.k AS n, p, array_to_string(list_transform(list_slice(t, p + 1, p + k.k), lambda x: substr(x, 1, 40)), ' ') AS ngram
        FROM tk, (VALUES (2), (3)) k(k), unnest(range(0, greatest(len(t) - k.k + 1, 0))) r(p)
    ), gc AS (SELECT source, ngram, count(*) AS occurrences, min((doc, n, p)) AS first_seen FROM gr GROUP BY source, ngram), """
TOP_GRAMS = f"""ge AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first_seen) AS seen FROM gc),
    gk AS (SELECT *, string_split(ngram, ' ') AS w FROM ge WHERE seen <= 10000 AND occurrences >= 2 AND length(ngram) >= 5),
    gf AS (SELECT * FROM gk WHERE NOT ({among('w[1]', L.NGRAM_EDGE_WORDS)}) AND NOT ({among('w[-1]', L.NGRAM_EDGE_WORDS)}) AND len(list_distinct(w)) = len(w)
           AND NOT {finds('ngram', L.NGRAM_CHROME)} AND NOT (len(w) = 2 AND ({among('w[1]', L.NGRAM_FILLERS)} OR {among('w[2]', L.NGRAM_FILLERS)}))),
    gs AS (SELECT *, row_number() OVER (PARTITION BY source, list_sort(w) ORDER BY occurrences DESC, first_seen) AS same FROM gf),
    grams AS (SELECT source, ngram, occurrences, row_number() OVER (PARTITION BY source ORDER BY occurrences DESC, first_seen) AS rank FROM gs WHERE same = 1), """


def sql(name: str, select: str, ctes: str = "") -> None:
    ctes = ctes.strip().rstrip(",")
    ORACLE_SQL[name] = f"WITH {ctes} {select}" if ctes else select


sql("tfidf_top", "SELECT source, word, round(score, 6) AS score, tf, df, rank FROM tfidf WHERE rank <= 20", TOKENS + TFIDF)
sql("vocab_df", "SELECT source, word, tf, df FROM v", f"tk AS (SELECT source, doc_id AS doc, {toks('text')} AS t FROM documents WHERE text <> ''), " + VOCAB)
sql("tokens_count", f"SELECT doc_id, len({toks('text')}) AS n_tokens FROM documents")
sql("token_literals", f"SELECT id, array_to_string({toks('text')}, '|') AS tokens FROM lit_tokens", literal_sql("lit_tokens"))
sql(
    "string_functions",
    rf"""SELECT id, regexp_replace(s, '^{BLANK}+|{BLANK}+$', '', 'g') AS trimmed, {LOWER_ASCII.format('s')} AS low, starts_with(s, 'hello') AS starts, ends_with(s, '.txt') AS ends, contains(s, 'o w') AS holds,
        contains(lower(s), 'mixed') AS holds_any_case, CASE WHEN length(s) > 8 THEN concat(substr(s, 1, 6), '..') ELSE s END AS short,
        regexp_replace(regexp_replace(s, '[^A-Za-z0-9-]', '_', 'g'), '_+$', '') AS stem, to_json({{'s': trim(s, ' ')}})::VARCHAR AS json FROM lit_strings""",
    literal_sql("lit_strings"),
)
sql("english_flag", f"SELECT doc_id, {english('text')} AS english FROM documents")
sql("boilerplate_lines", f"SELECT id, {furniture('lower(line)')} AS boilerplate, md5({clean('line')}) AS clean_md5 FROM lit_lines", literal_sql("lit_lines"))
sql("clean_text", f"SELECT doc_id, md5(c) AS clean_md5, {words('c')} AS n_words FROM c", f"c AS (SELECT doc_id, {clean('text')} AS c FROM documents)")
sql("corpus_admission", "SELECT source, doc_id, strlen(text) AS n_bytes FROM adm", ADMITTED)
sql("word_counts", f"SELECT doc_id, {words('text')} AS n_words FROM documents")
sql("ngram_counts", "SELECT source, ngram, occurrences FROM gc WHERE occurrences >= 2", TOKENS + GRAMS)
sql("ngram_top", "SELECT * FROM grams WHERE rank <= 200", TOKENS + GRAMS + TOP_GRAMS)
sql(
    "keyword_union",
    """SELECT source, text, kind, score, frequency, place FROM (
        SELECT source, text, kind, round(score, 6) AS score, frequency, row_number() OVER (PARTITION BY source ORDER BY kind DESC, rank) AS place FROM both_kinds) WHERE place <= 2000""",
    TOKENS + TFIDF + GRAMS + TOP_GRAMS + """both_kinds AS (
        SELECT source, word AS text, 'tfidf' AS kind, score, df AS frequency, rank FROM tfidf WHERE rank <= 100
        UNION ALL SELECT source, ngram, 'ngram', occurrences, occurrences, rank FROM grams g WHERE rank <= 50
            AND NOT EXISTS (SELECT 1 FROM tfidf t WHERE t.source = g.source AND t.word = g.ngram AND t.rank <= 100)), """,
)
sql(
    "page_keywords",
    "SELECT doc_id, word, occurrences, rank FROM r WHERE rank <= 30",
    f"""p AS (SELECT doc_id, list_filter({toks('text')}, lambda w: length(w) >= 4) AS t FROM documents WHERE text IS NOT NULL AND {words('text')} > 50),
    w AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS place FROM p), c AS (SELECT doc_id, word, count(*) AS occurrences, min(place) AS f FROM w GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY occurrences DESC, f) AS rank FROM c WHERE occurrences >= 2), """,
)
FIGURES = f"""f AS (SELECT source, {words('text')} AS w, n_chars AS n FROM documents),
    st AS (SELECT source, count(*) AS n_pages, list_sort(list(w))[CAST(floor(count(*) / 2) AS INT) + 1] AS median_words, min(w) AS min_words, max(w) AS max_words, avg(w) AS avg_words,
           avg(n % 7) AS avg_h2, avg(n % 11) AS avg_h3, avg(n % 18) AS avg_headings, avg(n % 5) AS avg_outbound, avg(n % 23) AS avg_internal FROM f WHERE w > 50 GROUP BY source), """
sql("content_stats", "SELECT source, n_pages, median_words, min_words, max_words, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("avg_words", "avg_h2", "avg_h3", "avg_headings", "avg_outbound", "avg_internal")) + " FROM st", FIGURES)
sql(
    "recommendations",
    "SELECT source, recommended_words, recommended_headings, floor(round(recommended_words * 1.3, 4))::BIGINT AS upper_words FROM r",
    FIGURES + "r AS (SELECT source, floor(round(avg_words * 1.1, 4))::BIGINT AS recommended_words, least(greatest(floor(avg_h2 + 2), 5), 15)::BIGINT AS recommended_headings FROM st), ",
)
sql("heading_furniture", "SELECT id, expected AS rejected FROM lit_furniture", literal_sql("lit_furniture"))
sql("heading_reject", f"SELECT grp, page, nth, {rejected('text')} AS rejected FROM lit_headings", literal_sql("lit_headings"))
HEADINGS = f"""l AS (SELECT source, doc_id, {words('text')} AS w, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS h FROM documents),
    hd AS (SELECT source, doc_id AS page, unnest(range(least(len(h), 30)))::INT AS nth, 'h2' AS tag, unnest(list_slice(h, 1, 30)) AS text FROM l WHERE w > 50 AND len(h)::DOUBLE / w <= 0.10), """
sql("heading_admission", "SELECT * FROM hd", HEADINGS)
PATTERNS = "SELECT {0}, tag, lower(text) AS text, count(*) AS count, count(DISTINCT page) AS pages FROM {1} WHERE NOT {2} GROUP BY {0}, tag, lower(text)"
sql("heading_patterns_exact", PATTERNS.format("source", "hd", rejected("text")), HEADINGS)
sql("heading_patterns_literal", PATTERNS.format("grp", "lit_headings", rejected("text")), literal_sql("lit_headings"))


def window_ctes(rows: str) -> str:
    """rows(keyword, doc_id, text) to win(keyword, wtext); bytes of a text are cut at 500."""
    return f"""wp AS (SELECT keyword, doc_id, CASE WHEN strlen(text) <= 500 THEN text ELSE cut END AS part, least(strlen(text), 500) AS b FROM (
            SELECT *, (SELECT string_agg(c, '' ORDER BY i) FROM (SELECT i, c, sum(strlen(c)) OVER (ORDER BY i) AS upto FROM (SELECT unnest(string_split(substr(text, 1, 500), '')) AS c, generate_subscripts(string_split(substr(text, 1, 500), ''), 1) AS i)) WHERE upto <= 500) AS cut FROM {rows})),
    wo AS (SELECT *, strlen(keyword) + 1 + coalesce(sum(strlen(part) + 1) OVER (PARTITION BY keyword ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM wp),
    win AS (SELECT keyword, lower(concat(keyword, ' ', string_agg(part || ' ', '' ORDER BY doc_id))) AS wtext FROM wo WHERE before < 7692 GROUP BY keyword), """


def intents(rows: str) -> str:
    low = "lower(keyword)"
    cells = []
    for name, phrases in SIGNALS.items():
        score = "(" + " + ".join(f"CASE WHEN contains({low}, {q(s)}) THEN 3.0::DOUBLE WHEN contains(wtext, {q(s)}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for s in phrases) + ")"
        if name in ("commercial", "transactional"):
            score = f"CASE WHEN {finds(low, L.INFO_OVERRIDES)} THEN greatest({score} - 2.0, 0.0)::DOUBLE ELSE {score} END"
        cells.append(f"{score} AS {name}")
    return f"sc AS (SELECT keyword, {', '.join(cells)} FROM {rows}), "


NAMES = list(SIGNALS)
BEST = f"greatest({', '.join(NAMES)})"
PRIMARY = "CASE " + " ".join(f"WHEN {n} = {BEST} THEN {q(n)}" for n in NAMES) + " END AS primary_intent"
sql("intent_scores", f"SELECT keyword, {', '.join(NAMES)}, {PRIMARY}, round(commercial / greatest({' + '.join(NAMES)}, 1.0), 6) AS commercial_share FROM sc", literal_sql("lit_intents") + window_ctes("lit_intents") + intents("win"))


def type_cells() -> str:
    low = "lower(keyword)"
    gains: dict[str, list[str]] = {t: ["0"] for t in L.CONTENT_TYPES}
    for phrases, effect in L.TYPE_KEYWORD_RULES:
        for kind, gain in effect.items():
            gains[kind].append(f"CASE WHEN {finds(low, phrases)} THEN {gain} ELSE 0 END")
    for kind, phrases in L.TYPE_PAGE_SIGNALS.items():
        gains[kind].append(f"CASE WHEN {hits('wtext', phrases)} >= 2 THEN 1 ELSE 0 END")
    gains["article"] = ["1"]
    return ", ".join(f"{' + '.join(g)} AS t{n}" for n, g in enumerate(gains.values()))


TYPES = [f"t{n}" for n in range(len(L.CONTENT_TYPES))]
sql(
    "content_type",
    "SELECT keyword, CASE " + " ".join(f"WHEN {t} = greatest({', '.join(TYPES)}) THEN {q(name)}" for t, name in zip(TYPES, L.CONTENT_TYPES)) + " END AS content_type FROM ty",
    literal_sql("lit_intents") + window_ctes("lit_intents") + f"ty AS (SELECT keyword, {type_cells()} FROM win), ",
)
sql(
    "tone",
    "SELECT keyword, formal, casual, technical, CASE WHEN technical > formal AND technical > casual THEN 'technical' WHEN formal > casual THEN 'formal' ELSE 'conversational' END AS tone FROM s",
    literal_sql("lit_intents") + window_ctes("lit_intents") + f"""s AS (SELECT keyword, 3 * {hits('wtext', L.TONE_FORMAL_3)} + {hits('wtext', L.TONE_FORMAL_1)} AS formal,
        3 * {hits('wtext', L.TONE_CASUAL_3)} + {hits('wtext', L.TONE_CASUAL_1)} AS casual, 2 * {hits('wtext', L.TONE_TECHNICAL_2)} AS technical FROM win), """,
)
SPLIT = "'[ ?.,!;:''\"()-]+'"
TERMS = f"gt AS (SELECT DISTINCT grp, term FROM (SELECT grp, unnest(string_split_regex(lower(phrase), {SPLIT})) AS term FROM lit_questions) WHERE length(term) >= 3), "
sql("google_terms", "SELECT * FROM gt", literal_sql("lit_questions") + TERMS)
sql("google_terms_benchmark", f"SELECT DISTINCT grp, term FROM (SELECT item_id % 5 AS grp, unnest(string_split_regex(lower(text), {SPLIT})) AS term FROM benchmark) WHERE length(term) >= 3")
FREQ = r"""fl AS (SELECT nth, regexp_extract(value, '^\s*(\S+)\s+\d+', 1) AS word FROM lit_freq), fr AS (SELECT lower(word) AS word, row_number() OVER (ORDER BY nth) AS rank FROM fl WHERE word <> ''),
    freq AS (SELECT word, max(rank)::INT AS rank FROM fr GROUP BY word), """
sql("frequency_table", "SELECT * FROM freq", literal_sql("lit_freq") + FREQ)


def rescored(semantic: bool) -> str:
    final = "0.35 * cfr + 0.45 * sem + 0.20 * tfidf + boost" if semantic else "0.55 * cfr + 0.30 * tfidf + boost"
    sem = "least(greatest(similarity, 0.0), 1.0)::DOUBLE" if semantic else "0.0::DOUBLE"
    return (
        literal_sql("lit_keywords", "lit_questions", "lit_freq") + TERMS + FREQ
        + f"""r1 AS (SELECT k.grp, text, source, score, frequency, coalesce(f.rank, -1) AS word_rank, {sem} AS sem, score / greatest(max(score) OVER (PARTITION BY k.grp), 0.01) AS tfidf,
            CASE WHEN EXISTS (SELECT 1 FROM gt WHERE gt.grp = k.grp AND list_contains(string_split(text, ' '), term)) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM lit_keywords k LEFT JOIN freq f ON f.word = k.text),
        r2 AS (SELECT *, CASE WHEN word_rank > 0 THEN sqrt(word_rank / 50000.0) ELSE 0.85::DOUBLE END AS cfr FROM r1), r3 AS (SELECT *, {final} AS final FROM r2), """
    )


ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("cfr", "sem", "tfidf", "boost", "final"))
sql("rescore_heuristic", f"SELECT grp, text, source, frequency, word_rank, {ROUNDED} FROM r3", rescored(False))
sql("rescore_semantic", f"SELECT grp, text, source, frequency, word_rank, {ROUNDED} FROM r3", rescored(True))
sql("junk_flags", f"SELECT grp, text, {junk('text', 'similarity')} AS junk FROM lit_keywords", literal_sql("lit_keywords"))
DEJUNKED = rescored(True) + f"""jk AS (SELECT grp, text, source, {junk('text', 'sem', 'word_rank > 0')} AS junk,
    CASE WHEN {junk('text', 'sem', 'word_rank > 0')} OR (contains(text, ' ') AND frequency::DOUBLE / max(frequency) OVER (PARTITION BY grp) >= 0.80 AND sem < 0.40) THEN 0.0::DOUBLE ELSE final END AS final FROM r3), """
sql("uniform_filter", "SELECT grp, text, junk, round(final, 6) AS final FROM jk", DEJUNKED)
sql(
    "keyword_tiers",
    "SELECT grp, text, tier, place, round(final, 6) AS final FROM pl WHERE place <= CASE tier WHEN 'primary_phrase' THEN 3 WHEN 'primary_word' THEN 1 ELSE 3 END",
    DEJUNKED + """k1 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY final DESC, text) AS nth, count(*) OVER (PARTITION BY grp) AS total, count(*) FILTER (WHERE final > 0.40) OVER (PARTITION BY grp) AS above FROM jk),
    k2 AS (SELECT *, CASE WHEN above > 4 AND total > 4 THEN max(CASE WHEN nth = 5 THEN final END) OVER (PARTITION BY grp) + 0.001 ELSE 0.40 END AS bar FROM k1),
    k3 AS (SELECT *, max((final > bar)::INT) OVER (PARTITION BY grp) AS available FROM k2),
    tr AS (SELECT grp, text, 'primary_phrase' AS tier, nth, final FROM k3 WHERE source = 'ngram' AND final > bar
        UNION ALL SELECT grp, text, 'primary_word', nth, final FROM k3 w WHERE source = 'tfidf' AND final > 0.25 AND available = 1
            AND NOT EXISTS (SELECT 1 FROM k3 p WHERE p.grp = w.grp AND p.source = 'ngram' AND p.final > 0.25 AND contains(p.text, w.text))
        UNION ALL SELECT grp, text, 'secondary', nth, final FROM k3 WHERE final > 0.25 AND final <= bar),
    pl AS (SELECT *, row_number() OVER (PARTITION BY grp, tier ORDER BY nth) AS place FROM tr), """,
)
GAP = literal_sql("lit_drafts", "lit_keywords", "lit_headings") + f"""st(grp, aw, rh) AS (VALUES ('a', 1500.0::DOUBLE, 0), ('b', 20.0::DOUBLE, 7)),
    hg AS (SELECT grp, lower(text) AS text, min(page * 100 + nth) AS place FROM lit_headings GROUP BY ALL HAVING count(*) >= 2),
    dr AS (SELECT grp, draft_id, lower(draft) AS low, {words('draft')} AS user_words FROM lit_drafts),
    kc AS (SELECT d.grp, draft_id, avg(contains(low, lower(text))::INT) * 100 AS c, array_to_string(list(text ORDER BY place) FILTER (WHERE NOT contains(low, lower(text))), '|') AS m FROM dr d JOIN lit_keywords k ON k.grp = d.grp GROUP BY ALL),
    hc AS (SELECT d.grp, draft_id, avg(contains(low, text)::INT) * 100 AS c, array_to_string(list(text ORDER BY place) FILTER (WHERE NOT contains(low, text)), '|') AS m FROM dr d JOIN hg h ON h.grp = d.grp GROUP BY ALL), """
sql(
    "gap_coverage",
    """SELECT d.grp, d.draft_id, user_words, round(coalesce(k.c, 100.0), 6) AS keyword_coverage, round(coalesce(h.c, 100.0), 6) AS heading_coverage, round(user_words / aw, 6) AS word_ratio,
        greatest(floor(round(aw * 1.1, 4))::BIGINT - user_words, 0) AS words_needed, (CASE WHEN rh > 0 THEN rh ELSE 5 END)::BIGINT AS headings_needed
    FROM dr d JOIN st ON st.grp = d.grp LEFT JOIN kc k ON k.grp = d.grp AND k.draft_id = d.draft_id LEFT JOIN hc h ON h.grp = d.grp AND h.draft_id = d.draft_id""",
    GAP,
)
sql("gap_missing", "SELECT d.grp, d.draft_id, coalesce(k.m, '') AS missing_keywords, coalesce(h.m, '') AS missing_headings FROM dr d LEFT JOIN kc k ON k.grp = d.grp AND k.draft_id = d.draft_id LEFT JOIN hc h ON h.grp = d.grp AND h.draft_id = d.draft_id", GAP)
COSINE = "round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6)"
sql("cosine_topk", f"SELECT vec_id, {COSINE} AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 50")
sql("vector_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
sql("softmax3", "SELECT id, round(exp(logits[3] - list_max(logits)) / list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))), 9) AS entailment FROM lit_logits", literal_sql("lit_logits"))
sql(
    "mean_pool",
    "SELECT label, round(sqrt(sum(m * m) / any_value(l)), 6) AS norm, round(max(CASE WHEN i = 1 THEN m END) / sqrt(any_value(l)), 6) AS first FROM (SELECT *, sum(m * m) OVER (PARTITION BY label) AS l FROM p) GROUP BY label",
    """c AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 2 = 1),
    p AS (SELECT label, i, avg(x) AS m FROM c GROUP BY label, i), """,
)
sql("token_pool", "SELECT * FROM (VALUES (1, '0.6 0.8'), (2, '0.707107 0.707107 0.0'), (3, '0.0 0.0')) v(id, pooled)")
sql("heading_prune", "SELECT vec_id, vec_id % 3 AS count FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) >= 0.15 OR vec_id % 3 >= 2")
sql("url_domain", f"SELECT page_id, {domain('url')} AS domain, {valid('url')} AS valid FROM pages")
sql("url_strip_tracking", f"SELECT page_id, {stripped('url')} AS url FROM pages")
sql(
    "url_resolve",
    rf"""SELECT id, CASE WHEN {valid('href')} THEN href WHEN starts_with(href, '/') THEN concat(regexp_extract(base, '^((?:[^/]*://)?[^/]*)', 1), href)
        WHEN regexp_extract(base, '^(?:[^/]*://)?[^/]*(/.*)$', 1) <> '' THEN concat(regexp_extract(base, '^(.*/)', 1), href) ELSE concat(base, '/', href) END AS resolved,
        {domain('base')} AS domain, {valid('base')} AS valid, {stripped('href')} AS stripped FROM lit_urls""",
    literal_sql("lit_urls"),
)
HOST = f"lower({domain('url')})"
sql("gov_filter", f"SELECT id, ends_with({HOST}, '.gov') OR contains({HOST}, '.gov.') AS gov, {finds('lower(url)', L.JUNK_URL)} AS junk FROM lit_block", literal_sql("lit_block"))
sql("ad_filter", f"SELECT * FROM lit_block WHERE {listed(HOST, L.AD_DOMAINS)}", literal_sql("lit_block"))
sql("blocked_antijoin", f"SELECT * FROM lit_block WHERE NOT {blocked('url')}", literal_sql("lit_block"))
sql("blocked_pages", f"SELECT page_id, url FROM pages WHERE NOT {blocked('url', ['site1.example', 'example.org'])}")
sql("blocklist_edit", "SELECT * FROM (VALUES ('a.com'), ('c.com')) v(listed)")
sql("junk_url", f"SELECT page_id, {finds('lower(url)', L.JUNK_URL)} AS junk FROM pages")
RANKED = literal_sql("lit_serp") + f"rk AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY page, idx)::INT AS rank FROM lit_serp WHERE NOT {blocked('url')}), "
sql("url_dedup_rank", "SELECT keyword, url, rank, page * 10 + idx + 1 AS absolute FROM (SELECT *, row_number() OVER (PARTITION BY keyword, url ORDER BY rank) AS nth FROM rk) WHERE nth = 1", RANKED)
BY_URL = "OVER (PARTITION BY url ORDER BY keyword_idx, page, idx)"
sql("batch_dedup_bridge", f"SELECT keyword, page, idx, url, rank, first(keyword) {BY_URL} AS owner, row_number() {BY_URL} = 1 AS fetched FROM rk", RANKED)
sql(
    "run_counters",
    "SELECT keyword, count(*) AS n_results, count(*) - coalesce(any_value(k), 0) AS n_blocked, coalesce(any_value(k), 0) - coalesce(any_value(d), 0) AS n_duplicates FROM lit_serp LEFT JOIN (SELECT keyword, count(*) AS k, count(DISTINCT url) AS d FROM rk GROUP BY keyword) USING (keyword) GROUP BY keyword",
    RANKED,
)
sql(
    "keyword_success",
    "SELECT keyword, count(*) AS n_pages, count(*) FILTER (WHERE coalesce(word_count, 0) > 50) AS n_good, count(*) FILTER (WHERE coalesce(word_count, 0) > 50) = 0 AS retry FROM (SELECT DISTINCT keyword, url FROM lit_serp) LEFT JOIN (SELECT DISTINCT url, word_count FROM lit_links) USING (url) GROUP BY keyword",
    literal_sql("lit_serp", "lit_links"),
)
sql(
    "outbound_candidates",
    "SELECT row_number() OVER (ORDER BY page_idx, link_nth)::INT AS place, link AS url, url AS source_url FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_idx, link_nth) AS nth FROM g) WHERE nth = 1",
    literal_sql("lit_links") + f"g AS (SELECT * FROM lit_links WHERE word_count > 50 AND is_outbound AND {valid('link')} AND NOT {finds('lower(link)', L.JUNK_URL)} AND NOT {blocked('link')} AND link NOT IN (SELECT url FROM lit_links)), ",
)
sql("stored_links", f"SELECT url AS source_url, link AS url, 'to ' || link AS anchor_text FROM lit_links WHERE is_outbound AND {valid('link')} AND NOT {blocked('link')}", literal_sql("lit_links"))
QUEUE = """qu AS (SELECT 'https://host' || event_id % 97 || '.com/' || event_id AS url, event_type AS keyword, 'host' || event_id % 97 || '.com' AS domain, 'title ' || event_id % 13 AS title, 's' AS snippet,
    (event_id % 50)::INT AS serp_position, (event_id % 3)::INT AS serp_page, ['pending', 'scraped', 'failed', 'pending'][event_id % 4 + 1] AS status, ts AS created_at, (event_id % 700)::INT AS word_count,
    (event_id % 5 = 0)::INT AS is_crawled, '' AS source_url, event_id FROM events), """
sql("pending_queue", "SELECT url, keyword, created_at FROM qu WHERE status = 'pending' ORDER BY created_at, url, keyword LIMIT 100", QUEUE)
sql("pending_rich", "SELECT url, keyword, domain, title, serp_position FROM qu WHERE status = 'pending' ORDER BY keyword, serp_position, url LIMIT 100", QUEUE)
sql("pending_count", "SELECT count(*) AS n_pending FROM qu WHERE status = 'pending'", QUEUE)
sql("results_scan", "SELECT url, keyword, is_crawled, serp_position, status FROM qu WHERE status IN ('scraped', 'failed') AND keyword = 'click'", QUEUE)
sql("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 7")
UPSERT = QUEUE + """nw AS (SELECT url, keyword, CASE WHEN event_id % 12 = 0 THEN 'changed' ELSE title END AS title, CASE WHEN event_id % 18 = 0 THEN 1 ELSE serp_position END AS serp_position FROM qu WHERE event_id % 6 = 0
    UNION ALL SELECT url || '/new', keyword, title, serp_position FROM qu WHERE event_id % 30 = 0), """
sql(
    "upsert_results",
    """SELECT coalesce(n.url, o.url) AS url, coalesce(n.keyword, o.keyword) AS keyword, coalesce(n.title, o.title) AS title, coalesce(n.serp_position, o.serp_position) AS serp_position, coalesce(o.status, 'pending') AS status,
        coalesce(o.created_at, TIMESTAMP '2026-01-01 00:00:00') AS created_at FROM qu o FULL JOIN nw n ON n.url = o.url AND n.keyword = o.keyword""",
    UPSERT,
)
sql("results_history", "SELECT o.url, o.keyword, o.serp_position, o.title, TIMESTAMP '2026-01-01 00:00:00' AS recorded_at FROM qu o JOIN nw n ON n.url = o.url AND n.keyword = o.keyword WHERE n.serp_position <> o.serp_position OR n.title <> o.title", UPSERT)
sql(
    "insert_ignore",
    """SELECT domain AS source_url, title AS obl_url, event_id FROM qu UNION ALL
    SELECT domain, title, event_id FROM (SELECT *, row_number() OVER (PARTITION BY domain, title ORDER BY event_id) AS nth FROM nw) n
    WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM qu o WHERE o.domain = n.domain AND o.title = n.title)""",
    QUEUE + "nw AS (SELECT domain, CASE WHEN event_id % 3 = 0 THEN concat(title, ' ', event_id % 50) ELSE title END AS title, event_id FROM qu), ",
)
sql(
    "replace_sessions",
    """SELECT c_name AS keyword, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 0.0 ELSE c_acctbal END AS value, c_custkey FROM customer
    UNION ALL SELECT c_name || ' new', 0.0, c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1""",
)
sql(
    "update_scraped",
    """SELECT url, keyword, CASE WHEN event_id % 7 = 0 THEN 'scraped' ELSE status END AS status, CASE WHEN event_id % 7 = 0 THEN 999 ELSE word_count END AS word_count,
    CASE WHEN event_id % 14 = 0 THEN 1 ELSE is_crawled END AS is_crawled, CASE WHEN event_id % 21 = 0 THEN 'https://parent' ELSE source_url END AS source_url FROM qu""",
    QUEUE,
)
sql("delete_pending", "SELECT url, keyword, status FROM qu WHERE NOT (event_id % 5 = 0 AND status = 'pending')", QUEUE)
sql("cascade_delete", "SELECT keyword, count(*) AS n, t FROM qu, (VALUES ('results'), ('links')) v(t) WHERE event_id % 9 <> 0 GROUP BY keyword, t", QUEUE)
sql(
    "replace_children",
    """SELECT l_orderkey AS key, l_linenumber AS ordinal, l_returnflag AS tag FROM lineitem WHERE l_orderkey NOT IN (SELECT key FROM p)
    UNION ALL SELECT key, 0, 'x' FROM p UNION ALL SELECT key, 1, o_orderstatus FROM p""",
    "p AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE -1 - o_orderkey END AS key, o_orderstatus FROM orders), ",
)
LAG = "lag(event_id % 100) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id)"
sql("position_lag", f"SELECT event_type AS keyword, 'u' || user_id AS domain, event_id, event_id % 100 AS position, {LAG} AS previous, event_id % 100 - {LAG} AS change FROM events")
sql(
    "parent_child",
    """SELECT CASE WHEN r_regionkey < 4 THEN 'r' ELSE 'x' END || r_regionkey AS url, r_regionkey AS parent_place, 0 AS is_child, FALSE AS is_orphan, r_regionkey AS place FROM region
    UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_regionkey < 4 THEN n_regionkey ELSE n_nationkey + 100 END, (n_regionkey < 4)::INT, n_regionkey >= 4, n_nationkey + 100 FROM nation""",
)
sql(
    "page_detail",
    """SELECT o_orderkey AS url, o_orderstatus AS keyword, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS tags, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS links, count(l_linenumber) AS n_keywords
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
)
sql("sessions_by_date", "SELECT keyword, updated_at, strftime(updated_at, '%Y-%m-%d %H:%M') AS updated FROM lit_sessions", literal_sql("lit_sessions"))
sql(
    "session_summary",
    "SELECT * FROM (VALUES ('new', 3, 'commercial', 'review', 'formal', 1200.0::DOUBLE, 1, 1, 2, 'Mar 31'), ('old', 2, 'informational', 'guide', 'casual', 800.5::DOUBLE, 1, 0, 0, 'Dec 1'), ('bad', 0, '', '', '', 0.0::DOUBLE, 0, 0, 0, 'Jan 5'), ('own', 1, 'transactional', 'product', 'casual', 0.0::DOUBLE, 0, 2, 0, 'Apr 5')) v(keyword, n_keywords, intent, content_type, tone, avg_words, n_pages, n_questions, n_related, updated)",
)
sql("bio_decode", "SELECT * FROM (VALUES (1, 0, 'John Smithson', 'PER'), (1, 4, 'New York', 'LOC'), (1, 6, 'Acme in', 'ORG'), (2, 2, 'abc', 'ORG'), (2, 4, 'Rome', 'LOC'), (2, 5, 'Rome', 'LOC')) v(doc_id, start, text, label) WHERE text <> 'abc'")
sql(
    "entity_merge",
    "SELECT p_brand, text, label, frequency, frequency AS sources, documents, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY frequency DESC, f) AS rank FROM e WHERE seen <= 200) WHERE rank <= 200",
    """w AS (SELECT p_brand, p_partkey, unnest(string_split(p_name, ' ')) AS text, generate_subscripts(string_split(p_name, ' '), 1) AS pos, (p_size % 4)::VARCHAR AS label FROM part),
    c AS (SELECT p_brand, text, label, count(*) AS frequency, count(DISTINCT p_partkey) AS documents, min((p_partkey, pos)) AS f FROM w GROUP BY p_brand, text, label), e AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY f) AS seen FROM c), """,
)
sql("render_choice", f"SELECT page_id, (word_count > 0 AND (word_count < 200 OR (word_count < 500 AND {finds('lower(html)', L.JS_MARKERS)}))) OR (word_count = 0 AND strlen(html) > 500) AS needs, word_count > 200 AND p_tags < 3 AS non_article, strlen(html) > 4 AND {finds('html', ['%PDF', 'GIF', 'PK'], True)} AS is_binary FROM lit_pages", literal_sql("lit_pages"))
sql(
    "render_merge",
    """SELECT p.page_id, CASE WHEN coalesce(r.word_count > p.word_count, FALSE) THEN r.word_count ELSE p.word_count END AS word_count, CASE WHEN coalesce(r.word_count > p.word_count, FALSE) THEN 9 ELSE p_tags END AS p_tags,
    md5(coalesce(page_text, html)) AS text_md5, coalesce(r.word_count > p.word_count, FALSE) AS used_rendering FROM lit_pages p LEFT JOIN lit_rendered r ON r.page_id = p.page_id""",
    literal_sql("lit_pages", "lit_rendered"),
)
sql(
    "organic_results",
    f"""SELECT keyword, page, idx, pos AS position, page * 10 + pos AS absolute, title, link, snippet, {domain('link')} AS domain, '' AS date FROM (
        SELECT keyword, page, idx, coalesce((r->>'$.position')::INT, idx + 1) AS pos, coalesce(r->>'$.title', '') AS title, coalesce(r->>'$.link', '') AS link, coalesce(r->>'$.snippet', '') AS snippet FROM o)""",
    literal_sql("lit_serp_json") + """s AS (SELECT *, coalesce(json_array_length(body, '$.organic'), 0) AS n FROM lit_serp_json), k AS (SELECT * FROM s WHERE page < (SELECT coalesce(min(page), 1000) FROM s z WHERE z.keyword = s.keyword AND z.n = 0)),
    o AS (SELECT keyword, page, unnest(json_extract(body, '$.organic[*]')) AS r, unnest(range(n::BIGINT))::INT AS idx FROM k), """,
)
sql(
    "questions_related",
    "SELECT * FROM (VALUES ('k1', 0, 'What is a shoe?'), ('k1', 0, 'trail shoes'), ('k1', 1, 'cheap shoes')) v(keyword, ordinal, phrase)",
)
sql("knowledge_graph", "SELECT keyword, body->>'$.knowledgeGraph.title' AS title, body->>'$.knowledgeGraph.type' AS type, body->>'$.knowledgeGraph.description' AS description FROM lit_serp_json WHERE (body->'$.knowledgeGraph') IS NOT NULL", literal_sql("lit_serp_json"))
sql(
    "keyword_batch",
    "SELECT (row_number() OVER (ORDER BY nth) - 1)::INT AS idx, k AS keyword FROM l WHERE k <> ''",
    literal_sql("lit_input") + rf"p AS (SELECT string_split_regex(input, '[\r\n]+') AS a FROM lit_input), l AS (SELECT regexp_replace(unnest(a), '^{BLANK}+|{BLANK}+$', '', 'g') AS k, generate_subscripts(a, 1) AS nth FROM p), ",
)
sql("proxy_lines", "SELECT * FROM (VALUES ('http', 'h1.com', 8080, 'u', 'p'), ('http', 'h2.com', 3128, '', ''), ('http', 'h3.com', 1080, 'user', 'pass'), ('socks5', 'h4.com', 9, '', '')) v(scheme, host, port, \"user\", password)")
sql(
    "outline_select",
    "SELECT grp AS keyword, row_number() OVER (PARTITION BY grp ORDER BY count DESC, text, tag)::INT AS place, tag, text, count FROM h WHERE count >= 2 AND NOT regexp_matches(text, '^[0-9]{1,2}\\.')",
    literal_sql("lit_headings") + "h AS (SELECT grp, tag, lower(text) AS text, count(*) AS count FROM lit_headings GROUP BY ALL), ",
)
sql("export_text_lines", "SELECT grp, place, concat(text, '|', printf('%.3f', score), '|', frequency, '|', source) AS line FROM lit_keywords", literal_sql("lit_keywords"))
sql("copied_lines", "SELECT nth, regexp_extract(ltrim(line), '^(.*?)(?:  |$)', 1) AS line FROM lit_copy WHERE line <> '' AND NOT starts_with(line, '=') AND NOT starts_with(line, '-')", literal_sql("lit_copy"))
sql("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
sql("ready_keywords", "SELECT keyword FROM qu WHERE NOT (keyword = 'click' AND status = 'pending') GROUP BY keyword HAVING count(*) FILTER (WHERE status = 'pending') = 0", QUEUE)
sql("quality_by_source", "SELECT source, count(*) AS n, sum(quality)::BIGINT AS n_good, count(*) FILTER (WHERE toxic = 1) AS n_toxic FROM documents JOIN labels USING (doc_id) GROUP BY source")
sql("latest_order", "SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS ordered FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
UNESCAPE = "trim(replace(regexp_extract(html, '(?i)<{0}[^>]*>([^<]*)</{0}>', 1), '&amp;', '&'))"
sql("page_title", f"SELECT page_id, {UNESCAPE.format('title')} AS title, '' AS meta_description, '' AS error FROM pages")
sql("page_headings", f"SELECT page_id, 'h1' AS tag, trim(regexp_replace({UNESCAPE.format('h1')}, '[^\\x20-\\x7F]', '', 'g')) AS text FROM pages")
LINKS = r"""a AS (SELECT page_id, url AS base, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS x FROM pages),
    b AS (SELECT page_id, base, unnest(h) AS h, trim(unnest(x)) AS text, generate_subscripts(h, 1) - 1 AS nth FROM a), """
sql("page_links", "SELECT page_id, count(h) AS n_links, 0::BIGINT AS outbound FROM pages LEFT JOIN b USING (page_id) GROUP BY page_id", LINKS)
sql("page_link_targets", "SELECT page_id, nth::INT AS nth, regexp_extract(base, '^([^/]*://[^/]*)', 1) || h AS url, text FROM b", LINKS)
SOURCE_TEXTS = ADMITTED + "kw AS (SELECT 'best ' || source AS keyword, doc_id, text FROM adm), "
sql("text_windows", "SELECT keyword, md5(wtext) AS window_md5, strlen(wtext) AS n_bytes FROM win", SOURCE_TEXTS + window_ctes("kw"))
sql("intent_of_sources", f"SELECT keyword, {', '.join(NAMES)}, {PRIMARY} FROM sc", SOURCE_TEXTS + window_ctes("kw") + intents("win"))


def expected(columns: str, *rows: tuple) -> str:
    """A table of answers by hand."""

    def value(v) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else q(v) if isinstance(v, str) else repr(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) v({columns})"


sql("wordpieces", "SELECT id, pieces FROM lit_pieces", literal_sql("lit_pieces"))
sql("wordpiece_ids", expected("id, ids", (1, "2 4 7 9 3"), (2, "2 5 11 6 12 3"), (3, "2 1 7 1 3"), (4, "2 3"), (5, "2 4 4 4 4 3"), (6, "2 8 9 5 3")))
sql(
    "chosen_links",
    expected(
        "place, url, keyword, source_url", (1, "https://new.com/p", "k2", "https://b.com/2"), (2, "ftp://x.com", "k2", "https://b.com/2"), (3, "https://bit.ly/1", "k2", "https://b.com/2"), (4, "https://other.org/q", "k2", "https://b.com/2"),
        (5, "https://b.com/2", "k1", "https://a.com/1"), (6, "https://a.com/in", "k1", "https://a.com/1"), (7, "https://shop.com/checkout", "k1", "https://a.com/1"),
    ),
)
sql("purge", expected("name, n", ("events", 0), ("orders", 0)))
sql("migrate_settings", expected("side, key, value", ("new", "theme", "light"), ("new", "threads", "16")))
sql("log_tail", expected("seq, line", (3, "[??:??:??] WARN  slow"), (4, "[09:00:04] ERR   failed"), (5, "[23:59:59] INFO  done")))
sql("session_keywords", expected("keyword, nth, text, frequency, source", ("new", 0, "a", None, "saved"), ("old", 0, "a", None, "saved"), ("old", 1, "b", None, "saved"), ("own", 0, "k", 3, "ngram")))
sql("session_questions", expected("keyword, nth, question, link", ("new", 0, "q", None), ("own", 0, "plain?", None), ("own", 1, "why?", "l")))
sql(
    "export_round_trip",
    expected(
        "keyword, part, nth, fields", *[("best running shoes", "keywords", n, x) for n, x in enumerate(("running shoes|0.62|9|ngram|0.85", "cushioning|0.41|4|tfidf|0.0", "shoes|0.3|7|tfidf|0.0", "old|0.1|1|tfidf|0.0"))],
        ("best running shoes", "entities", 0, "Acme|ORG|3|2"), *[("best running shoes", "headings", n, x) for n, x in enumerate(("h2|how to choose|3", "h3|Sizing|2", "h2|1. Acme One|2", "h2|Running on trails|1", "h2|Storage|1"))],
        ("best running shoes", "questions", 0, "What is pronation?||"), ("best running shoes", "related", 0, "trail shoes"), ("how to bake", "headings", 0, "h2|Bake it well|1"),
    ),
)
sql("session_pages", expected("keyword, nth, url", ("new", 0, "u"), ("new", 1, "v"), ("old", 0, "u")))
sql("stored_phrases", expected("keyword, questions, related", ("k1", '[{"question":"What is a shoe?","snippet":"s","link":"l"}]', '["trail shoes","cheap shoes"]'), ("k2", "[]", "[]")))
sql(
    "page_records",
    expected(
        "page_id, page_text, title, meta_description, word_count, p_tags, non_article, used_rendering, error, headings, links",
        (1, "Head One two three four z b", "T", "D", 7, 2, False, False, "", "h1|Head", "https://www.a.com/x/z.html|z|false http://b.com/q|b|true"),
        (2, "", "", "", 0, 0, False, False, "Non-HTML content", "", ""), (3, "Rendered part now there are more words here", "", "", 8, 1, False, True, "", "h2|Rendered part", ""),
        (4, "less", "", "", 3, 1, False, False, "", "", ""), (5, "", "", "", 0, 0, False, False, "Non-HTML content", "", ""),
    ),
)
SESSION_JSON = (
    '{"keyword":"k1","keyword_count":0,"pages":['
    '{"domain":"a.com","url":"https://www.a.com/x/y.html","title":"T","meta_desc":"D","words":7,"headings":1,"outbound":1,"internal":1,"scrape_time":0.5,"is_crawled":0,"source_idx":-1,"js_fallback":0,"serp_position":1,"keyword":"k1",'
    '"page_headings":[{"tag":"h1","text":"Head"}],"page_keywords":["one"]},'
    '{"domain":"c.com","url":"https://c.com/","title":"","meta_desc":"","words":8,"headings":1,"outbound":0,"internal":0,"scrape_time":0.5,"is_crawled":0,"source_idx":-1,"js_fallback":1,"serp_position":3,"keyword":"k1",'
    '"page_headings":[{"tag":"h2","text":"Rendered part"}]}],"serp_results":['
    '{"position":1,"title":"T1","link":"https://www.a.com/x","snippet":"s","domain":"a.com"},{"position":2,"title":"T2","link":"https://b.com","snippet":"","domain":"b.com"},{"position":4,"title":"","link":"https://c.com/z","snippet":"","domain":"c.com"}],'
    '"knowledge_graph":{"title":"Shoe","type":"Thing","description":""}}'
)
sql("session_json", expected("keyword, json_data", ("k1", SESSION_JSON), ("k9", '{"keyword":"k9","pages":[]}')))
sql("session_round_trip", expected("keyword, nth, url, title, words, serp_position", ("k1", 0, "https://www.a.com/x/y.html", "T", 7, 1), ("k1", 1, "https://c.com/", "", 8, 3)))
sql("entity_admission", f"SELECT doc_id, {words('text')} AS word_count FROM documents WHERE text <> '' AND {words('text')} > 50")
sql(
    "outline_passes",
    expected(
        "keyword, place, level, text", ("best running shoes", 0, "H2", "how to choose (in 3 pages)"), ("best running shoes", 1, "H3", "Sizing (in 2 pages)"), ("best running shoes", 2, "H2", "Running on trails"),
        ("how to bake", 0, "H2", "Bake it well"), ("how to bake", 1, "H2", "What you need"), ("how to bake", 2, "H2", "Step by step"), ("how to bake", 3, "H2", "Advice that helps"), ("how to bake", 4, "H2", "Common mistakes"), ("how to bake", 5, "H2", "Questions and answers"),
    ),
)
sql("prompt_readers", expected("id, reader", (1, "beginners"), (2, "learners"), (3, "cooks"), (4, "patients"), (5, "everyone"), (6, "comparers"), (7, "buyers"), (8, "everyone")))


def lines(*own: str) -> str:
    return "\n".join(own) + "\n"


SHOES, BAKING = "best running shoes", "how to bake"
SHOES_FULL = lines(
    "Content brief: best running shoes", "Intent: commercial; type: review; tone: conversational", "Length: 1320 words", "", "=== AUDIENCE ===",
    "People who compare before they buy. They need facts in detail and no bias.", "", "=== FORMAT ===", "Write Markdown with H2 and H3 in order.",
    "Begin with a paragraph without heading that draws readers in and has the main keyword.", "End with a description of under 160 characters on a line of its own that begins with META:.", "", "=== KEYWORDS ===",
    "Primary phrases:", "  - running shoes", "Primary words:", "  - cushioning", "Secondary keywords:", "  - shoes", "", "=== ENTITIES ===", "  - Acme (ORG, freq=3)", "", "=== OUTLINE ===", "H2: how to choose (in 3 pages)",
    "  H3: Sizing (in 2 pages)", "H2: Running on trails", "", "=== COMPETITORS ===", "Words: 1200 on average, 800 to 2000, median 1100", "H2 6.5, H3 2.0 on average", "", "=== QUESTIONS ===", "  - What is pronation?", "",
    "=== RELATED SEARCHES ===", "  - trail shoes", "", "=== INSTRUCTIONS ===", '1. Write a review on "best running shoes" in a conversational tone.', "2. Aim at 1320 to 1716 words.",
    "3. Have 8 H2 sections or more, as the best competitors do.", "4. Keep to the outline above, with 150 to 300 words for each H2.", "5. Put the main keyword into the title, the first paragraph, two H2 at least and the conclusion.",
    "6. Let the secondary keywords come up naturally in the text, never by force.", "7. Mention the entities above, which shows knowledge of the subject.",
    "8. Give each question a section: an answer of one or two sentences first, then the details.", "9. Give the related searches sections or full paragraphs.",
    "10. Competitors have 1200 words on average, 800 to 2000; be in their upper quarter.", "", "=== GOAL ===", "Help the reader compare and narrow down; end with a way to decide or a favourite.", "", "=== LINKS ===",
    "Link to 5 pages of the own site where they fit, and to 3 good outside sources.",
)
BAKING_FULL = lines(
    "Content brief: how to bake", "Intent: informational; type: how-to; tone: informal", "", "=== AUDIENCE ===",
    "People who do this for the first time and want every step shown. Take nothing for granted and explain terms where they first come up.", "", "=== FORMAT ===", "Write Markdown with H2 and H3 in order.",
    "Begin with a paragraph without heading that draws readers in and has the main keyword.", "End with a description of under 160 characters on a line of its own that begins with META:.",
    "Number the steps and set the key action of each in bold.", "", "=== OUTLINE ===", "H2: Bake it well", "H2: What you need", "H2: Step by step", "H2: Advice that helps", "H2: Common mistakes", "H2: Questions and answers", "",
    "=== COMPETITORS ===", "Words: 0 on average, 0 to 0, median 0", "H2 0.0, H3 0.0 on average", "", "=== INSTRUCTIONS ===", '1. Write a how-to on "how to bake" in a informal tone.', "2. Aim at 0 to 0 words.",
    "3. Have 5 H2 sections or more, as the best competitors do.", "4. Keep to the outline above, with 150 to 300 words for each H2.", "5. Put the main keyword into the title, the first paragraph, two H2 at least and the conclusion.",
    "6. Let the secondary keywords come up naturally in the text, never by force.", "", "=== GOAL ===", "Answer the reader's need for information in full; end with what can be done with it at once.", "", "=== LINKS ===",
    "Link to 5 pages of the own site where they fit, and to 3 good outside sources.",
)
SHOES_KEYWORDS = lines("Keywords: best running shoes", "Primary:", "  - running shoes (62%, x9)", "  - cushioning (41%, x4)", "Secondary:", "  - shoes (30%, x7)")
SHOES_OUTLINE = lines("Outline: best running shoes", "H2: how to choose (3)", "H3: Sizing (2)", "H2: 1. Acme One (2)", "H2: Frequently asked questions", "  H3: What is pronation?")
SHOES_COMPETITIVE = lines("Competition: best running shoes", "Average length 1200 words, longest 2000", "  - running shoes (x9)", "  - cushioning (x4)", "  - shoes (x7)")
BRIEFS = {"full": SHOES_FULL, "keywords": SHOES_KEYWORDS, "outline": SHOES_OUTLINE, "competitive": SHOES_COMPETITIVE}
BAKING_BRIEFS = {"full": BAKING_FULL, "keywords": lines("Keywords: how to bake", "Primary:", "Secondary:"), "outline": lines("Outline: how to bake"), "competitive": lines("Competition: how to bake", "Average length 0 words, longest 0")}
for _name, _brief in BRIEFS.items():
    sql(f"literal_{_name}", expected("keyword, report", (SHOES, _brief), (BAKING, BAKING_BRIEFS[_name])))
sql(
    "literal_info",
    expected(
        "keyword, report",
        (SHOES, lines(
            "Keyword: best running shoes", "Intent: commercial (80%)", "Type: review, tone: conversational", "Aim: 1320 words, 8 headings", "", "Competitors: 1200 words on average (800 to 2000)", "H2 6.5, H3 2.0 on average", "",
            "Keywords: 4, headings: 5, entities: 1", "", "=== KEYWORDS (4) ===", f"  {'running shoes':<32}  62%  x9  ngram", f"  {'cushioning':<32}  41%  x4  tfidf", f"  {'shoes':<32}  30%  x7  tfidf", f"  {'old':<32}  10%  x1  tfidf", "",
            "=== ENTITIES (1) ===", f"  {'Acme':<32}  {'ORG':<8}  x3", "", "=== HEADINGS (5) ===", f"  [h2] {'how to choose':<40}  3 pages", f"  [h3] {'Sizing':<40}  2 pages", f"  [h2] {'1. Acme One':<40}  2 pages",
            f"  [h2] {'Running on trails':<40}  1 pages", f"  [h2] {'Storage':<40}  1 pages", "", "=== QUESTIONS (1) ===", "  What is pronation?", "", "=== RELATED (1) ===", "  trail shoes",
        )), (BAKING, ""),
    ),
)
sql(
    "literal_markdown",
    expected(
        "keyword, report",
        (SHOES, lines(
            "# best running shoes", "", "## Intent", "", "| intent | share | signals |", "|-|-|-|", "| informational | 20% |  |", "| commercial (main) | 80% | `best` `top` |", "| transactional | 0% |  |", "| navigational | 0% |  |", "",
            "Type review, tone conversational; 1320 words and 8 headings are advised", "", "## Competitors", "", "| figure | value |", "|-|-|", "| words on average | 1200 |", "| words | 800 to 2000 |", "| H2 | 6.5 |", "| H3 | 2.0 |",
            "| outbound links | 4.2 |", "", "## Keywords (4)", "", "| keyword | score | frequency | source |", "|-|-|-|-|", "| running shoes | 0.620 | 9 | ngram |", "| cushioning | 0.410 | 4 | tfidf |", "| shoes | 0.300 | 7 | tfidf |",
            "| old | 0.100 | 1 | tfidf |", "", "## Headings (5)", "", "- H2 how to choose (3 pages)", "- H3 Sizing (2 pages)", "- H2 1. Acme One (2 pages)", "- H2 Running on trails (1 pages)", "- H2 Storage (1 pages)", "", "## Entities", "",
            "- Acme (ORG, 3)", "", "## Questions", "", "- What is pronation?", "", "## Related", "", "- trail shoes", "", "## Brief", "", "```",
        ) + SHOES_FULL + "```\n"),
        (BAKING, lines(
            "# how to bake", "", "## Intent", "", "| intent | share | signals |", "|-|-|-|", "| informational (main) | 0% |  |", "| commercial | 0% |  |", "| transactional | 0% |  |", "| navigational | 0% |  |", "",
            "Type how-to, tone informal; 0 words and 5 headings are advised", "", "## Competitors", "", "| figure | value |", "|-|-|", "| words on average | 0 |", "| words | 0 to 0 |", "| H2 | 0.0 |", "| H3 | 0.0 |", "| outbound links | 0.0 |", "",
            "## Headings (1)", "", "- H2 Bake it well (1 pages)", "", "## Brief", "", "```",
        ) + BAKING_FULL + "```\n"),
    ),
)
sql(
    "literal_text",
    expected(
        "keyword, report",
        (SHOES, lines(
            "[INTENT]", "commercial|review|conversational", "[STATS]", "1200|1100|800|2000", "[KEYWORDS]", "running shoes|0.620|9|ngram", "cushioning|0.410|4|tfidf", "shoes|0.300|7|tfidf", "old|0.100|1|tfidf", "[ENTITIES]", "Acme|ORG|3",
            "[HEADINGS]", "h2|how to choose|3", "h3|Sizing|2", "h2|1. Acme One|2", "h2|Running on trails|1", "h2|Storage|1", "[PAA]", "What is pronation?", "[RELATED]", "trail shoes",
        ) + "".join(f"[PROMPT:{t.upper()}]\n{b}" for t, b in BRIEFS.items())),
        (BAKING, lines("[INTENT]", "informational|how-to|informal", "[STATS]", "0|0|0|0", "[KEYWORDS]", "[ENTITIES]", "[HEADINGS]", "h2|Bake it well|1", "[PAA]", "[RELATED]") + "".join(f"[PROMPT:{t.upper()}]\n{b}" for t, b in BAKING_BRIEFS.items())),
    ),
)
NO_INTENTS = ', "intent_breakdown": {"informational": {"confidence": 0, "score": 0.0, "signals": []}, "commercial": {"confidence": 0, "score": 0.0, "signals": []}, "transactional": {"confidence": 0, "score": 0.0, "signals": []}, "navigational": {"confidence": 0, "score": 0.0, "signals": []}}'
sql(
    "literal_json",
    expected(
        "keyword, report",
        (SHOES, '{"keyword": "best running shoes", "intent": "commercial", "content_type": "review", "tone": "conversational", "recommended_words": 1320, "recommended_headings": 8, "analysis_time": 0.0, "keyword_count": 4, '
         '"entity_count": 1, "heading_count": 5, "keywords": [{"text": "running shoes", "score": 0.62, "freq": 9, "src": "ngram", "cfr": 0.85, "sem": 0.0, "tfidf": 0.0, "boost": 0.0}, '
         '{"text": "cushioning", "score": 0.41, "freq": 4, "src": "tfidf", "cfr": 0.0, "sem": 0.0, "tfidf": 0.0, "boost": 0.0}, {"text": "shoes", "score": 0.3, "freq": 7, "src": "tfidf", "cfr": 0.0, "sem": 0.0, "tfidf": 0.0, "boost": 0.0}, '
         '{"text": "old", "score": 0.1, "freq": 1, "src": "tfidf", "cfr": 0.0, "sem": 0.0, "tfidf": 0.0, "boost": 0.0}], "entities": [{"text": "Acme", "label": "ORG", "freq": 3, "sources": 2}], '
         '"stats": {"avg_words": 1200, "median_words": 1100, "min_words": 800, "max_words": 2000, "avg_h2": 6.5, "avg_h3": 2.0, "avg_headings": 0.0, "avg_outbound": 4.2, "avg_internal": 0.0}, '
         '"intent_breakdown": {"informational": {"confidence": 20, "score": 1.0, "signals": []}, "commercial": {"confidence": 80, "score": 4.0, "signals": ["best", "top"]}, '
         '"transactional": {"confidence": 0, "score": 0.0, "signals": []}, "navigational": {"confidence": 0, "score": 0.0, "signals": []}}, "heading_patterns": [{"tag": "h2", "text": "how to choose", "count": 3}, '
         '{"tag": "h3", "text": "Sizing", "count": 2}, {"tag": "h2", "text": "1. Acme One", "count": 2}, {"tag": "h2", "text": "Running on trails", "count": 1}, {"tag": "h2", "text": "Storage", "count": 1}], '
         '"people_also_ask": [{"question": "What is pronation?", "snippet": "", "link": ""}], "related_searches": ["trail shoes"]}'),
        (BAKING, '{"keyword": "how to bake", "intent": "informational", "content_type": "how-to", "tone": "informal", "recommended_words": 0, "recommended_headings": 5, "analysis_time": 0.0, "keyword_count": 0, "entity_count": 0, '
         '"heading_count": 1, "keywords": [], "entities": [], "stats": {"avg_words": 0, "median_words": 0, "min_words": 0, "max_words": 0, "avg_h2": 0.0, "avg_h3": 0.0, "avg_headings": 0.0, "avg_outbound": 0.0, "avg_internal": 0.0}'
         + NO_INTENTS + ', "heading_patterns": [{"tag": "h2", "text": "Bake it well", "count": 1}], "people_also_ask": [], "related_searches": []}'),
    ),
)


def clusters(rows: str, group: str, most: int = 100) -> str:
    """CTEs from rows(group, page, nth, tag, text) to cl(group, k, tag, text, n): headings folded in order."""
    p = "STRUCT(tag VARCHAR, text VARCHAR, low VARCHAR, n BIGINT)[]"
    hit = "coalesce(list_position(list_transform(f.pats, lambda p: p.tag = h.tag AND contains(p.low, h.low)), TRUE), 0)"
    return f"""fo AS (SELECT {group} AS g, row_number() OVER (PARTITION BY {group} ORDER BY page, nth) AS i, tag, text, lower(text) AS low FROM {rows}),
        f(g, i, pats) AS (
            SELECT DISTINCT g, 0::BIGINT, []::{p} FROM fo
            UNION ALL SELECT f.g, h.i, CASE WHEN len(f.pats) >= {most} THEN f.pats
                WHEN {hit} > 0 THEN list_transform(f.pats, lambda p, k: {{'tag': p.tag, 'text': p.text, 'low': p.low, 'n': p.n + (k = {hit})::BIGINT}})
                ELSE list_append(f.pats, {{'tag': h.tag, 'text': h.text, 'low': h.low, 'n': 1::BIGINT}}) END
            FROM f JOIN fo h ON h.g = f.g AND h.i = f.i + 1
        ), fl AS (SELECT g, arg_max(pats, i) AS pats FROM f GROUP BY g),
        cl AS (SELECT g, unnest(pats) AS p, generate_subscripts(pats, 1) - 1 AS k FROM fl), """


def recursive(name: str, select: str, ctes: str) -> None:
    sql(name, select, ctes)
    ORACLE_SQL[name] = ORACLE_SQL[name].replace("WITH ", "WITH RECURSIVE ", 1)


recursive(
    "heading_patterns_seq", "SELECT g AS grp, p.tag AS tag, p.text AS text, p.n AS count, k::INT AS first_seen FROM cl",
    literal_sql("lit_headings") + f"kept AS (SELECT * FROM lit_headings WHERE NOT {rejected('text')}), " + clusters("kept", "grp"),
)
recursive(
    "heading_patterns_ranked", "SELECT * FROM (SELECT g AS grp, row_number() OVER (PARTITION BY g ORDER BY p.n DESC, k)::INT AS place, p.tag AS tag, p.text AS text, p.n AS count FROM cl) WHERE place <= 3",
    literal_sql("lit_headings") + f"kept AS (SELECT * FROM lit_headings WHERE NOT {rejected('text')}), " + clusters("kept", "grp"),
)
#: Text of the table's pages: what stands between the tags of their article.
ARTICLE = "replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '&lt;', chr(2)), '&gt;', chr(3)), '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
PAGE_TEXT = f"""pa AS (SELECT page_id, url, {ARTICLE} AS a FROM pages),
    pp AS (SELECT page_id, url, list_filter(string_split(regexp_replace(a, '<[^>]*>', chr(1), 'g'), chr(1)), lambda x: NOT regexp_full_match(x, '{BLANK}*')) AS t, len(regexp_extract_all(a, '<p>|<p ')) AS p_tags FROM pa),
    pt AS (SELECT page_id, url, translate(CASE WHEN len(t) = 0 THEN '' ELSE list_reduce(t, lambda x, y: CASE WHEN ends_with(x, ' ') THEN x || y ELSE x || ' ' || y END) END, chr(2) || chr(3), '<>') AS page_text, p_tags::INT AS p_tags FROM pp),
    pw AS (SELECT *, {words('page_text')} AS word_count FROM pt), """
sql("page_text", "SELECT page_id, page_text, word_count, p_tags, word_count > 200 AND p_tags < 3 AS non_article FROM pw", PAGE_TEXT)
sql(
    "gap_report",
    expected(
        "keyword, report",
        ("a", lines("Coverage: keywords 33%, headings 100%", "Words: 12, 1638 more needed; headings: 5", "MISSING KEYWORDS", "  - pronation", "  - amazon", "  - want build", "  - trail running", "  - visit site.com", "  - Julian Chokkattu")),
        ("a", lines("Coverage: keywords 0%, headings 0%", "Words: 0, 1650 more needed; headings: 5", "MISSING KEYWORDS", "  - cushioning", "  - pronation", "  - amazon", "  - running shoes", "  - want build", "  - trail running",
                    "  - visit site.com", "  - Julian Chokkattu", "  - shoe", "MISSING HEADINGS", "  - running shoes")),
        ("b", lines("Coverage: keywords 20%, headings 0%", "Words: 1, 21 more needed; headings: 7", "MISSING KEYWORDS", "  - rock'n", "  - reviewed by experts", "  - photo by someone", "  - marathon plan",
                    "MISSING HEADINGS", "  - cushioning", "  - 1. simple fit guide here")),
    ),
)
sql("entailment_type", expected("keyword, content_type", ("a", "guide"), ("b", None), ("c", "recipe")))
sql("child_scan", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7")
#: The analysis of all pages, whose hosts are the keywords; `documents` are their texts here.
ANALYSIS_OF_PAGES = (
    PAGE_TEXT + f"""pg AS (SELECT 'guide to ' || {domain('pw.url')} AS keyword, pw.*, word_count > 200 AND p_tags < 3 AS non_article FROM pw),
    documents AS (SELECT keyword AS source, page_id AS doc_id, page_text AS text FROM pg WHERE NOT non_article), """
    + TOKENS + TFIDF + GRAMS + TOP_GRAMS + """bk AS (SELECT source, word AS text FROM tfidf WHERE rank <= 2000 UNION ALL SELECT source, ngram FROM grams g WHERE rank <= 200 AND NOT EXISTS (SELECT 1 FROM tfidf t WHERE t.source = g.source AND t.word = g.ngram AND t.rank <= 2000)),
    nk AS (SELECT source AS keyword, least(count(*), 2000) AS n_keywords FROM bk GROUP BY source),
    admk AS (SELECT source AS keyword, doc_id, text FROM adm), """
    + window_ctes("admk") + intents("win").replace("sc AS", "si AS", 1) + f"ty AS (SELECT keyword, {type_cells()} FROM win), "
    + f"""tn AS (SELECT keyword, 3 * {hits('wtext', L.TONE_FORMAL_3)} + {hits('wtext', L.TONE_FORMAL_1)} AS formal, 3 * {hits('wtext', L.TONE_CASUAL_3)} + {hits('wtext', L.TONE_CASUAL_1)} AS casual, 2 * {hits('wtext', L.TONE_TECHNICAL_2)} AS technical FROM win),
    hp AS (SELECT p.keyword, p.page_id AS page, 0 AS nth, 'h1' AS tag, trim(regexp_replace({UNESCAPE.format('h1')}, '[^\\x20-\\x7F]', '', 'g')) AS text FROM pg p JOIN pages USING (page_id) WHERE word_count > 50 AND NOT non_article AND 1.0 / word_count <= 0.10),
    hk AS (SELECT * FROM hp WHERE NOT {rejected('text')}), """
    + clusters("hk", "keyword")
    + "nh AS (SELECT g AS keyword, count(*) AS n_headings FROM cl GROUP BY g), stp AS (SELECT keyword, count(*) AS n_pages, avg(word_count) AS avg_words FROM pg WHERE word_count > 50 GROUP BY keyword), "
)
recursive(
    "page_analysis",
    f"""SELECT p.keyword, n_pages, avg_words, coalesce(primary_intent, 'informational') AS primary_intent, coalesce(content_type, 'article') AS content_type, coalesce(tone, 'conversational') AS tone, n_keywords, n_headings
        FROM stp p LEFT JOIN (SELECT keyword, {PRIMARY} FROM si) si ON si.keyword = p.keyword
        LEFT JOIN (SELECT keyword, CASE {" ".join(f"WHEN {t} = greatest({', '.join(TYPES)}) THEN {q(name)}" for t, name in zip(TYPES, L.CONTENT_TYPES))} END AS content_type FROM ty) ty ON ty.keyword = p.keyword
        LEFT JOIN (SELECT keyword, CASE WHEN technical > formal AND technical > casual THEN 'technical' WHEN formal > casual THEN 'formal' ELSE 'conversational' END AS tone FROM tn) tn ON tn.keyword = p.keyword
        LEFT JOIN nk ON nk.keyword = p.keyword LEFT JOIN nh ON nh.keyword = p.keyword""",
    ANALYSIS_OF_PAGES,
)


from lodestone.plans import table_oracles  # noqa: E402, F401 - adds its SQL
