"""Reports and exports of an analysis: selections as DataFrames, texts from one row for each keyword.

An analysis row has: keyword, primary_intent, content_type, tone, recommended_words, recommended_headings, avg_words,
median_words, min_words, max_words, avg_h2, avg_h3 and arrays keywords(text, score, frequency, source), entities(text, label,
frequency, sources), headings(tag, text, count), questions(question), related. Rendering is plain Python over
Arrow batches, so that thousands of keywords render in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import urls as U
from lodestone.functions.arrow import slices
from lodestone.sources.named_files import write_named_files
from lodestone.storage import arrow_batches, materialise

INTENTS = ("informational", "commercial", "transactional", "navigational")
TEMPLATES = ("full", "keywords", "outline", "competitive")
OUTLINES = {
    "how-to": ("What you need", "Step by step", "Advice that helps", "Common mistakes", "Questions and answers"),
    "comparison": ("At a glance", "Next to each other", "Differences that matter", "Which one to choose", "Questions and answers"),
    "review": ("Summary and first look", "What it does", "What works and what doesn't", "Who it is for", "Conclusion"),
    "guide": ("Introduction", "Terms to know", "The whole way", "What has proved itself", "Conclusion"),
    "listicle": ("Introduction", "The list", "How the list was made", "Conclusion"),
    "recipe": ("About the dish", "Ingredients", "Method", "Advice that helps", "Variations", "Nutrition"),
    "health guide": ("Overview", "Symptoms", "Causes and risks", "Treatment", "When to see a doctor", "Questions and answers"),
}
DEFAULT_OUTLINE = ("Overview", "What to consider", "In detail", "What experts advise", "Conclusion")
#: Readers of a text by its intent and, for informational ones, its type; what they are told by.
INFORMATIONAL_READERS = {"how-to": "beginners", "guide": "learners", "recipe": "cooks", "health guide": "patients"}
READERS = {"commercial": "comparers", "transactional": "buyers"}
AUDIENCES = {
    "beginners": "People who do this for the first time and want every step shown. Take nothing for granted and explain terms where they first come up.",
    "learners": "People who want to understand the subject as a whole. Go deep, but stay easy to follow.",
    "cooks": "People who cook at home, with much or little practice. Give exact amounts and times.",
    "patients": "People who look for health information. Stay calm and plain, and send them to a doctor for advice of their own.",
    "comparers": "People who compare before they buy. They need facts in detail and no bias.",
    "buyers": "People who are about to buy and want to be sure. Be clear on value and price.",
    "everyone": "Anybody who wants clear information that is easy to take in.",
}
GOALS = {
    "transactional": "Lead the reader to a purchase; end with a clear recommendation and what to do next.", "commercial": "Help the reader compare and narrow down; end with a way to decide or a favourite.",
    "navigational": "Bring the reader to the right place without detours.",
}
DEFAULT_GOAL = "Answer the reader's need for information in full; end with what can be done with it at once."
FORMATS = {
    "how-to": "Number the steps and set the key action of each in bold.", "comparison": "Add a table of the options, with what speaks for and against each.",
    "recipe": "List the ingredients with bullets, number the steps and sum up the nutrition.", "listicle": "Give every entry a numbered H2.",
    "health guide": "List symptoms with bullets and add a box with the main points.",
}
FORMAT_LINES = ("Write Markdown with H2 and H3 in order.", "Begin with a paragraph without heading that draws readers in and has the main keyword.", "End with a description of under 160 characters on a line of its own that begins with META:.")
N_INTERNAL_LINKS, N_OUTSIDE_SOURCES = 5, 3
#: Analyses that are handed to Python at once.
ROWS_HELD = 64


@dataclass(frozen=True)
class PromptOptions:
    """What a full brief has; 0 stands for the usual number."""

    keywords: bool = True
    entities: bool = True
    outline: bool = True
    stats: bool = True
    questions: bool = True
    related: bool = True
    guidelines: bool = True
    template: str = "full"
    max_keywords: int = 0
    max_entities: int = 0


def percent(x: float) -> str:
    return f"{x * 100:.0f}%"


def number(x, digits: int = 0) -> float | int:
    """x with fixed decimals; nothing is 0."""
    known = 0.0 if x is None or x != x else float(x)
    return round(known, digits) if digits else round(known)


def heading_figures(row: Mapping) -> str:
    return f"H2 {number(row.get('avg_h2'), 1):.1f}, H3 {number(row.get('avg_h3'), 1):.1f} on average"


def rows(value) -> list:
    return [] if value is None else list(value)


def tiers(keywords: list[Mapping], most: int = 0) -> dict[str, list[str]]:
    """Primary phrases and words and secondary keywords of a list that is sorted by score."""
    first, second = most or 20, most or 15
    bar = 0.40
    if sum(k["score"] > bar for k in keywords) > first and len(keywords) > first:
        bar = keywords[first]["score"] + 0.001
    n_phrases = first * 3 // 4
    phrases = [k["text"] for k in keywords if k["source"] == "ngram" and k["score"] > bar][:n_phrases]
    holders = [k["text"] for k in keywords if k["source"] == "ngram" and k["score"] > 0.25]
    words: list[str] = []
    if any(k["score"] > bar for k in keywords):
        words = [k["text"] for k in keywords if k["source"] == "tfidf" and k["score"] > 0.25 and not any(k["text"] in h for h in holders)][: first - n_phrases]
    return {"primary_phrases": phrases, "primary_words": words, "secondary": [k["text"] for k in keywords if 0.25 < k["score"] <= bar][:second]}


def numbered(text: str) -> bool:
    """A heading that is an entry of a list: one or two digits and a dot."""
    return len(text) > 1 and text[0].isdigit() and (text[1] == "." or (len(text) > 2 and text[1].isdigit() and text[2] == "."))


def outline(row: Mapping) -> list[tuple[str, str]]:
    """(level, text) of a suggested outline: shared headings, then single ones on the subject, then the usual parts."""
    out: list[tuple[str, str]] = []
    headings = rows(row["headings"])
    if row["content_type"] not in ("recipe", "listicle"):
        for h in headings:
            if h["count"] >= 2 and not numbered(h["text"]) and len(out) < 12:
                out.append(("H2" if h["tag"] == "h2" else "H3", f"{h['text']} (in {h['count']} pages)"))
        if len(out) < 6:
            words = [w for w in row["keyword"].lower().split(" ") if len(w) > 2]
            for h in headings:
                if h["count"] == 1 and h["tag"] == "h2" and len(out) < 10 and any(w in h["text"].lower() for w in words):
                    out.append(("H2", h["text"]))
    if len(out) < 3:
        out += [("H2", part) for part in OUTLINES.get(row["content_type"], DEFAULT_OUTLINE)]
    return out


def reader(intent: str, kind: str) -> str:
    """Whom a text is for: a key of AUDIENCES."""
    return INFORMATIONAL_READERS.get(kind, "everyone") if intent == "informational" else READERS.get(intent, "everyone")


def format_lines(kind: str) -> list[str]:
    return [*FORMAT_LINES, *([FORMATS[kind]] if kind in FORMATS else [])]


def with_article(word: str) -> str:
    return f"{'an' if word[:1] in ('a', 'e', 'i', 'o', 'u') else 'a'} {word}"


def instructions(row: Mapping, o: PromptOptions) -> list[str]:
    words = int(row["recommended_words"] or 0)
    out = [
        f"Write {with_article(row['content_type'])} on \"{row['keyword']}\" in a {row['tone']} tone.", f"Aim at {words} to {int(round(words * 1.3, 4))} words.",
        f"Have {row['recommended_headings']} H2 sections or more, as the best competitors do.", "Keep to the outline above, with 150 to 300 words for each H2.",
        "Put the main keyword into the title, the first paragraph, two H2 at least and the conclusion.", "Let the secondary keywords come up naturally in the text, never by force.",
    ]
    if o.entities and rows(row["entities"]):
        out.append("Mention the entities above, which shows knowledge of the subject.")
    if o.questions and rows(row["questions"]):
        out.append("Give each question a section: an answer of one or two sentences first, then the details.")
    if o.related and rows(row["related"]):
        out.append("Give the related searches sections or full paragraphs.")
    if row["avg_words"] > 0:
        out.append(f"Competitors have {row['avg_words']:.0f} words on average, {row['min_words']} to {row['max_words']}; be in their upper quarter.")
    return [f"{n}. {line}" for n, line in enumerate(out, 1)]


def full_brief(row: Mapping, o: PromptOptions = PromptOptions()) -> str:
    lines = [f"Content brief: {row['keyword']}", f"Intent: {row['primary_intent']}; type: {row['content_type']}; tone: {row['tone']}"]
    if (row["recommended_words"] or 0) > 0:
        lines.append(f"Length: {int(row['recommended_words'])} words")
    lines += ["", "=== AUDIENCE ===", AUDIENCES[reader(row["primary_intent"], row["content_type"])], "", "=== FORMAT ===", *format_lines(row["content_type"]), ""]
    keywords = rows(row["keywords"])
    if o.keywords and keywords:
        found = tiers(keywords, o.max_keywords)
        if any(found.values()):
            lines.append("=== KEYWORDS ===")
            for name, label in (("primary_phrases", "Primary phrases"), ("primary_words", "Primary words"), ("secondary", "Secondary keywords")):
                if found[name]:
                    lines += [f"{label}:", *[f"  - {t}" for t in found[name]]]
            lines.append("")
    if o.entities and rows(row["entities"]):
        lines += ["=== ENTITIES ===", *[f"  - {e['text']} ({e['label']}, freq={e['frequency']})" for e in rows(row["entities"])[: o.max_entities or 25]], ""]
    if o.outline:
        lines += ["=== OUTLINE ===", *[f"{'  ' * (level == 'H3')}{level}: {text}" for level, text in outline(row)], ""]
    if o.stats:
        more = heading_figures(row)
        lines += ["=== COMPETITORS ===", f"Words: {row['avg_words']:.0f} on average, {row['min_words']} to {row['max_words']}, median {row['median_words']}", more, ""]
    if o.questions and rows(row["questions"]):
        lines += ["=== QUESTIONS ===", *[f"  - {q['question']}" for q in rows(row["questions"])], ""]
    if o.related and rows(row["related"]):
        lines += ["=== RELATED SEARCHES ===", *[f"  - {r}" for r in rows(row["related"])], ""]
    if o.guidelines:
        lines += ["=== INSTRUCTIONS ===", *instructions(row, o), "", "=== GOAL ===", GOALS.get(row["primary_intent"], DEFAULT_GOAL), ""]
        lines += ["=== LINKS ===", f"Link to {N_INTERNAL_LINKS} pages of the own site where they fit, and to {N_OUTSIDE_SOURCES} good outside sources."]
    return "\n".join(lines) + "\n"


def keyword_brief(row: Mapping) -> str:
    """Keywords by tier with their scores and frequencies, 30 of each."""
    keywords = rows(row["keywords"])
    bands = (("Primary", [k for k in keywords if k["score"] > 0.40]), ("Secondary", [k for k in keywords if 0.25 < k["score"] <= 0.40]))
    lines = [f"Keywords: {row['keyword']}"]
    for label, own in bands:
        lines += [f"{label}:", *[f"  - {k['text']} ({percent(k['score'])}, x{k['frequency']})" for k in own[:30]]]
    return "\n".join(lines) + "\n"


def outline_brief(row: Mapping) -> str:
    lines = [f"Outline: {row['keyword']}"]
    lines += [f"{h['tag'].upper()}: {h['text']} ({h['count']})" for h in rows(row["headings"]) if h["count"] >= 2][:12]
    if rows(row["questions"]):
        lines += ["H2: Frequently asked questions", *[f"  H3: {q['question']}" for q in rows(row["questions"])]]
    return "\n".join(lines) + "\n"


def competitive_brief(row: Mapping) -> str:
    lines = [f"Competition: {row['keyword']}", f"Average length {row['avg_words']:.0f} words, longest {row['max_words']}"]
    lines += [f"  - {k['text']} (x{k['frequency']})" for k in rows(row["keywords"]) if k["frequency"] >= 2][:10]
    return "\n".join(lines) + "\n"


def render(row: Mapping, options: PromptOptions = PromptOptions()) -> str:
    makers: dict[str, Callable[[Mapping], str]] = {"full": lambda r: full_brief(r, options), "keywords": keyword_brief, "outline": outline_brief, "competitive": competitive_brief}
    return makers[options.template](row)


def export_json(row: Mapping) -> str:
    """The analysis under the field names of stored sessions, with fixed decimals: scores to three, averages to one or none."""
    keywords, entities, headings = rows(row["keywords"]), rows(row["entities"]), rows(row["headings"])
    shares, scores, signals = (dict(row.get(c) or {}) for c in ("confidence", "scores", "signals"))
    parts = ("cfr", "sem", "tfidf", "boost")
    doc = {
        "keyword": row["keyword"], "intent": row["primary_intent"], "content_type": row["content_type"], "tone": row["tone"], "recommended_words": number(row["recommended_words"]),
        "recommended_headings": number(row["recommended_headings"]), "analysis_time": number(row.get("analysis_time"), 2), "keyword_count": len(keywords), "entity_count": len(entities), "heading_count": len(headings),
        "keywords": [{"text": k["text"], "score": number(k["score"], 3), "freq": int(k["frequency"]), "src": k["source"], **{c: number(k.get(c), 3) for c in parts}} for k in keywords],
        "entities": [{"text": e["text"], "label": e["label"], "freq": int(e["frequency"]), "sources": int(e["sources"])} for e in entities],
        "stats": {c: number(row[c]) for c in ("avg_words", "median_words", "min_words", "max_words")} | {c: number(row.get(c), 1) for c in ("avg_h2", "avg_h3", "avg_headings", "avg_outbound", "avg_internal")},
        "intent_breakdown": {i: {"confidence": number(100 * shares.get(i, 0)), "score": number(scores.get(i), 1), "signals": rows(signals.get(i))} for i in INTENTS},
        "heading_patterns": [{"tag": h["tag"], "text": h["text"], "count": int(h["count"])} for h in headings],
        "people_also_ask": [{"question": q["question"], "snippet": q.get("snippet") or "", "link": q.get("link") or ""} for q in rows(row["questions"])], "related_searches": rows(row["related"]),
    }
    return json.dumps(doc, ensure_ascii=False)


def export_bundle(row: Mapping) -> str:
    """The JSON export with the time, if the row has one, and the four briefs."""
    doc = json.loads(export_json(row)) | ({"timestamp": str(row["timestamp"])} if row.get("timestamp") else {})
    doc["prompts"] = {t: render(row, PromptOptions(template=t)) for t in TEMPLATES}
    return json.dumps(doc, ensure_ascii=False)


def export_markdown(row: Mapping) -> str:
    shares, signals = (dict(row.get(c) or {}) for c in ("confidence", "signals"))
    keywords, headings = rows(row["keywords"]), rows(row["headings"])
    lines = [f"# {row['keyword']}", "", "## Intent", "", "| intent | share | signals |", "|-|-|-|"]
    lines += [f"| {i}{' (main)' * (i == row['primary_intent'])} | {percent(shares.get(i, 0.0))} | {' '.join(f'`{x}`' for x in rows(signals.get(i)))} |" for i in INTENTS]
    lines += ["", f"Type {row['content_type']}, tone {row['tone']}; {number(row['recommended_words'])} words and {row['recommended_headings']} headings are advised", ""]
    lines += ["## Competitors", "", "| figure | value |", "|-|-|", f"| words on average | {row['avg_words']:.0f} |", f"| words | {row['min_words']} to {row['max_words']} |", f"| H2 | {number(row.get('avg_h2'), 1):.1f} |", f"| H3 | {number(row.get('avg_h3'), 1):.1f} |"]
    lines += [f"| outbound links | {number(row.get('avg_outbound'), 1):.1f} |"]
    parts = (
        (f"Keywords ({len(keywords)})", ["| keyword | score | frequency | source |", "|-|-|-|-|", *[f"| {k['text']} | {k['score']:.3f} | {k['frequency']} | {k['source']} |" for k in keywords]] * bool(keywords)),
        (f"Headings ({len(headings)})", [f"- {h['tag'].upper()} {h['text']} ({h['count']} pages)" for h in headings]), ("Entities", [f"- {e['text']} ({e['label']}, {e['frequency']})" for e in rows(row["entities"])]),
        ("Questions", [f"- {q['question']}" for q in rows(row["questions"])]), ("Related", [f"- {r}" for r in rows(row["related"])]), ("Brief", ["```", render(row).rstrip("\n"), "```"]),
    )
    for name, own in parts:
        if own:
            lines += ["", f"## {name}", "", *own]
    return "\n".join(lines) + "\n"


def export_text(row: Mapping) -> str:
    """Segments with one entry a line, fields parted by a bar."""
    lines = ["[INTENT]", f"{row['primary_intent']}|{row['content_type']}|{row['tone']}", "[STATS]", f"{row['avg_words']:.0f}|{row['median_words']}|{row['min_words']}|{row['max_words']}"]
    lines += ["[KEYWORDS]", *[f"{k['text']}|{k['score']:.3f}|{k['frequency']}|{k['source']}" for k in rows(row["keywords"])]]
    lines += ["[ENTITIES]", *[f"{e['text']}|{e['label']}|{e['frequency']}" for e in rows(row["entities"])]]
    lines += ["[HEADINGS]", *[f"{h['tag']}|{h['text']}|{h['count']}" for h in rows(row["headings"])]]
    lines += ["[PAA]", *[q["question"] for q in rows(row["questions"])], "[RELATED]", *rows(row["related"])]
    for template in TEMPLATES:
        lines += [f"[PROMPT:{template.upper()}]", render(row, PromptOptions(template=template)).rstrip("\n")]
    return "\n".join(lines) + "\n"


def info_lines(row: Mapping) -> str:
    """An analysis at a glance, with all its lists."""
    shares = row.get("confidence") or {}
    share = percent(dict(shares).get(row["primary_intent"], 0.0))
    keywords, headings, entities = rows(row["keywords"]), rows(row["headings"]), rows(row["entities"])
    if not keywords:
        return ""
    lines = [f"Keyword: {row['keyword']}", f"Intent: {row['primary_intent']} ({share})", f"Type: {row['content_type']}, tone: {row['tone']}", f"Aim: {int(row['recommended_words'])} words, {row['recommended_headings']} headings", ""]
    lines += [f"Competitors: {row['avg_words']:.0f} words on average ({row['min_words']} to {row['max_words']})", heading_figures(row), ""]
    lines += [f"Keywords: {len(keywords)}, headings: {len(headings)}, entities: {len(entities)}"]
    parts = (
        ("KEYWORDS", [f"{k['text']:<32}  {percent(k['score'])}  x{k['frequency']}  {k['source']}" for k in keywords]),
        ("ENTITIES", [f"{e['text']:<32}  {e['label']:<8}  x{e['frequency']}" for e in entities]),
        ("HEADINGS", [f"[{h['tag']}] {h['text']:<40}  {h['count']} pages" for h in headings]),
        ("QUESTIONS", [q["question"] for q in rows(row["questions"])]), ("RELATED", rows(row["related"])),
    )
    for name, own in parts:
        if own:
            lines += ["", f"=== {name} ({len(own)}) ===", *[f"  {line}" for line in own]]
    return "\n".join(lines) + "\n"


def gap_report(row: Mapping) -> str:
    """Text of a content gap: 30 missing keywords and 15 headings."""
    lines = [f"Coverage: keywords {row['keyword_coverage']:.0f}%, headings {row['heading_coverage']:.0f}%", f"Words: {row['user_words']}, {row['words_needed']} more needed; headings: {row['headings_needed']}"]
    if rows(row["missing_keywords"]):
        lines += ["MISSING KEYWORDS", *[f"  - {t}" for t in rows(row["missing_keywords"])[:30]]]
    if rows(row["missing_headings"]):
        lines += ["MISSING HEADINGS", *[f"  - {t}" for t in rows(row["missing_headings"])[:15]]]
    return "\n".join(lines) + "\n"


RENDERERS: dict[str, Callable[[Mapping], str]] = {
    "json": export_json, "bundle": export_bundle, "markdown": export_markdown, "text": export_text, "gap": gap_report, "info": info_lines,
    **{t: (lambda row, t=t: render(row, PromptOptions(template=t))) for t in TEMPLATES},
}


def render_all(analyses: DataFrame, kind: str, key: str = "keyword") -> DataFrame:
    """key and report of every row."""
    make = RENDERERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8):  # an analysis may list thousands of keywords
            rows = batch.to_pylist()
            for row in rows:
                if isinstance(row.get("timestamp"), datetime):
                    row["timestamp"] = row["timestamp"].replace(tzinfo=None)  # in the session's zone
            yield pa.RecordBatch.from_arrays([pa.array([r[key] for r in rows], pa.string()), pa.array([make(r) for r in rows], pa.string())], names=[key, "report"])

    # few rows at once cross to Python, which has to hold them
    with arrow_batches(analyses.sparkSession, ROWS_HELD):
        return materialise(analyses.mapInArrow(run, f"{key} string, report string"), "reports", free=False)


def write_reports(reports: DataFrame, path: str, key: str = "keyword") -> None:
    """Text files in a folder for each keyword."""
    reports.withColumn("folder", U.file_stem(F.col(key))).select("folder", F.col("report").alias("value")).write.partitionBy("folder").mode("overwrite").text(path)


#: Endings of the exported files.
EXPORTS = {"json": "json", "markdown": "md", "text": "txt"}


def export_files(analyses: DataFrame, kinds: Mapping[str, str] = EXPORTS, key: str = "keyword") -> DataFrame:
    """name, content of the exports: `<stem>/<stem>.<ending>` for each kind. Of keywords with one stem the first by name has the file."""
    stem = U.file_stem(F.col(key))
    first = analyses.withColumn("__nth", F.row_number().over(Window.partitionBy(stem).orderBy(key))).filter("__nth = 1").drop("__nth")
    parts = [render_all(first, kind, key).select(F.concat(stem, F.lit("/"), stem, F.lit(f".{ending}")).alias("name"), F.col("report").alias("content")) for kind, ending in kinds.items()]
    return reduce(DataFrame.unionByName, parts)


def write_exports(analyses: DataFrame, path: str, kinds: Mapping[str, str] = EXPORTS, key: str = "keyword") -> None:
    """Write the exports under path, over those that are there."""
    write_named_files(export_files(analyses, kinds, key), path, overwrite=True)


def text_lines(keywords: DataFrame, key: str = "keyword") -> DataFrame:
    """key, place, line: keyword lines of the text export as columns."""
    return keywords.select(key, "place", F.format_string("%s|%.3f|%d|%s", "text", "score", "frequency", "source").alias("line"))


def copied_lines(lines: DataFrame, whole: bool = False) -> DataFrame:
    """nth, line of list rows as they are copied: no rules or empty lines; up to the first double blank, or whole."""
    kept = lines.filter((F.col("line") != "") & ~F.col("line").startswith("=") & ~F.col("line").startswith("-"))
    return kept if whole else kept.withColumn("line", F.regexp_extract(F.ltrim("line"), "^(.*?)(?:  |$)", 1))


def select_outline(headings: DataFrame, group: str = "keyword", least: int = 2, most: int = 12) -> DataFrame:
    """group, place, tag, text, count of shared headings that aren't list entries."""
    kept = headings.filter((F.col("count") >= least) & ~F.col("text").rlike(r"^[0-9]{1,2}\."))
    order = Window.partitionBy(group).orderBy(F.desc("count"), "text", "tag")
    return kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select(group, "place", "tag", "text", "count")


def audience(intent: Column, kind: Column) -> Column:
    """reader as an expression."""
    informational = F.coalesce(*[F.when(kind == k, v) for k, v in INFORMATIONAL_READERS.items()], F.lit("everyone"))
    return F.when(intent == "informational", informational).otherwise(F.coalesce(*[F.when(intent == k, v) for k, v in READERS.items()], F.lit("everyone")))


def outlines(analyses: DataFrame, key: str = "keyword") -> DataFrame:
    """key, place, level, text of the suggested outlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8):
            made = [(r[key], n, *part) for r in batch.to_pylist() for n, part in enumerate(outline(r))]
            columns = zip(*made) if made else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=[key, "place", "level", "text"])

    return analyses.mapInArrow(run, f"{key} string, place int, level string, text string")


def upper_words(words: Column) -> Column:
    return X.truncated(words * 1.3)
