"""Sources: captured search responses, line lists, frequency tables, keyword batches, stored sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import urls as U

RESPONSE = (
    "organic array<struct<position:int,title:string,link:string,snippet:string,date:string>>, peopleAlsoAsk array<struct<question:string,snippet:string,link:string>>, "
    "relatedSearches array<struct<query:string>>, knowledgeGraph struct<title:string,type:string,description:string>"
)

#: The fields that whole sessions have; what may be a name or an object, or an object or plain text, is read as a string.
SESSION = (
    "keyword string, keyword_count int, intent string, primary_intent string, content_type string, tone string, recommended_words int, recommended_headings int, stats struct<avg_word_count:double,avg_words:double>, "
    "keywords array<struct<text:string,score:double,freq:int,frequency:int,src:string,source:string,cfr:double,sem:double,tfidf:double,boost:double>>, heading_patterns array<struct<tag:string,text:string,count:int>>, "
    "entities array<struct<text:string,label:string,freq:int,frequency:int,sources:int>>, people_also_ask array<string>, related_searches array<string>, "
    "pages array<struct<url:string,domain:string,title:string,words:int,is_crawled:int,serp_position:int>>"
)


def parse_responses(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows(keyword, page, body) with the response as a struct; a body that is no JSON has none."""
    return rows.withColumn("response", F.from_json(body, RESPONSE))


def take_pages(rows: DataFrame) -> DataFrame:
    """Pages of a keyword before its first one without results."""
    empty = F.coalesce(F.size("response.organic"), F.lit(0)) <= 0
    stop = F.min(F.when(empty, F.col("page"))).over(Window.partitionBy("keyword"))
    return rows.withColumn("stop", stop).filter(F.col("stop").isNull() | (F.col("page") < F.col("stop"))).drop("stop")


def organic_results(rows: DataFrame) -> DataFrame:
    """keyword, page, idx, position, absolute, title, link, snippet, domain, date; a missing position is the place."""
    out = rows.select("keyword", "page", F.posexplode("response.organic").alias("idx", "r"))
    position = F.coalesce("r.position", F.col("idx") + 1)
    return out.select(
        "keyword", "page", "idx", position.alias("position"), U.absolute_position(F.col("page"), position).alias("absolute"),
        F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce("r.link", F.lit("")).alias("link"), F.coalesce("r.snippet", F.lit("")).alias("snippet"),
        U.domain(F.coalesce("r.link", F.lit(""))).alias("domain"), F.coalesce("r.date", F.lit("")).alias("date"),
    )


def questions(rows: DataFrame, most: int = 10) -> DataFrame:
    out = rows.select("keyword", F.posexplode(F.slice("response.peopleAlsoAsk", 1, most)).alias("ordinal", "q"))
    return out.select("keyword", "ordinal", "q.question", "q.snippet", "q.link")


def related_searches(rows: DataFrame, most: int = 20) -> DataFrame:
    out = rows.select("keyword", F.posexplode(F.slice("response.relatedSearches", 1, most)).alias("ordinal", "q"))
    return out.select("keyword", "ordinal", "q.query")


def knowledge_graph(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("response.knowledgeGraph").isNotNull()).select("keyword", "response.knowledgeGraph.*")


def clean_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """line: trimmed lines that are neither empty nor comments."""
    return lines.select(X.trim(F.col(column)).alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def read_line_list(spark: SparkSession, path: str) -> DataFrame:
    return clean_lines(spark.read.text(path))


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """listed: the domains of a line list, lower-cased, without www."""
    return read_line_list(spark, path).select(U.strip_www(F.lower("line")).alias("listed")).distinct()


def read_user_agents(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    return read_line_list(spark, path).limit(most)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """nth (from 1), file, value of all lines of the text files under path, by file name and place, however large they are.

    Files are read in splits. Rows of a split are numbered as they are read; splits have the rows of those before them added,
    which takes one row a split.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "begin").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    within = Window.partitionBy("file").orderBy("begin")
    splits = splits.withColumn("before", F.sum("n").over(within) - F.col("n"))
    files = splits.groupBy("file").agg(F.sum("n").alias("n"))
    files = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("earlier"))  # a row a file
    offsets = splits.join(files, "file").select("file", "begin", "first_id", (F.col("before") + F.col("earlier")).alias("offset"))
    return lines.join(offsets, ["file", "begin"]).select((F.col("offset") + F.col("id") - F.col("first_id") + 1).alias("nth"), "file", F.rtrim("value", F.lit("\r")).alias("value"))


def frequency_table(lines: DataFrame, most: int = 50_000) -> DataFrame:
    """word, rank from lines(nth, value) of `word count`: the row number among well-formed lines; the last of equal words counts."""
    parts = lines.select("nth", F.regexp_extract("value", r"^\s*(\S+)\s+\d+", 1).alias("word")).filter("word <> ''")
    first = parts.orderBy("nth").limit(most)  # each task sends most rows at most
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy("nth")))
    return ranked.groupBy(F.lower(F.substring("word", 1, 47)).alias("word")).agg(F.max("rank").alias("rank"))


def read_frequency_table(spark: SparkSession, path: str, most: int = 50_000) -> DataFrame:
    """A frequency file, or a folder of them in the order of their names."""
    return frequency_table(numbered_lines(spark, path), most)


def keyword_batch(rows: DataFrame, column: str = "input", most: int = 256) -> DataFrame:
    """idx, keyword of a multi-line input, in order."""
    lines = rows.select(F.posexplode(F.split(column, "[\r\n]+")).alias("nth", "line")).select("nth", X.trim(F.col("line")).alias("keyword")).filter("keyword <> ''")
    first = lines.orderBy("nth").limit(most)
    return first.withColumn("idx", F.row_number().over(Window.orderBy("nth")) - 1).select("idx", "keyword")


def parse_proxies(lines: DataFrame) -> DataFrame:
    """scheme, host, port, user, password of `[scheme://][user:password@]host:port` or host:port:user:password lines."""
    line = F.col("line")
    whole = r"^(?:(\w+)://)?(?:([^:@/]+):([^@/]*)@)?([^:@/]+):(\d+)(?::([^:]+):(.+))?$"
    part = lambda n: F.regexp_extract(line, whole, n)
    either = lambda a, b: F.when(part(a) != "", part(a)).otherwise(part(b))
    rows = clean_lines(lines).filter(line.rlike(whole))
    return rows.select(F.when(part(1) != "", part(1)).otherwise("http").alias("scheme"), part(4).alias("host"), part(5).cast("int").alias("port"), either(2, 6).alias("user"), either(3, 7).alias("password"))


def restore_sessions(rows: DataFrame, body: str = "json_data") -> DataFrame:
    """rows with the session's JSON as a variant, whichever layout it has (null if it is none), and its usual fields as a struct.

    The tables and the summary are taken from the variant; the struct is not worked out where nothing asks for it.
    """
    return rows.withColumns({"variant": F.try_parse_json(F.col(body)), "session": F.from_json(body, SESSION)})


def field(of: Column, path: str, kind: str = "string") -> Column:
    """What lies at a path of a variant; null if it is not there or of another kind, whatever else the variant holds."""
    return F.try_variant_get(of, f"$.{path}" if path else "$", kind)


def items(path: str) -> Column:
    """A list of the session, of any members."""
    return field(F.col("variant"), path, "array<variant>")


def session_summary(restored: DataFrame) -> DataFrame:
    """One line for each stored session."""
    s = lambda path, kind="string": field(F.col("variant"), path, kind)
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    own_pages = F.filter(items("pages"), lambda p: F.coalesce(field(p, "is_crawled", "int"), F.lit(0)) == 0)
    name = F.when(~s("intent").startswith("{"), s("intent"))
    return restored.select(
        "keyword", F.coalesce(s("keyword_count", "int"), size(items("keywords"))).alias("n_keywords"), F.coalesce(name, s("intent.primary"), s("primary_intent"), F.lit("")).alias("intent"),
        F.coalesce(s("intent.content_type"), s("content_type"), F.lit("")).alias("content_type"), F.coalesce(s("intent.tone"), s("tone"), F.lit("")).alias("tone"),
        F.coalesce(s("stats.avg_words", "double"), s("stats.avg_word_count", "double"), F.lit(0.0)).alias("avg_words"), size(own_pages).alias("n_pages"),
        size(items("people_also_ask")).alias("n_questions"), size(items("related_searches")).alias("n_related"), short_date(F.col("updated_at")).alias("updated"),
    )


def short_date(at: Column) -> Column:
    return F.date_format(at, "MMM d")


def session_tables(restored: DataFrame) -> dict[str, DataFrame]:
    """The lists of restored sessions as tables by keyword, in order: keywords, headings, entities, questions, related, pages.

    Keywords and entities have freq and src or the older frequency and source; questions are objects or plain strings.
    """

    def table(path: str, **columns: Column) -> DataFrame:
        rows = restored.select("keyword", F.posexplode(items(path)).alias("nth", "x"))
        return rows.select("keyword", "nth", *[c.alias(name) for name, c in columns.items()])

    x = lambda path, kind="string": field(F.col("x"), path, kind)
    texts, numbers, counts = (lambda *names, kind=kind: {n: x(n, kind) for n in names} for kind in ("string", "double", "int"))
    frequency = F.coalesce(x("freq", "int"), x("frequency", "int"))
    asked = x("")
    return {
        "keywords": table("keywords", **texts("text"), **numbers("score"), frequency=frequency, source=F.coalesce(x("src"), x("source"), F.lit("saved")), **numbers("cfr", "sem", "tfidf", "boost")),
        "headings": table("heading_patterns", **texts("tag", "text"), **counts("count")), "entities": table("entities", **texts("text", "label"), frequency=frequency, **counts("sources")),
        "questions": table("people_also_ask", question=F.when(asked.startswith("{"), x("question")).otherwise(asked), **texts("snippet", "link")), "related": table("related_searches", query=x("")),
        "pages": table("pages", **texts("url", "domain", "title"), **counts("words", "is_crawled", "serp_position")),
    }


def with_phrases(rows: DataFrame, asked: DataFrame, related: DataFrame, most_asked: int = 10, most_related: int = 20) -> DataFrame:
    """rows(keyword) with the stored questions(question, snippet, link) and related searches of the keyword, in order; none is an empty list."""

    def gathered(table: DataFrame, fields: Sequence[str], most: int, name: str) -> DataFrame:
        first = table.withColumn("place", F.row_number().over(Window.partitionBy("keyword").orderBy("nth"))).filter(F.col("place") <= most)
        own = F.struct(*fields) if len(fields) > 1 else F.col(fields[0])
        items = F.transform(F.array_sort(F.collect_list(F.struct("place", own.alias("x")))), lambda p: p["x"])
        return first.groupBy("keyword").agg(items.alias(name))

    out = rows.join(gathered(asked, ("question", "snippet", "link"), most_asked, "questions"), "keyword", "left").join(gathered(related, ("query",), most_related, "related"), "keyword", "left")
    kinds = {"questions": "array<struct<question:string,snippet:string,link:string>>", "related": "array<string>"}
    return out.withColumns({c: F.coalesce(F.col(c), F.array().cast(kind)) for c, kind in kinds.items()})
