"""Page extraction: HTML to text, headings, links and metadata, one page to one record.

The standard library's tokenizer feeds a small tree builder (void and raw elements, implied end tags). It runs
in Arrow batches; everything that depends on the record alone (word count, flags, fallback) is a column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.functions import lists as L
from lodestone.functions import text as X
from lodestone.functions import urls as U
from lodestone.functions.arrow import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style nav footer header noscript svg form button select textarea iframe aside".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph.
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An opening tag ends these open elements, up to the given boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
MAX_HEADING_BYTES = 510
#: Pages that a task parses before it hands their records on.
PAGES_HELD = 32
SPACE = " \t\n\x0b\f\r"

PAGE_SCHEMA = (
    "page_text string, title string, meta_description string, meta_keywords string, p_tags int, "
    "headings array<struct<tag:string,text:string,level:int>>, links array<struct<url:string,text:string,is_outbound:boolean>>, error string"
)


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._close({"p"}, {"button", "td", "th", "li"} if tag != "p" else {"button", "td", "th"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data: str) -> None:
        last = self.open[-1].children
        if last and isinstance(last[-1], str):
            last[-1] += data
        else:
            last.append(data)

    def _close(self, tags: set[str], boundary: set[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in tags:
                del self.open[depth:]
                return
            if self.open[depth].tag in boundary:
                return


def walk(node: Node, enter=lambda n: True) -> Iterator[Node | str]:
    """Pre-order without recursion; enter tells whether to go below a node."""
    stack: list = [node]
    while stack:
        at = stack.pop()
        yield at
        if isinstance(at, Node) and enter(at):
            stack += reversed(at.children)


def is_chrome(node: Node) -> bool:
    names = (node.attrs.get("class", "") + "\n" + node.attrs.get("id", "")).lower()
    role = node.attrs.get("role", "").lower()
    return any(c in names for c in L.CHROME_CLASSES) or any(r in role for r in L.CHROME_ROLES)


def is_skipped(node: Node) -> bool:
    return node.tag in SKIPPED or is_chrome(node)


def is_content_root(node: Node) -> bool:
    if node.tag in ("main", "article") or "main" in node.attrs.get("role", "").lower():
        return True
    name, own = node.attrs.get("class", "").lower(), node.attrs.get("id", "").lower()
    return node.tag in ("div", "section") and (own in L.ROOT_IDS or any(c in name for c in L.ROOT_CLASSES))


def content_root(root: Node) -> Node:
    """The first content root in document order; the whole document if there is none or it is one article of several."""
    for node in walk(root, lambda n: not is_skipped(n)):
        if isinstance(node, Node) and not is_skipped(node) and is_content_root(node):
            if node.tag == "article" and sum(isinstance(n, Node) and n.tag == "article" for n in walk(root)) > 1:
                return root
            return node
    return root


def body_text(root: Node) -> tuple[str, int]:
    """Text below root outside skipped elements, and the number of paragraphs."""
    out: list[str] = []
    paragraphs = 0
    for at in walk(root, lambda n: n is root or not is_skipped(n)):
        if isinstance(at, str):
            if at.strip(SPACE):
                out.append(at if not out or out[-1].endswith(" ") else " " + at)
        elif at.tag == "p":
            paragraphs += 1
    return "".join(out), paragraphs


def heading_text(node: Node) -> str | None:
    """Text of a heading and of the elements right in it, ASCII only; None if it is too short to count."""
    parts = []
    for child in node.children:
        parts += [child] if isinstance(child, str) else [c for c in child.children if isinstance(c, str)]
    raw = "".join(parts).encode()[:MAX_HEADING_BYTES].decode(errors="ignore").strip(SPACE)
    if len(raw.encode()) <= 1:
        return None
    return re.sub(r"[^\x20-\x7f]", "", raw).strip(SPACE)


def domain_of(url: str) -> str:
    return url.split("://", 1)[-1].split("/", 1)[0].removeprefix("www.")


def resolve_link(base: str, link: str) -> str:
    if link.startswith(("http://", "https://")):
        return link
    head, mark, rest = base.partition("://")
    host, slash, path = (rest if mark else head).partition("/")
    origin = f"{head}://{host}" if mark else host
    if link.startswith("/"):
        return origin + link
    return f"{origin}/{path.rpartition('/')[0]}{'/' if '/' in path else ''}{link}" if slash else f"{base}/{link}"


def parse_page(url: str, html: str) -> tuple:
    """The fields of PAGE_SCHEMA."""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    text, paragraphs = body_text(content_root(builder.root))
    headings, links, meta = [], [], {"description": None, "keywords": None}
    title = None
    own = domain_of(url)
    for node in walk(builder.root, lambda n: n.tag not in HEADINGS):
        if isinstance(node, str):
            continue
        if node.tag in HEADINGS:
            found = heading_text(node)
            if found is not None:
                headings.append((node.tag, found, int(node.tag[1])))
        if node.tag == "title" and title is None:
            title = "".join(c for c in node.children if isinstance(c, str)).strip(SPACE)
        if node.tag == "meta":
            name = node.attrs.get("name", "").lower()
            for kind in meta:
                if kind in name and meta[kind] is None:
                    meta[kind] = node.attrs.get("content", "")
    for node in walk(builder.root):
        if isinstance(node, Node) and node.tag == "a":
            link = node.attrs.get("href", "")
            if link and not link.startswith(("#", "javascript:", "mailto:", "tel:")):
                full = resolve_link(url, link)
                anchor = "".join(c for c in node.children if isinstance(c, str)).strip(SPACE)
                links.append((full, anchor, domain_of(full) != own))
    return text, title or "", meta["description"] or "", meta["keywords"] or "", paragraphs, headings, links, ""


NOT_HTML = "Non-HTML content"


def parse_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with the fields of PAGE_SCHEMA in place of html. A page that fails or is no HTML has its error."""
    schema = T.StructType.fromDDL(f"page_id long, url string, {PAGE_SCHEMA}")
    arrow_schema = to_arrow_schema(schema)
    parts = {f.name: f.dataType.elementType.names for f in schema if isinstance(f.dataType, T.ArrayType)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, PAGES_HELD):  # a page's tree is many times its text
            rows = []
            for page_id, url, html, binary in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "binary")]):
                if binary:
                    rows.append((page_id, url, "", "", "", "", 0, [], [], NOT_HTML))
                    continue
                try:
                    rows.append((page_id, url, *parse_page(url or "", html or "")))
                except Exception as e:  # one page must not end the job; the error is a column
                    rows.append((page_id, url, "", "", "", "", 0, [], [], f"{type(e).__name__}: {e}"))
            columns = [[[dict(zip(parts[f.name], x)) for x in v] for v in c] if f.name in parts else c for f, c in zip(arrow_schema, zip(*rows))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(arrow_schema, columns)], schema=arrow_schema)

    binary = F.coalesce(is_binary(F.col("html")), F.lit(False))
    # a binary body doesn't travel to the parser
    return pages.select("page_id", "url", F.when(~binary, F.col("html")).alias("html"), binary.alias("binary")).mapInArrow(run, schema)


def is_binary(html: Column) -> Column:
    """Bodies that are no HTML by their first bytes, or with a NUL among the first 512."""
    raw = html.cast("binary")
    magic = F.hex(F.substring(raw, 1, 4))
    known = magic.startswith("25504446") | magic.startswith("89504E47") | magic.startswith("FFD8") | magic.startswith("474946") | magic.startswith("504B")
    return (F.octet_length(html) > 4) & (known | F.substring(raw, 1, 512).cast("string").contains("\0"))


def with_flags(parsed: DataFrame) -> DataFrame:
    """Word count, counts of headings and links, domain and the non-article flag."""
    out = parsed.withColumn("word_count", X.word_count(F.col("page_text"))).withColumn("domain", U.domain(F.col("url")))
    return with_counts(out).withColumn("non_article", (F.col("word_count") > 200) & (F.col("p_tags") < 3))


def with_counts(records: DataFrame) -> DataFrame:
    """Counts of a record's headings and links."""
    level = lambda n: F.size(F.filter("headings", lambda h: h["level"] == n))
    out = records.withColumn("h2", level(2)).withColumn("h3", level(3)).withColumn("n_headings", F.size("headings"))
    return out.withColumn("outbound", F.size(F.filter("links", lambda x: x["is_outbound"]))).withColumn("internal", F.size("links") - F.col("outbound"))


def body_marks(html: Column) -> Column:
    """What needs_rendering asks of a body: marks of scripts, and whether it is large."""
    return F.struct(F.lower(html).rlike(X.any_of(L.JS_MARKERS)).alias("scripted"), (F.octet_length(html) > 500).alias("large"))


def needs_rendering(words: Column, marks: Column) -> Column:
    """Whether a page should be rendered: few words, or not many and a mark of scripts; empty ones only if the page is large."""
    few = (words < 200) | ((words < 500) & marks["scripted"])
    return ((words > 0) & few) | ((words == 0) & marks["large"])


def merge_rendered(pages: DataFrame, rendered: DataFrame) -> DataFrame:
    """pages with what rendering gave: text, headings and links always, the counts and flags only if there are more words."""
    new = rendered.select(*[F.col(c).alias(f"new_{c}") for c in rendered.columns])
    joined = pages.join(new, pages["page_id"] == F.col("new_page_id"), "left")
    there = F.col("new_page_id").isNotNull()
    more = there & (F.col("new_word_count") > pages["word_count"])
    always = {"page_text", "headings", "links"}
    counts = {"word_count", "p_tags", "non_article"}
    columns = [F.when(there if c in always else more, F.col(f"new_{c}")).otherwise(pages[c]).alias(c) if c in always | counts else pages[c] for c in pages.columns]
    return joined.select(*columns, more.alias("used_rendering"))


def extract_pages(pages: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """Records of pages(page_id, url, html): binary bodies rejected, HTML parsed, and what needs it taken from rendered pages.

    rendered has the same columns; a page that needs no rendering, or has failed, is not looked up there.
    """
    parsed = with_flags(parse_pages(pages))
    if rendered is None:
        return parsed.withColumn("used_rendering", F.lit(False))
    marks = pages.select(F.col("page_id").alias("body_id"), body_marks(F.col("html")).alias("marks"))  # bodies stay where they are
    wanted = parsed.select("page_id", "word_count", "error").join(marks, F.col("page_id") == F.col("body_id"))
    wanted = wanted.filter((F.col("error") == "") & needs_rendering(F.col("word_count"), F.col("marks"))).select("page_id")
    new = with_flags(parse_pages(rendered.join(wanted, "page_id", "left_semi"))).filter("error = ''")
    columns = ["page_id", "page_text", "word_count", "p_tags", "non_article", "headings", "links"]
    merged = merge_rendered(parsed, new.select(*columns))
    return with_counts(merged)
