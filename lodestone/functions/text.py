"""Text columns: tokens, words, English detection, boilerplate lines."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import lists as L

#: What C calls white space.
BLANK = r"[ \t\n\x0B\f\r]"
MAX_TOKEN = 62


def any_of(phrases: Sequence[str], prefix: bool = False) -> str:
    """A regular expression that finds any of the phrases, or text that starts with one.

    Phrases with a common beginning share it, so few branches are tried at a character; those that hold another phrase (or
    begin with it) can find nothing more and are left out.
    """
    needed = [p for p in dict.fromkeys(phrases) if not any(q != p and (p.startswith(q) if prefix else q in p) for q in phrases)]
    return ("^" if prefix else "") + branches(needed)


def branches(phrases: Sequence[str]) -> str:
    """A regular expression for the phrases as a tree of their characters."""
    by_first: dict[str, list[str]] = {}
    for p in phrases:
        by_first.setdefault(p[:1], []).append(p[1:])
    ends = by_first.pop("", None) is not None
    parts = [escape(c) + (branches(rest) if any(rest) else "") for c, rest in by_first.items()]
    whole = parts[0] if len(parts) == 1 and not ends else "(?:" + "|".join(parts) + ")"
    return whole + "?" if ends else whole


def escape(phrase: str) -> str:
    """Escaped so that Java's and RE2's expressions agree."""
    return re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", phrase)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def trim(text: Column) -> Column:
    """Without white space at both ends, as C's isspace has it."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def contains_any_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def word_count(text: Column) -> Column:
    """Number of runs without white space; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def strip_contraction(word: Column) -> Column:
    """Up to the last apostrophe."""
    return F.regexp_replace(word, "'[^']*$", "")


def tokens(text: Column, stop_words: Sequence[str] = L.STOP_WORDS) -> Column:
    """Lower-case words of ASCII letters and apostrophes, at most MAX_TOKEN long, without contraction ends and stop words."""
    plain = F.translate(text, "’‘" + string.ascii_uppercase, "''" + string.ascii_lowercase)
    runs = F.regexp_extract_all(plain, F.lit("([a-z']+)"), F.lit(1))

    def stem(word: Column) -> Column:  # few words need a pattern
        cut = F.substring(word, 1, MAX_TOKEN)
        return F.when(cut.contains("'"), strip_contraction(cut)).otherwise(cut)

    return F.filter(F.transform(runs, stem), lambda w: (F.length(w) >= 2) & ~w.isin(*stop_words))


def is_english(text: Column, sample: int = 2000, least_words: int = 50, least_share: float = 0.08) -> Column:
    """Few words count as English; else the share of marker words among the first ones decides."""
    words = F.slice(F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), F.lit(1)), 1, sample)
    hits = F.size(F.filter(words, lambda w: F.lower(w).isin(*L.ENGLISH_MARKERS)))
    return (F.size(words) < least_words) | (hits / F.size(words) >= least_share)


def is_boilerplate(line: Column) -> Column:
    """Whether a lower-case line is a credit, notice, link or other furniture."""
    size = F.octet_length(line)
    out = line.rlike(any_of(L.LINE_CONTAINS)) | line.rlike(any_of(L.LINE_URL_PREFIX, prefix=True))
    for a, b in L.LINE_PAIRS:
        out = out | (line.contains(a) & line.contains(b))
    out = out | ((size < 100) & (line.rlike(any_of(L.LINE_PREFIX_100, prefix=True)) | line.rlike(any_of(L.LINE_BIO_100))))
    out = out | ((size < 120) & line.rlike(any_of(L.LINE_URL_120)))
    out = out | ((size < 80) & line.rlike(any_of(L.LINE_PREFIX_80, prefix=True)))
    return out | ((size < 40) & line.rlike(any_of(L.LINE_SOCIAL_40)))


def clean_text(text: Column, longest_line: int = 511) -> Column:
    """Boilerplate lines of up to longest_line bytes become as many spaces; longer lines stay."""
    size = F.octet_length

    def clean(line: Column) -> Column:
        short = (size(line) >= 1) & (size(line) <= longest_line)
        return F.when(short & is_boilerplate(F.lower(line)), F.repeat(F.lit(" "), size(line))).otherwise(line)

    return F.array_join(F.transform(F.split(text, "\n", -1), clean), "\n")


def first_bytes(text: Column, n: int) -> Column:
    """The first n bytes, without a character that they cut."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, n).cast("string"))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.rtrim(cut, F.lit("\ufffd")))


def truncate_domain(domain: Column, width: int) -> Column:
    """For display: longer names end in two dots."""
    return F.when(F.length(domain) > width, F.concat(F.substring(domain, 1, width - 2), F.lit(".."))).otherwise(domain)


def count_hits(text: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases occur."""
    total = F.lit(0)
    for phrase in phrases:
        total = total + text.contains(phrase).cast("int")
    return total


def truncated(x: Column) -> Column:
    """Toward zero after rounding away what single-precision products add."""
    return F.floor(F.round(x, 4)).cast("long")


def heading_rejected(text: Column, phrases: Sequence[str] = L.HEADING_BLACKLIST) -> Column:
    """Furniture, sentences, calls to action, trade marks, bylines (two or three capitalised words) and short labels with a colon."""
    low = F.lower(text)
    words = F.filter(F.split(text, " "), lambda w: w != "")
    capitals = F.forall(words, lambda w: w.rlike("^[A-Z]"))
    linking = text.rlike(any_of([" to ", " for ", " and ", " of ", " the ", " in ", ":", "?", "!"]))
    byline = (F.octet_length(text) < 40) & F.size(words).between(2, 3) & capitals & ~linking
    return (
        low.rlike(any_of(phrases)) | text.endswith(".") | low.startswith("get ") | text.rlike(any_of(["(R)", "(TM)", "(r)", "(tm)", "®", "™"]))
        | byline | ((F.octet_length(text) < 15) & text.contains(":"))
    )


def is_junk_keyword(text: Column, similarity: Column, ranked: Column | None = None) -> Column:
    """Whether a keyword is no content: fragments, publishers, tickers, credits, names, furniture, or off topic.

    ranked tells whether a word of the keyword is in the frequency table (for names); unknown counts as not.
    """
    low = F.lower(text)
    phrase = text.contains(" ")
    words = F.filter(F.split(text, " "), lambda w: w != "")
    name = (F.length(text) < 40) & phrase & F.size(words).between(2, 3) & F.forall(words, lambda w: w.rlike("^[A-Z]"))
    known = F.coalesce(ranked, F.lit(False)) if ranked is not None else F.lit(False)
    edge = low.rlike("^" + branches(L.JUNK_EDGE_FILLERS) + " ") | low.rlike(" " + branches(L.JUNK_EDGE_FILLERS) + "$")
    return (
        (F.length(text) < 2) | text.contains("'") | low.rlike(any_of(L.JUNK_URL_PARTS))
        | low.isin(*L.JUNK_CONTRACTIONS) | low.isin(*L.JUNK_PUBLISHERS) | low.isin(*L.JUNK_TICKERS) | low.isin(*L.JUNK_CHROME)
        | low.rlike(any_of(L.JUNK_CREDIT_PREFIXES, prefix=True)) | (name & ((similarity < 0.10) | ~known))
        | (low.contains(" by ") & low.rlike(any_of(L.JUNK_BY_PHRASES)))
        | (phrase & (edge | low.rlike(any_of(L.JUNK_PUBLISHER_PARTS)))) | (~phrase & (similarity < 0.05))
    )
