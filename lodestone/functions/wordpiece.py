"""WordPiece tokens for a given vocabulary: greedy longest match, in the word's own case and else in lower case."""

from __future__ import annotations

import string
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MOST_PIECES = 256
MOST_LETTERS = 126
SPACE = frozenset(" \t\n\x0b\f\r")
MARKS = frozenset(string.punctuation)


def words_of(text: str):
    """Words and punctuation marks of ASCII, in order; white space parts them."""
    word = ""
    for c in text:
        if c in SPACE or c in MARKS or len(word) == MOST_LETTERS:
            if word:
                yield word
            word = ""
            if c in MARKS:
                yield c
            elif c not in SPACE:
                word = c
        else:
            word += c
    if word:
        yield word


def longest_match(word: str, at: int, vocabulary: frozenset[str]) -> int:
    """End of the longest piece of the vocabulary that begins at a place of the word; the place itself if there is none."""
    head = "##" if at else ""
    return next((end for end in range(len(word), at, -1) if head + word[at:end] in vocabulary), at)


def wordpieces(text: str, vocabulary: frozenset[str], most: int = MOST_PIECES) -> list[str]:
    """Pieces between [CLS] and [SEP], most in all. Marks that the vocabulary lacks are left out; a word that can't go on ends in the whole word, which has no number."""
    out = ["[CLS]"]
    for word in words_of(text):
        if len(out) >= most - 1:
            break
        if word in MARKS:
            out += [word] * (word in vocabulary)
            continue
        if word in vocabulary or word.lower() in vocabulary:
            out.append(word)
            continue
        at = 0
        while at < len(word) and len(out) < most - 1:
            end = max(longest_match(word, at, vocabulary), at)
            if end == at:
                end = longest_match(word.lower(), at, vocabulary)
            if end == at:
                out.append(word)
                break
            out.append(("##" if at else "") + word[at:end])
            at = end
    return [*out, "[SEP]"]


def read_vocabulary(spark: SparkSession, path: str) -> list[str]:
    """A vocabulary file, one piece a line; its line numbers are the ids. It is as large as the model's table."""
    return [r["value"] for r in spark.read.text(path).collect()]


def tokenize(text: Column, vocabulary: Sequence[str], most: int = MOST_PIECES) -> Column:
    """Pieces of every text; the vocabulary travels with the function."""
    known = frozenset(vocabulary)

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: wordpieces(t or "", known, most))

    return pieces(text)


def piece_ids(pieces: Column, vocabulary: Sequence[str]) -> Column:
    """Line numbers of pieces, by their own case and else in lower case; those of [UNK] for the rest."""
    ids = {p: n for n, p in reversed(list(enumerate(vocabulary)))}
    unknown = ids.get("[UNK]", 100)

    @F.pandas_udf("array<int>")
    def numbers(rows: pd.Series) -> pd.Series:
        return rows.map(lambda own: [ids.get(p, ids.get(p.lower(), unknown)) for p in own])

    return numbers(pieces)
