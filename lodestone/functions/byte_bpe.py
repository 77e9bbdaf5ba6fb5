"""Byte-level BPE for a given vocabulary and list of merges, on words between single spaces.

A text's words are its runs without spaces; one that a space precedes starts with the mark of a space. Each byte of a word is a
symbol; pairs are merged by the rank of their merge, from left to right, and a merge whose turn is over does not come again. A
queue over linked symbols finds the next pair, so a word of n bytes takes n log n steps. Null text has no tokens.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token that stands for symbols out of the vocabulary has this number.
UNKNOWN = 3
SPACE = "Ġ"
#: Words whose numbers a task remembers at once.
REMEMBERED = 1 << 17


@lru_cache(maxsize=1)
def byte_symbols() -> tuple[str, ...]:
    """The character that stands for each byte: itself where it shows, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return tuple(chr(b if b in shown else next(hidden)) for b in range(256))


def load_vocab(path: str) -> dict[str, int]:
    """Tokens and their numbers from a JSON object, or from the model of a tokenizer file."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    return found["model"]["vocab"] if isinstance(found.get("model"), dict) else found


def load_merges(path: str) -> list[tuple[str, str]]:
    """Pairs in the order of their ranks: a line each, behind a first line with the version, or from the model of a tokenizer file."""
    text = Path(path).read_text(encoding="utf-8")
    if text.startswith("{"):
        return [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in json.loads(text)["model"]["merges"]]
    return [tuple(line.split(" ", 1)) for line in text.split("\n")[1:] if " " in line]


class ByteBpe:
    """Encoder for one vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[tuple[str, str]], unknown: int = UNKNOWN):
        self.vocab, self.unknown = vocab, unknown
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(merges):
            self.ranks.setdefault(pair, rank)
        self.cache: dict[str, list[int]] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "cache": {}}

    def symbols(self, word: str, spaced: bool) -> list[str]:
        table = byte_symbols()
        return [SPACE] * spaced + [table[b] for b in word.encode()]

    def merged(self, symbols: list[str]) -> list[str]:
        """Symbols after all merges. Merged ones leave their right neighbour empty; `after` and `before` link the others."""
        n = len(symbols)
        symbols = list(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r, i) for i in range(n - 1) if (r := self.ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        reached = 0
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if rank < reached or j < 0 or not symbols[i] or self.ranks.get((symbols[i], symbols[j])) != rank:
                continue  # a neighbour has changed, or its turn was before this pair came about
            reached = rank
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(queue, (r, a))
        return [s for s in symbols if s]

    def word(self, word: str, spaced: bool) -> list[int]:
        key = SPACE + word if spaced else " " + word  # no word holds a space
        if key not in self.cache:
            if len(self.cache) >= REMEMBERED:
                self.cache.clear()
            self.cache[key] = [self.vocab.get(s, self.unknown) for s in self.merged(self.symbols(word, spaced))]
        return self.cache[key]

    def encode(self, text: str) -> list[int]:
        return [i for k, w in enumerate(text.split(" ")) if w for i in self.word(w, k > 0)]


def encode(text: Column, bpe: ByteBpe) -> Column:
    """Numbers of a text's tokens."""

    @F.arrow_udf("array<int>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([None if t.as_py() is None else bpe.encode(t.as_py()) for t in texts], pa.list_(pa.int32()))

    return F.coalesce(run(text.cast("string")), F.array().cast("array<int>"))
