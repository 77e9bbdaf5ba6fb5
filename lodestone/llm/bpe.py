"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The words of many documents lie in one flat array of symbols. A round looks up all neighbouring pairs by binary
search in the sorted pair keys, finds the lowest rank of every word and merges that pair wherever the word has it,
from left to right; words without a known pair leave. Each distinct word of a batch is encoded once. Words of over
LONG_WORD bytes, such as texts without white space, take their merges from a queue, in the same order.

Null text counts as empty: no tokens, digests of nothing. Repeated rows are encoded alike. The text of an added token
is that token wherever it stands. Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrow import slices

#: Fixed value: how the byte-level pre-tokenizer cuts text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text that are encoded at once.
CHUNK_BYTES = 2 << 20
#: Distinct words whose symbols one worker remembers before it starts anew.
CACHE_WORDS = 300_000
#: Words of more bytes take their merges from a queue: rounds over all of a word would be as many as its different merges.
LONG_WORD = 4096
NO_RANK = np.iinfo(np.int32).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: itself if visible, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the concatenated ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class BpeTables:
    """What a vocabulary file says, as arrays that are small enough to broadcast (tens of thousands of entries)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.byte_ids = np.array([vocab[c] for c in alphabet], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        pieces = [b""] * self.size
        for token, i in vocab.items():
            pieces[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.added.items():
            pieces[i] = token.encode()
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_start = np.cumsum(self.piece_len) - self.piece_len

    def encode_long(self, word: bytes) -> np.ndarray:
        """Token ids of one word, by a queue of its pairs: the lowest rank first, the leftmost of equal ones."""
        size, rank_of, merged = self.size, dict(zip(self.keys.tolist(), self.ranks.tolist())), self.merged
        symbols = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n))

        def rank_at(i: int) -> int | None:
            j = after[i]
            return rank_of.get(symbols[i] * size + symbols[j]) if j < n else None

        queue = [(rank, i) for i in range(n) if (rank := rank_at(i)) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            if symbols[i] < 0 or rank_at(i) != rank:  # merged meanwhile
                continue
            j = after[i]
            symbols[i], symbols[j] = int(merged[rank]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (new := rank_at(k)) is not None:
                    heapq.heappush(queue, (new, k))
        return np.array([x for x in symbols if x >= 0], np.int64)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and how many each word has."""
        long = [w for w in words if len(w) > LONG_WORD]
        if not long:
            return self.encode_rounds(words)
        short_ids, short_counts = self.encode_rounds([w for w in words if len(w) <= LONG_WORD])
        parts, at, short, long_ids = [], 0, iter(short_counts.tolist()), iter(map(self.encode_long, long))
        for w in words:
            if len(w) > LONG_WORD:
                parts.append(next(long_ids))
            else:
                n = next(short)
                parts.append(short_ids[at : at + n])
                at += n
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def encode_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """encode_words in rounds over all words, each with a word's lowest rank."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        while len(symbols):
            rank = np.full(len(symbols), NO_RANK, np.int32)
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][known] = self.ranks[at[known]]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            n = np.diff(np.r_[first, len(symbols)])
            lowest = np.repeat(lowest, n)
            over = lowest == NO_RANK
            done_symbols.append(symbols[over])
            done_words.append(word[over])
            here = (rank == lowest) & ~over
            # in a run of overlapping hits every second one merges, counted from the left
            at = np.flatnonzero(here)
            fresh = np.r_[True, np.diff(at) != 1] if len(at) else np.zeros(0, bool)
            run_start = at[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(at) else at
            at = at[(at - run_start) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            stay = ~over
            stay[at + 1] = False
            symbols, word = symbols[stay], word[stay]
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the pieces of ids."""
        return self.piece_bytes[ragged(self.piece_start[ids], self.piece_len[ids])].tobytes()


class Encoder:
    """Cuts texts into words and remembers the ids of the words it has met."""

    def __init__(self, tables: BpeTables, cache_words: int = CACHE_WORDS):
        self.tables, self.cache_words = tables, cache_words
        self.pattern = regex.compile(WORD_PATTERN)
        names = sorted(tables.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for token, i in self.tables.added.items():  # the NUL marks them off from equal ordinary words
            self.remember(["\0" + token], np.array([i]), np.array([1]))

    def remember(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(lengths) - lengths]
        self.length, self.ids = np.r_[self.length, lengths], np.r_[self.ids, ids]

    def words(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self.pattern.findall(text)
        parts = self.added.split(text)
        return [w for i, part in enumerate(parts) for w in (["\0" + part] if i % 2 else self.pattern.findall(part))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in one array, and how many each text has."""
        words, n_words = [], []
        for text in texts:
            found = self.words(text)
            words += found
            n_words.append(len(found))
        if len(self.known) > self.cache_words:
            self.forget()
        new = list(set(words).difference(self.known))
        if new:
            self.remember(new, *self.tables.encode_words([w.encode() for w in new]))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ids = self.ids[ragged(self.start[at], self.length[at])]
        ends = np.r_[0, np.cumsum(self.length[at])]
        bounds = ends[np.r_[0, np.cumsum(n_words, dtype=np.int64)]]
        return ids, np.diff(bounds)


def chunks(texts: list[str], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about `most` characters; a longer text is alone."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def bpe_roundtrip(docs: DataFrame, vocab_path: str, emit_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) for every row of docs(doc_id, text)."""
    tables = docs.sparkSession.sparkContext.broadcast(BpeTables(vocab_path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * emit_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            doc_ids = batch.column("doc_id")
            for a, b in chunks(texts):
                ids, counts = encoder.encode(texts[a:b])
                ends = np.cumsum(counts)
                pieces = [ids[e - n : e] for e, n in zip(ends, counts)]
                digests = [hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in pieces]
                decoded = [encoder.tables.decode(p).decode("utf-8", "replace") for p in pieces]
                columns = [doc_ids.slice(a, b - a), pa.array(counts, pa.int64()), pa.array(digests), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if emit_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, schema)
