"""Language identification with segmentation-marginalised unigram models.

Every language has a probability for each piece of a fixed public vocabulary, fitted by expectation maximisation on
all words of a sample of labelled documents, whose size is bounded and whose rows are chosen by hash. Tasks form the expected
uses of pieces in whole units, so that sums don't depend on how words are dealt out. A text's score in a language is the sum, over its words, of the
log of the summed probability of all ways to cut the word into pieces (forward algorithm). A word is a run of letters,
lower-cased, behind the vocabulary's word-start mark, however long it is: words of over STRIP characters in the fit and of over
LONG_WORD in scoring are passed by themselves, with numbers kept in range, the others together. Each distinct word of a batch is
scored once.

A text that is null or has no letter is `und` with score 0, as is every text when nothing was labelled. Ties go to the
language that is first by name. A row without lang or without text is never learned from; repeated rows count each.
Columns other than doc_id, text and lang are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrow import slices
from lodestone.storage import discard, materialise

#: The training sample's bounds, in expectation: documents of a language, and of all (languages share them, one each at least).
TRAIN_DOCS = 1500
MOST_DOCS = 200_000
#: Shorter words go through the fit together, without scaling; it bounds the memory of a batch, not what counts.
STRIP = 32
EM_ROUNDS = 3
WORDS_PER_TASK = 4000
#: Expected uses are counted in units of its inverse.
UNIT = 1 << 24
#: Expected count that every piece has in every language beforehand.
PRIOR_COUNT = 0.05
#: Shorter words are scored together.
LONG_WORD = 256
#: A long word's numbers are scaled after so many characters.
RESCALE = 16
CACHE_WORDS = 300_000
CHUNK_CHARS = 2 << 20
UNDETERMINED = "und"
LETTERS = regex.compile(r"\p{L}+")


class Pieces:
    """A vocabulary as a prefix table: text to piece number, or -1 for a mere prefix of pieces."""

    def __init__(self, pieces: list[str]):
        self.table: dict[str, int] = {}
        for n, piece in enumerate(pieces):
            for k in range(1, len(piece)):
                self.table.setdefault(piece[:k], -1)
            self.table[piece] = n
        self.size, self.longest = len(pieces), max(map(len, pieces), default=1)

    def arcs_from(self, text: str, i: int) -> Iterator[tuple[int, int]]:
        """End and number of every piece that begins at character i."""
        for j in range(i + 1, min(i + self.longest, len(text)) + 1):
            found = self.table.get(text[i:j])
            if found is None:
                if j == i + 1:
                    yield j, self.size
                return
            if found >= 0 or j == i + 1:
                yield j, found if found >= 0 else self.size

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in all words: word, end, length, piece (the vocabulary's size for a character without a piece)."""
        table, unknown = self.table, self.size
        word, end, length, number = [], [], [], []
        for w, text in enumerate(words):
            n = len(text)
            for i in range(n):
                for j in range(i + 1, n + 1):
                    found = table.get(text[i:j])
                    if found is None:
                        if j == i + 1:
                            word.append(w), end.append(j), length.append(1), number.append(unknown)
                        break
                    if found >= 0 or j == i + 1:
                        word.append(w), end.append(j), length.append(j - i), number.append(found if found >= 0 else unknown)
        return tuple(np.array(x, np.int64) for x in (word, end, length, number))


def sentencepiece_vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that are text, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]


def forward(pieces: Pieces, probabilities: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of every word in every language; probabilities has a row for each piece and one for unknown characters."""
    n_lang = probabilities.shape[1]
    out = np.zeros((len(words), n_lang))
    by_length = np.argsort([len(w) for w in words], kind="stable")
    for part in np.array_split(by_length, max(1, len(words) // 4096)):
        if not len(part):
            continue
        own = [words[i] for i in part]
        lengths = np.array([len(w) for w in own])
        most = int(lengths.max())
        word, end, length, number = pieces.arcs(own)
        order = np.lexsort((length, end))
        word, length, number = word[order], length[order], number[order]
        key = end[order] * (pieces.longest + 1) + length
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        alpha = np.zeros((most + 1, len(own), n_lang))
        alpha[0] = 1.0
        scale = np.zeros((len(own), n_lang))
        rescaled = 0
        for a, b in zip(cuts, np.r_[cuts[1:], len(key)]):
            at, k = divmod(int(key[a]), pieces.longest + 1)
            if at >= rescaled + 32:  # keep the numbers of long words in range
                rescaled = at
                window = alpha[max(0, at - pieces.longest) : at]
                top = window.max(0)
                top[(top == 0) | (lengths < at)[:, None]] = 1.0  # words that have ended stay as they are
                window /= top
                scale += np.log(top)
            w = word[a:b]
            alpha[at, w] += alpha[at - k, w] * probabilities[number[a:b]]
        final = alpha[lengths, np.arange(len(own))]
        out[part] = np.log(np.maximum(final, 1e-300)) + scale
    return out


def forward_long(pieces: Pieces, probabilities: np.ndarray, word: str) -> np.ndarray:
    """Log probability of one word of any length in every language. Only as many positions are held as a piece is long."""
    n_held = pieces.longest + 1
    held = np.zeros((n_held, probabilities.shape[1]))
    held[0] = 1.0
    scale = np.zeros(probabilities.shape[1])
    for i in range(len(word)):
        here = held[i % n_held].copy()
        held[i % n_held] = 0.0
        for j, number in pieces.arcs_from(word, i):
            held[j % n_held] += here * probabilities[number]
        if i % RESCALE == RESCALE - 1:
            top = held.max(0)
            held /= top
            scale += np.log(top)
    return np.log(held[len(word) % n_held]) + scale


def expected_long(pieces: Pieces, probability: np.ndarray, word: str, count: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pieces in one word of any length and their expected uses, in units: forward and backward with scaled numbers."""
    n = len(word)
    arcs = [(i, j, number) for i in range(n) for j, number in pieces.arcs_from(word, i)]
    start, end, number = (np.array(x, np.int64) for x in zip(*arcs))
    p = probability[number].tolist()

    def passed(order: Iterator[int], source: list[int], target: list[int], first: int) -> tuple[np.ndarray, np.ndarray]:
        """Value and log scale of every position, in an order that ends a position before it is passed on."""
        value, shift = [0.0] * (n + 1), [0.0] * (n + 1)
        value[first] = 1.0
        for k in order:
            a, b = source[k], target[k]
            if not value[b]:
                shift[b] = shift[a]
            value[b] += value[a] * p[k] * math.exp(shift[a] - shift[b])
            if not 1e-100 < value[b] < 1e100:
                shift[b] += math.log(value[b])
                value[b] = 1.0
        return np.array(value), np.array(shift)

    by_start, by_end = np.lexsort((end, start)), np.lexsort((-start, -end))
    starts, ends = start.tolist(), end.tolist()
    ahead, ahead_log = passed(by_start.tolist(), starts, ends, 0)
    behind, behind_log = passed(by_end.tolist(), ends, starts, n)
    whole = math.log(ahead[n]) + ahead_log[n]
    share = ahead[start] * probability[number] * behind[end] * np.exp(ahead_log[start] + behind_log[end] - whole) * count
    total = np.bincount(number, share, pieces.size + 1)
    used = np.flatnonzero(total)
    return used, np.rint(total[used] * UNIT).astype(np.int64)


def expected_counts(pieces: Pieces, probability: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over all segmentations of the words (forward-backward), in units."""
    total = np.zeros(pieces.size + 1, np.int64)
    if not words:
        return total
    lengths = np.array([len(w) for w in words])
    most = int(lengths.max())
    word, end, length, number = pieces.arcs(words)
    p = probability[number]
    order = np.lexsort((length, end))
    ahead, behind = np.zeros((most + 1, len(words))), np.zeros((most + 1, len(words)))
    ahead[0] = 1.0
    behind[lengths, np.arange(len(words))] = 1.0
    key = end * (pieces.longest + 1) + length
    groups = np.split(order, np.flatnonzero(np.diff(key[order])) + 1)
    for g in groups:
        at, k = int(end[g[0]]), int(length[g[0]])
        ahead[at, word[g]] += ahead[at - k, word[g]] * p[g]
    start = end - length
    order = np.lexsort((length, -start))
    key = start * (pieces.longest + 1) + length
    for g in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        at, k = int(start[g[0]]), int(length[g[0]])
        behind[at, word[g]] += behind[at + k, word[g]] * p[g]
    whole = np.maximum(ahead[lengths, np.arange(len(words))], 1e-300)
    share = ahead[start, word] * p * behind[end, word] / whole[word] * counts[word]
    np.add.at(total, number, np.rint(share * UNIT).astype(np.int64))
    return total


def uses_of(pieces: Pieces, probability: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """expected_counts of words of any length."""
    long = np.array([len(w) > STRIP + 1 for w in words], bool)
    total = expected_counts(pieces, probability, [w for w, x in zip(words, long) if not x], counts[~long])
    for at in np.flatnonzero(long).tolist():
        used, units = expected_long(pieces, probability, words[at], float(counts[at]))
        total[used] += units
    return total


def fit(words: DataFrame, vocabulary: list[str], rounds: int = EM_ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages by name, and the probability of each piece in each of them, from words(lang, word, n).

    Languages and probabilities are the model, which every task needs; uses come back as a row for each piece of a language.
    """
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    size = len(vocabulary) + 1
    table = np.full((size, len(languages)), 1.0 / size)
    dealt = words.repartition(max(1, math.ceil(words.count() / WORDS_PER_TASK)), "word")
    for _ in range(rounds if languages else 0):
        model = words.sparkSession.sparkContext.broadcast((languages, table, vocabulary))

        def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, probabilities, vocab = model.value  # noqa: B023
            pieces = Pieces(vocab)
            for batch in batches:
                langs = np.searchsorted(names, batch.column("lang").to_numpy(zero_copy_only=False).astype(str))
                own, counts = np.array(batch.column("word").to_pylist(), object), batch.column("n").to_numpy().astype(float)
                for k in np.unique(langs).tolist():
                    at = np.flatnonzero(langs == k)
                    total = uses_of(pieces, probabilities[:, k], ["▁" + w for w in own[at]], counts[at])
                    used = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k)), pa.array(used), pa.array(total[used])], names=["k", "piece", "units"])

        table = np.full((size, len(languages)), PRIOR_COUNT)
        for row in dealt.mapInArrow(uses, "k long, piece long, units long").groupBy("k", "piece").agg(F.sum("units").alias("units")).toLocalIterator():
            table[row["piece"], row["k"]] += row["units"] / UNIT
        table /= table.sum(0)
        model.unpersist()
    return languages, table


def is_held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from: crc32 of the identifier's text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_words(docs: DataFrame, n_docs: int = TRAIN_DOCS, most_docs: int = MOST_DOCS) -> DataFrame:
    """lang, word, n: counts of all words of a reproducible sample of the labelled documents outside the held-out fold.

    A language of c documents gives each with probability n_docs / c, by a hash of identifier and text.
    """
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("hash"))
    sizes = materialise(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "language-sizes")
    each = min(n_docs, max(1, most_docs // max(1, sizes.count())))
    place = F.col("hash").bitwiseAND((1 << 52) - 1) / F.lit(float(1 << 52))
    chosen = rows.join(sizes, "lang").filter(place * F.col("size") < each)
    words = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    counted = materialise(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "language-words")
    discard(sizes)
    return counted


class Scorer:
    """Scores texts and remembers the words it has met."""

    def __init__(self, pieces: Pieces, probabilities: np.ndarray, cache_words: int = CACHE_WORDS):
        self.pieces, self.probabilities, self.cache_words = pieces, probabilities, cache_words
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, self.probabilities.shape[1]))

    def scored(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.probabilities.shape[1]))
        long = np.array([len(w) > LONG_WORD for w in words], bool)
        out[~long] = forward(self.pieces, self.probabilities, [w for w, x in zip(words, long) if not x])
        for at in np.flatnonzero(long).tolist():
            out[at] = forward_long(self.pieces, self.probabilities, words[at])
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each text in each language, and the number of its words."""
        words, n_words = [], []
        for text in texts:
            found = LETTERS.findall(text.lower())
            words += found
            n_words.append(len(found))
        if len(self.known) > self.cache_words:
            self.forget()
        new = list(set(words).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.scores = np.concatenate([self.scores, self.scored(["▁" + w for w in new])])
        counts = np.array(n_words, np.int64)
        out = np.zeros((len(texts), self.probabilities.shape[1]))
        if words:
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            full = np.flatnonzero(counts)
            out[full] = np.add.reduceat(self.scores[at], (np.cumsum(counts) - counts)[full], axis=0)
        return out, counts


def annotate(docs: DataFrame, languages: list[str], probabilities: np.ndarray, vocabulary: list[str], label: str, score: str) -> DataFrame:
    """docs, which has a text column, with its language and score as two more columns."""
    model = docs.sparkSession.sparkContext.broadcast((languages, probabilities, vocabulary))  # the model: a number for each language and piece
    schema = T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, vocab = model.value
        scorer = Scorer(Pieces(vocab), table)
        for batch in slices(batches, 2000):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            begin = 0
            while begin < len(texts):
                stop, size = begin, 0
                while stop < len(texts) and (stop == begin or size + len(texts[stop]) <= CHUNK_CHARS):
                    size += len(texts[stop])
                    stop += 1
                logs, counts = scorer.score(texts[begin:stop])
                known = (counts > 0) & bool(names)
                best, posterior = np.full(stop - begin, UNDETERMINED, object), np.zeros(stop - begin)
                if names:
                    best[known] = np.array(names, object)[logs.argmax(1)[known]]
                    posterior[known] = (1.0 / np.exp(logs - logs.max(1, keepdims=True)).sum(1))[known]
                part = batch.slice(begin, stop - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best, pa.string()), pa.array(posterior)], names=schema.names)
                begin = stop

    return docs.mapInArrow(run, schema)


def learn(docs: DataFrame, vocabulary: list[str]) -> tuple[list[str], np.ndarray]:
    """The model of the labelled documents of docs outside the held-out fold."""
    words = training_words(docs)
    model = fit(words, vocabulary)
    discard(words)
    return model


def annotate_languages(docs: DataFrame, vocab_path: str, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the prediction for every row, learned from its labelled documents outside the held-out fold."""
    vocabulary = sentencepiece_vocabulary(vocab_path)
    return annotate(docs, *learn(docs, vocabulary), vocabulary, label, score)


def identify(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return annotate(rows, *learn(docs, vocabulary), vocabulary, "lang_pred", "score").drop("text")


def identify_languages(docs: DataFrame, vocab_path: str) -> DataFrame:
    """identify with the vocabulary of a file."""
    return identify(docs, sentencepiece_vocabulary(vocab_path))
