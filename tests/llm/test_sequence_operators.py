"""BPE, language ID, suffix-array removal: against the library, held-out labels and brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import language_id, suffix_dedup
from lodestone.llm.bpe import BpeTables, Encoder, bpe_roundtrip
from lodestone.llm.language_id import UNDETERMINED, Pieces, fit, forward, identify, identify_languages, learn
from lodestone.llm.queries import op1_language_id, op2_bpe_roundtrip, vocabulary
from lodestone.llm.suffix_dedup import remove_repeats
from lodestone.llm.suffix_sort import suffix_array

ODD = [None, "", "   ", "\n\n", "a<|endoftext|>b", "\0x", "I'll CAN'T 's", "x" * 5000, "é" * 300, " \t " * 99, "🙂👍🏽 ñ", "1234 56.78", "一二三　四"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_very_long_words(library):
    """A queue gives what rounds and the library give."""
    tables = BpeTables(vocabulary("byte_bpe_50k.json"))
    r = np.random.default_rng(11)
    words = ["".join(r.choice(list("abcdehilmnorst"), 30_000)), "ab" * 9000 + "b", "the" * 5000, "é" * 4000, "x" * 5001]
    for word in words:
        own = library.encode(word, add_special_tokens=False).ids
        ids, counts = tables.encode_words([b"he", word.encode(), b"llo"])
        assert ids[counts[0] : counts[0] + counts[1]].tolist() == own and counts.sum() == len(ids)
        assert tables.encode_long(word.encode()).tolist() == own
    assert tables.encode_rounds([words[1].encode()])[0].tolist() == tables.encode_long(words[1].encode()).tolist()


def test_bpe_is_the_librarys(spark, small, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in op2_bpe_roundtrip(spark, small).collect()}
    assert got == {k: expected(library, t) for k, t in texts.items()}


def test_bpe_odd_texts_and_columns(spark, library):
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(ODD + ["again", "again"])], "doc_id long, text string, n_tokens string, ids int")
    got = {r["doc_id"]: r for r in bpe_roundtrip(docs, vocabulary("byte_bpe_50k.json"), emit_ids=True).collect()}
    for i, t in enumerate(ODD + ["again", "again"]):
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == expected(library, t)
        assert got[i]["ids"] == library.encode(t or "", add_special_tokens=False).ids
    assert bpe_roundtrip(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_bpe_any_text(library, text):
    ids, _ = test_bpe_any_text.encoder.encode([text])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


test_bpe_any_text.encoder = Encoder(BpeTables(vocabulary("byte_bpe_50k.json")), cache_words=50)


def test_forward_sums_all_segmentations():
    pieces = Pieces(["▁", "a", "b", "ab", "▁a"])
    p = np.array([[0.2], [0.3], [0.1], [0.25], [0.05], [0.1]])
    # ▁ a b | ▁ ab | ▁a b
    assert np.exp(forward(pieces, p, ["▁ab"]))[0, 0] == pytest.approx(0.2 * 0.3 * 0.1 + 0.2 * 0.25 + 0.05 * 0.1)
    # long words keep their range
    assert forward(pieces, p, ["▁" + "ab" * 1200])[0, 0] == pytest.approx(np.log(0.2 * 0.28 + 0.05 * 0.1) + 1199 * np.log(0.28))


def test_forward_is_the_same_beside_long_words():
    pieces = Pieces(["▁", "a", "b", "ab", "abababababababab"])
    p = np.array([[0.2, 0.1], [0.01, 0.02], [0.01, 0.03], [0.05, 0.01], [1e-6, 1e-5], [1e-7, 1e-7]])
    words = ["▁" + "ab" * n for n in (1, 8, 10, 15, 16, 20, 40, 100)]
    alone = np.concatenate([forward(pieces, p, [w]) for w in words])
    assert forward(pieces, p, words) == pytest.approx(alone, rel=1e-12)


def test_fit_gives_distributions(spark):
    words = spark.createDataFrame([("x", "aa", 5), ("w", "bb", 5)], "lang string, word string, n long")
    names, table = fit(words, ["▁", "a", "b"])
    assert names == ["w", "x"] and table.sum(0) == pytest.approx([1, 1])


def cuts(word, pieces):
    """All segmentations, as lists of piece numbers."""
    if not word:
        return [[]]
    out = [[pieces.index(word[:k]), *rest] for k in range(1, len(word) + 1) if word[:k] in pieces for rest in cuts(word[k:], pieces)]
    return out + ([] if word[0] in pieces else [[len(pieces), *rest] for rest in cuts(word[1:], pieces)])


def brute_languages(rows, pieces):
    """The whole query by listing every segmentation."""
    words = lambda t: ["▁" + w for w in re.findall(r"[^\W\d_]+", t.lower())]
    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d, _, _ in rows}
    models = {}
    for lang in sorted({x for d, t, x in rows if x and t is not None and not held[d]}):
        own = Counter(w for d, t, x in rows if x == lang and t and not held[d] for w in words(t))
        p = np.full(len(pieces) + 1, 1 / (len(pieces) + 1))
        for _ in range(3):
            use = np.full(len(pieces) + 1, 0.05)
            for w, n in own.items():
                ways = cuts(w, pieces)
                weight = np.array([p[c].prod() for c in ways])
                for c, x in zip(ways, weight / weight.sum() * n):
                    np.add.at(use, c, x)
            p = use / use.sum()
        models[lang] = p
    out = {}
    for d, t, _ in rows:
        found = words(t or "")
        logs = np.array([sum(np.log(sum(p[c].prod() for c in cuts(w, pieces))) for w in found) for p in models.values()])
        out[d] = (held[d], UNDETERMINED, 0.0) if not found else (held[d], list(models)[logs.argmax()], 1 / np.exp(logs - logs.max()).sum())
    return out


def test_language_query_is_that_of_brute_force(spark):
    pieces = ["▁", "a", "b", "c", "ab", "ba", "▁a", "abc", "cc"]
    r = np.random.default_rng(8)
    text = lambda letters: " ".join("".join(r.choice(list(letters), r.integers(1, 7))) for _ in range(r.integers(1, 6)))
    rows = [(i, text("aabbx" if i % 2 else "bccab"), None if i % 7 == 0 else "one" if i % 2 else "two") for i in range(50)]
    rows += [(100, None, "one"), (101, "12 !", "two"), (102, "zzz", None), (103, "Abc ABC", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = brute_languages(rows, pieces)
    got = {x["doc_id"]: (x["held_out"], x["lang_pred"], x["score"]) for x in identify(docs, pieces).collect()}
    assert got.keys() == want.keys()
    for d, (held, lang, score) in want.items():
        assert got[d][:2] == (held, lang) and got[d][2] == pytest.approx(score, abs=1e-5)


def test_many_languages_and_long_words(spark):
    rows = [(i, chr(97 + i % 26) * 3 + " " + chr(97 + i // 26) * 50, f"l{i // 3:03}") for i in range(240)]
    names, table = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["▁", *map(chr, range(97, 123))])
    assert names == sorted({x for d, _, x in rows if zlib.crc32(str(d).encode()) % 3 != 1}) and len(names) > 70
    assert table.sum(0) == pytest.approx(np.ones(len(names)))


def test_language_held_out_accuracy(spark, small):
    big = "/root/testdata/sf0.01"
    pred = op1_language_id(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = pred.filter("held_out").collect()
    assert len(rows) > 250 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_texts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !?", "en"), (103, "the dog", None), (None, "le chien", None), (103, "the dog", None), (104, "the " * 20000, None), (105, "thedog" * 400, None)]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    got = identify_languages(docs, vocabulary("piece_bpe_32k.model"))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    by_id = {r["doc_id"]: r["lang_pred"] for r in got.collect()}
    assert [by_id[i] for i in (100, 101, 102)] == [UNDETERMINED] * 3 and by_id[103] == by_id[104] == "en" and by_id[None] == "fr"
    assert got.count() == len(rows)
    assert {r["lang_pred"] for r in identify_languages(docs.withColumn("lang", docs["lang"].substr(9, 1)).filter("lang is null"), vocabulary("piece_bpe_32k.model")).collect()} <= {UNDETERMINED}
    assert identify_languages(docs.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.integers(1, 3))
def test_suffix_array(symbols, times):
    text = [*symbols * times, 0]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute_repeats(rows):
    seen, out = set(), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0], (r[1] or "").encode())):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - 99):
            window = body[i : i + 100]
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = sum(1 for i in range(len(body)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[doc, text or ""] = (len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeats(spark, rows):
    docs = spark.createDataFrame([(*r, 7, "c") for r in rows], "doc_id long, text string, n_bytes int, kept string").repartition(3)
    want = brute_repeats(rows)
    got = sorted((tuple(r) for r in remove_repeats(docs).collect()), key=repr)
    assert got == sorted(((d, *want[d, t or ""]) for d, t in rows), key=repr)


def text_rows(seed, n=60):
    r = np.random.default_rng(seed)
    parts = ["".join(r.choice(list("abcdefgh \né"), r.integers(60, 260))) for _ in range(14)]
    rows = [(i, "".join(parts[j] for j in r.integers(0, 14, r.integers(0, 9)))) for i in range(n)]
    return [*rows, (900, None), (901, "a" * 1000), (902, "ab" * 200), (903, " " * 300), (904, parts[0] + "q" * 200 + parts[1]), (905, ("q" * 150 + " ") * 4), (906, "z" * 99)]


def test_repeats_are_those_of_brute_force(spark):
    repeats(spark, text_rows(1))


def test_repeats_under_hot_anchors(spark, monkeypatch):
    """Every anchor split by offset blocks; functions take their constants to the workers."""
    monkeypatch.setattr(suffix_dedup, "HOT", 0)
    repeats(spark, text_rows(2, 40))


def test_repeats_under_anchors_known_to_be_hot(spark, monkeypatch):
    """Every anchor dealt by content before runs are matched."""
    monkeypatch.setattr(suffix_dedup, "HOT", 0)
    monkeypatch.setattr(suffix_dedup, "SEEN", 1)
    repeats(spark, text_rows(3, 40))


def test_repeats_in_long_documents(spark, monkeypatch):
    """Documents of many segments, whole and in part, through the whole query."""
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    r = np.random.default_rng(9)
    part = lambda n: "".join(r.choice(list("abcdef \n"), n))
    one, two = part(9000), part(4000)
    repeats(spark, [(1, one), (2, two + one[2500:6100]), (3, one[:130] + part(2000) + two), (4, part(699) + two[1000:1099] + part(50)), (5, one)])


def test_repeats_with_odd_ids(spark):
    long = "the same sentence of some length that is said again and again " * 4
    repeats(spark, [(1, long), (1, long), (None, long + "x"), (2, long), (2, None), (1, "other " + long), (None, None)])


def test_repeats_of_nothing(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_document_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 400)
    r = np.random.default_rng(5)
    part = "".join(r.choice(list("abc "), 700))
    rows = [(1, part + "unlike" + part), (2, part[100:600])]
    bodies = [t.encode() for _, t in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(bodies, pa.binary())], names=["id", "body"])
    runs = pa.Table.from_batches(list(suffix_dedup.scan_runs(iter([batch])))).to_pandas()
    first, more, _ = suffix_dedup.unpack(runs.dropna(subset="key")["spot"].to_numpy())
    windows = [(d, f + k) for d, f, m in zip(runs.dropna(subset="key")["doc_id"], first, more) for k in range(m + 1)]
    marked = {(int(d), x) for d, a, b in runs[runs["key"].isna()][["doc_id", "digest", "spot"]].itertuples(index=False) for x in range(int(a), int(b) - 99)}
    assert set(windows) | marked == {(i, x) for i, b in zip((1, 2), bodies) for x in range(len(b) - 99)}


def log_sum(values):
    top = max(values)
    return top + np.log(sum(np.exp(v - top) for v in values))


@pytest.mark.parametrize("size", [1, 40, 300, 2000])
def test_words_of_any_length_over_all_segmentations(size):
    """Scores and expected uses of whole words against sums of logs over all cuts; the models are far apart in size."""
    r = np.random.default_rng(size)
    vocab = ["▁", "a", "b", "ab", "ba", "aab", "▁a", "bbbb", "abab"]
    pieces = Pieces(vocab)
    table = r.dirichlet(np.ones(len(vocab) + 1) * 0.2, 2).T + 1e-7
    word = "▁" + "".join(r.choice(list("abc"), size, p=[0.5, 0.4, 0.1]))
    n = len(word)
    arcs = [(i, j, vocab.index(word[i:j]) if word[i:j] in vocab else len(vocab)) for i in range(n) for j in range(i + 1, min(n, i + 4) + 1) if word[i:j] in vocab or j == i + 1]
    for k in range(2):
        ahead, behind = [0.0] + [None] * n, [None] * n + [0.0]
        for j in range(1, n + 1):
            ahead[j] = log_sum([ahead[a] + np.log(table[p, k]) for a, b, p in arcs if b == j and ahead[a] is not None])
        for i in range(n - 1, -1, -1):
            behind[i] = log_sum([behind[b] + np.log(table[p, k]) for a, b, p in arcs if a == i])
        assert language_id.forward_long(pieces, table, word)[k] == pytest.approx(ahead[n], rel=1e-9)
        scorer = language_id.Scorer(pieces, table)
        assert scorer.scored([word, "▁a"])[0, k] == pytest.approx(ahead[n], rel=1e-9)
        uses = np.zeros(len(vocab) + 1)
        for a, b, p in arcs:
            uses[p] += np.exp(ahead[a] + np.log(table[p, k]) + behind[b] - ahead[n]) * 3
        got = language_id.uses_of(pieces, table[:, k], [word, word], np.array([1.0, 2.0])) / language_id.UNIT
        assert got == pytest.approx(uses, rel=1e-4, abs=1e-4)


def test_long_words_are_learned_and_scored_whole(spark):
    """Two languages that differ only from the 41st letter of their words on."""
    rows = [(i, "ab" * 20 + ("ab" if i % 2 else "bb") * 150, "x" if i % 2 else "y") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counted = language_id.training_words(docs)
    assert counted.agg(F.min(F.length("word"))).first()[0] >= 340
    got = identify(docs, ["▁", "a", "b", "ab", "ba", "bb", "aa"]).collect()
    assert all(r["lang_pred"] == ("x" if r["doc_id"] % 2 else "y") and r["score"] > 0.99 for r in got)
