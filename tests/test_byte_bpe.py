"""Byte BPE against merges that are applied one after another, and its loaders."""

import json
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import byte_bpe
from lodestone.plans.queries import QUERIES
from lodestone.plans.table_queries import byte_vocabulary


def by_hand(symbols, merges):
    """Every merge in its turn, over the whole word from left to right."""
    word = list(symbols)
    for a, b in merges:
        out, i = [], 0
        while i < len(word):
            if i + 1 < len(word) and word[i] == a and word[i + 1] == b:
                out.append(a + b)
                i += 2
            else:
                out.append(word[i])
                i += 1
        word = out
    return word


LETTERS = st.sampled_from("abc")
#: Also merges whose parts come about only after their turn, and repeated ones.
MERGES = st.lists(st.tuples(st.text("abc", min_size=1, max_size=3), st.text("abc", min_size=1, max_size=3)), max_size=12)


@settings(max_examples=500, deadline=None)
@given(st.lists(LETTERS, max_size=30), MERGES)
def test_queue_applies_merges_in_turn(symbols, merges):
    assert byte_bpe.ByteBpe({}, merges).merged(symbols) == by_hand(symbols, merges)


def test_symbols_of_bytes():
    table = byte_bpe.byte_symbols()
    assert len(set(table)) == 256 and table[ord("a")] == "a" and table[32] == byte_bpe.SPACE and table[10] == "Ċ" and table[0] == "Ā" and table[173] == "Ń"


def test_words_of_single_spaces():
    vocab = {s: 100 + i for i, s in enumerate(byte_bpe.byte_symbols())} | {"Ġa": 7, "ab": 8}
    bpe = byte_bpe.ByteBpe(vocab, [("Ġ", "a"), ("a", "b")])
    a, b, nl, space = (vocab[byte_bpe.byte_symbols()[ord(c)]] for c in "ab\n ")
    assert bpe.encode("ab") == [8] and bpe.encode(" ab") == [7, b] and bpe.encode("a  ab  ") == [a, 7, b] and bpe.encode("b\nb") == [b, nl, b] and bpe.encode("") == bpe.encode("   ") == []
    assert byte_bpe.ByteBpe({}, []).encode("é") == [3, 3] and bpe.encode("a b") == [a, space, b]


def test_loaders(tmp_path):
    (tmp_path / "vocab.json").write_text(json.dumps({'"q\\"': 1, "é": 2, "Ġx": 3}))
    (tmp_path / "merges.txt").write_text("#version: 0.2\na b\nĠ x\n\nlonely\nab  c\n", encoding="utf-8")
    assert byte_bpe.load_vocab(str(tmp_path / "vocab.json")) == {'"q\\"': 1, "é": 2, "Ġx": 3}
    assert byte_bpe.load_merges(str(tmp_path / "merges.txt")) == [("a", "b"), ("Ġ", "x"), ("ab", " c")]
    vocab, merges = byte_bpe.load_vocab(byte_vocabulary()), byte_bpe.load_merges(byte_vocabulary())
    assert len(vocab) > len(merges) == 50_000 and all(a + b in vocab for a, b in merges)


def test_query_by_hand(spark, small):
    bpe = byte_bpe.ByteBpe(byte_bpe.load_vocab(byte_vocabulary()), byte_bpe.load_merges(byte_vocabulary()))
    ranks = {m: i for i, m in enumerate(bpe.ranks)}

    def slowly(symbols):
        """The lowest rank first, all its places from left to right."""
        word = list(symbols)
        while pairs := [p for p in zip(word, word[1:]) if p in ranks]:
            word = by_hand(word, [min(pairs, key=ranks.get)])
        return [bpe.vocab.get(s, 3) for s in word]

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text", byte_bpe.encode(F.col("text"), bpe).alias("ids")).orderBy("doc_id").collect()
    known = {}
    for r in rows[:60]:
        want = []
        for k, w in enumerate(r["text"].split(" ")):
            if w:
                symbols = bpe.symbols(w, k > 0)
                want += known.setdefault((w, k > 0), slowly(symbols))
        assert r["ids"] == want
    counts = Counter({r["doc_id"]: r["n_tokens"] for r in QUERIES["byte_bpe"](spark, small).collect()})
    assert counts == Counter({r["doc_id"]: len(r["ids"]) for r in rows})


def test_odd_texts(spark):
    texts = [None, "", " ", "a" * 20_000, "日本 \n 語", "x\0y", "🙂 🙂"]
    bpe = byte_bpe.ByteBpe(byte_bpe.load_vocab(byte_vocabulary()), byte_bpe.load_merges(byte_vocabulary()))
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, ids int")
    got = {r["ids"]: r["made"] for r in rows.withColumn("made", byte_bpe.encode(F.col("text"), bpe)).collect()}
    back = {s: t for t, s in bpe.vocab.items()}
    table = {c: b for b, c in enumerate(byte_bpe.byte_symbols())}
    for i, t in enumerate(texts):
        decoded = bytes(table[c] for x in got[i] for c in back[x]).decode()
        assert decoded == (" ".join(w for w in (t or "").split(" ") if w) if not (t or "").startswith(" ") else (t or "").strip(" "))
