"""The pipeline against a brute-force version of its first four stages, and the tokenizers library."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from test_similarity_operators import brute_components

import corpus_pipeline
from lodestone.llm.mixing import mix_plan


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "mix_sources", "bpe_encode"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(100_001, None, "en", "src0", 0), (100_002, "123 !!", "en", "src1", 6), (7, docs.filter("doc_id = 7").first()["text"], "en", "src7", 1)], docs.schema)
    docs, seen = docs.unionByName(extra), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        seen.append(docs)
    base = spark.read.parquet(f"{small}/documents.parquet")
    assert all(d.columns == base.columns for d in seen[:4])
    texts = {r["doc_id"]: r["text"] for r in base.collect()}
    ids = [sorted(r["doc_id"] for r in d.select("doc_id").collect()) for d in seen]
    assert ids[0] == sorted([*texts, 7])
    last = {}
    for d in sorted(texts):
        last[texts[d].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))] = d
    assert ids[1] == sorted(last.values())
    components = brute_components([(d, texts[d]) for d in ids[1]])
    assert ids[2] == sorted(d for d, (_, c) in components.items() if c == d)
    assert set(ids[3]) <= set(ids[2]) and max(Counter(ids[3]).values()) <= 3
    plan = mix_plan(seen[2]).filter("taken > 0").collect()
    assert Counter(ids[3]) == Counter({r["doc_id"]: -(-r["taken"] // r["size"]) for r in plan})
    from tokenizers import Tokenizer

    from lodestone.llm.queries import vocabulary

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert ids[4] == ids[3]
    for r in seen[4].dropDuplicates(["doc_id"]).collect():
        own = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest())


def test_stages_with_repeated_ids(spark, small, tmp_path):
    """Rows that share a doc_id are documents of their own; of rows alike in it and the text the first by all columns stays."""
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    long = "one two three four five six seven eight nine ten"
    rows = [(1, long, "fr", "b", 3), (1, long.upper(), "en", "a", 3), (1, long.upper(), "de", "a", 3), (1, "quite another text", "en", "a", 2), (None, "no number", "en", "a", 1), (2, long + " eleven", "en", "a", 1)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    docs.write.parquet(str(tmp_path / "d"))
    once = corpus_pipeline.exact(spark, spark.read.parquet(str(tmp_path / "d")), small)
    assert sorted(map(tuple, once.collect()), key=repr) == sorted([rows[2], *rows[3:]], key=repr)
    once.write.parquet(str(tmp_path / "e"))
    apart = corpus_pipeline.ngram_jaccard_join(spark, spark.read.parquet(str(tmp_path / "e")), small)
    assert sorted(map(tuple, apart.collect()), key=repr) == sorted([rows[2], rows[3], rows[4]], key=repr)


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.mark.parametrize("n", range(5))
def test_stages_take_empty_tables(spark, small, n):
    empty = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[n][1](spark, empty, small).count() == 0
