"""From raw documents to token ids: language ID, exact dedup, n-gram Jaccard join, source mixing, BPE.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of
documents for all but the last. Rows keep their columns as they are:

* language_id drops texts without any letter (null ones too), which have no language.
* exact_dedup keeps the largest doc_id of equal texts; of rows alike in doc_id and text, the first by all columns.
* ngram_jaccard_join keeps the smallest doc_id of each group of linked documents (of rows that share it, the first by text).
* mix_sources repeats or drops documents by their source's target and sorts them by training position.
* bpe_encode returns doc_id, n_tokens, ids_sha256 and decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import bpe_roundtrip
from lodestone.llm.exact_dedup import keep_last
from lodestone.llm.jaccard_join import keep_firsts
from lodestone.llm.language_id import UNDETERMINED, annotate_languages
from lodestone.llm.mixing import mix_documents
from lodestone.llm.queries import vocabulary
from lodestone.storage import discard, materialise

#: SQL can't express the language models.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = annotate_languages(docs, vocabulary("piece_bpe_32k.model"), label="__lang_pred", score="__lang_score")
    return labelled.filter(F.col("__lang_pred") != UNDETERMINED).drop("__lang_pred", "__lang_score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_last(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_firsts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_roundtrip(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage has read goes once its result is written."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        discard(*read)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
