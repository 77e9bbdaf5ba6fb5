"""The registered queries of this package and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import extra_queries, sampling_queries
from lodestone.llm.bpe import bpe_roundtrip
from lodestone.llm.embedding_dedup import near_duplicates
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.jaccard_join import jaccard_components
from lodestone.llm.language_id import identify_languages
from lodestone.llm.mixing import mix_sources
from lodestone.llm.suffix_dedup import remove_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_roundtrip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_bpe_roundtrip": op2_bpe_roundtrip,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_exact_dedup": op10_exact_dedup,
    **extra_queries.QUERIES,
    **sampling_queries.QUERIES,
}

ORACLE_SQL = {
    **extra_queries.ORACLE_SQL,
    **sampling_queries.ORACLE_SQL,
    "op10_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
            FROM documents
        ), k AS (
            SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, sha256(body) AS text_sha256
            FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
    """,
    "op9_mix_sources": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS k
            FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank FROM d GROUP BY source
        ), w AS (
            SELECT *, (source_rank % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM s
        ), r AS (  -- share what is left among the open sources; those above their cap are closed at it
            SELECT 0 AS i, *, FALSE AS capped, 0.0::DOUBLE AS level FROM w
            UNION ALL
            SELECT i + 1, source, source_size, source_rank, weight, cap, capped OR cap <= l * weight, l
            FROM (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)) / sum(weight) FILTER (WHERE NOT capped) OVER () AS l FROM r WHERE i < 40)
        ), t AS (
            SELECT source, source_size, source_rank, CASE WHEN capped THEN cap ELSE level * weight END AS target FROM r WHERE i = 40
        ), p AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, t.source_rank, floor(t.target)::BIGINT AS quota,
                   CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size)::BIGINT ELSE 0 END AS passes,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), q AS (
            SELECT *, (passes * size + least(greatest(quota - passes * source_size - before, 0), size))::BIGINT AS taken FROM p
        ), f AS (
            SELECT *, (before + least(size, taken) / 2.0) / quota AS share FROM q
        )
        SELECT doc_id, size, source_size, target, taken,
               CASE WHEN taken > 0 THEN round(CASE source_rank % 3
                   WHEN 0 THEN least(2 * share / (1.0 + sqrt(1.0)), 1.0)
                   WHEN 1 THEN least(2 * share / (0.5 + sqrt(0.25 + 2.0 * share)), 1.0)
                   ELSE least(2 * share / (1.5 + sqrt(greatest(2.25 - 2.0 * share, 0.0))), 1.0) END, 9) END AS position
        FROM f
    """,
}
