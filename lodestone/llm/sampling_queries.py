"""Queries of the fill-in-the-middle transformation, the address filter and importance resampling, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.fim import fim_digests
from lodestone.llm.resample import resample
from lodestone.llm.url_filter import judge


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle, "op12_url_filter": op12_url_filter, "op13_importance_resampling": op13_importance_resampling}

#: SQL can't train op12's model.
ORACLE_SQL = {
    "op11_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256(concat('1:', doc_id)) AS h FROM documents
        ), k AS (
            SELECT doc_id, text, units, len(units)::BIGINT AS n, [('0x' || substr(h, i * 8 + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM d
        ), c AS (
            SELECT doc_id, text, n, units, least(h[1] % (n + 1), h[2] % (n + 1)) AS first, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS last,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k
        ), p AS (
            SELECT doc_id, text, n, form, array_to_string(units[1:first], '') AS prefix, array_to_string(units[first + 1:last], '') AS middle, array_to_string(units[last + 1:n], '') AS suffix FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(prefix || middle || suffix) AS restored_sha256
        FROM p
    """,
    # crc32 byte by byte, for each distinct word once
    "op13_importance_resampling": r"""
        WITH texts AS (
            SELECT doc_id, FALSE AS wanted, text FROM documents UNION ALL SELECT NULL, TRUE, text FROM benchmark
        ), numbered AS (
            SELECT row_number() OVER () AS row_no, * FROM texts
        ), words AS (
            SELECT row_no, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM numbered
        ), held AS (
            SELECT row_no, word, count(*) AS n FROM words GROUP BY ALL
        ), crc_table AS (
            SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS crcs FROM range(256) AS r(i)
        ), bytes AS (
            SELECT word, [('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT FOR i IN range(strlen(word))] AS bytes FROM (SELECT DISTINCT word FROM held)
        ), buckets AS (
            SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM bytes, crc_table
        ), shares AS (
            SELECT bucket, sum(n) FILTER (WHERE NOT wanted) AS s, sum(n) FILTER (WHERE wanted) AS t FROM held JOIN numbered USING (row_no) JOIN buckets USING (word) GROUP BY bucket
        ), gains AS (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(sum(t) OVER (), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM shares
        ), sums AS (
            SELECT row_no, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM held JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY row_no
        ), scored AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM numbered LEFT JOIN sums USING (row_no) WHERE NOT wanted
        ), placed AS (
            SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * count(place) OVER () // 100 THEN place END AS rank FROM placed
    """,
}
