"""Queries of the operators without a fixed result: chat formatting, line dedup and licence scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import licenses
from lodestone.llm.chat import format_chats
from lodestone.llm.line_dedup import line_dedup_digests


def with_tool_calls(rows: DataFrame) -> DataFrame:
    """Conversations that answer with tools, one for each of rows, under -1 - conv_id.

    An assistant's message becomes three calls (the text is searched for, its length calculated, an address fetched that
    needs both), an answer to the search, to texts of even length one to the calculation, and the message itself. The
    fetch has no address but a field that its schema lacks; the precision of calculations on texts of an odd length is a
    text. Other messages stay.
    """
    conv, turn = -1 - F.col("conv_id"), F.col("turn") * 4
    role, text = F.coalesce("role", F.lit("user")), F.coalesce("text", F.lit(""))
    size = F.length(text)
    quoted = F.to_json(F.struct(text.alias("query")))
    sized = F.when(size % 2 == 0, F.to_json(F.struct(size.cast("string").alias("expression"), F.lit(2).alias("precision")))).otherwise(
        F.to_json(F.struct(size.cast("string").alias("expression"), F.lit("two").alias("precision")))
    )
    at = F.col("turn").cast("string")
    asked = F.concat(
        F.lit('{"tool_calls":[{"id":"f'), at, F.lit('","name":"fetch","arguments":{"depth":1},"depends_on":["c'), at, F.lit('","s'), at, F.lit('"]},{"id":"c'), at,
        F.lit('","name":"calculate","arguments":'), sized, F.lit(',"depends_on":["s'), at, F.lit('"]},{"id":"s'), at, F.lit('","name":"search","arguments":'), quoted, F.lit("}]}"),
    )
    found = F.to_json(F.struct(F.concat(F.lit("s"), at).alias("tool_call_id"), text.alias("content")))
    counted = F.to_json(F.struct(F.concat(F.lit("c"), at).alias("tool_call_id"), size.cast("string").alias("content")))
    message = lambda after, kind, body: F.struct((turn + after).alias("turn"), F.lit(kind).alias("role"), body.alias("text"))
    said = F.array(message(0, "assistant", asked), message(1, "tool", found), F.when(size % 2 == 0, message(2, "tool", counted)), message(3, "assistant", text))
    plain = F.array(F.struct(turn.alias("turn"), role.alias("role"), text.alias("text")))
    messages = F.when(role == "assistant", F.array_compact(said)).otherwise(plain)
    return rows.select(conv.alias("conv_id"), F.explode(messages).alias("m")).select("conv_id", "m.turn", "m.role", "m.text")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    chats = format_chats(rows.unionByName(with_tool_calls(rows)))
    return chats.select("conv_id", "n_messages", "n_calls", "n_linked", "n_invalid", F.sha2(F.col("chat").cast("binary"), 256).alias("chat_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and, under negative identifiers, files of the short licences."""
    files = spark.createDataFrame(licenses.license_files(), "doc_id long, text string")
    return licenses.scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(files))


QUERIES = {"op4_chat_format": op4_chat_format, "op5_line_dedup": op5_line_dedup, "op6_license_scan": op6_license_scan}

ORACLE_SQL = {
    # messages, calls and answers by their JSON; the level of a call is the longest way to it
    "op4_chat_format": r"""
        WITH RECURSIVE m AS (
            SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
        ), a AS (
            SELECT -1 - conv_id AS conv_id, turn * 4 AS t, turn::VARCHAR AS n, text, length(text) AS size FROM m WHERE role = 'assistant'
        ), g AS (
            SELECT conv_id, turn, role, text FROM m
            UNION ALL SELECT -1 - conv_id, turn * 4, role, text FROM m WHERE role <> 'assistant'
            UNION ALL SELECT conv_id, t, 'assistant', concat('{"tool_calls":[{"id":"f', n, '","name":"fetch","arguments":{"depth":1},"depends_on":["c', n, '","s', n, '"]},{"id":"c', n,
                '","name":"calculate","arguments":{"expression":"', size, '","precision":', CASE WHEN size % 2 = 0 THEN '2' ELSE '"two"' END, '},"depends_on":["s', n, '"]},{"id":"s', n,
                '","name":"search","arguments":', to_json({'query': text}), '}]}') FROM a
            UNION ALL SELECT conv_id, t + 1, 'tool', to_json({'tool_call_id': 's' || n, 'content': text})::VARCHAR FROM a
            UNION ALL SELECT conv_id, t + 2, 'tool', to_json({'tool_call_id': 'c' || n, 'content': size::VARCHAR})::VARCHAR FROM a WHERE size % 2 = 0
            UNION ALL SELECT conv_id, t + 3, 'assistant', text FROM a
        ), j AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS msg, CASE WHEN starts_with(text, '{') AND role IN ('assistant', 'tool') AND json_valid(text) THEN text::JSON END AS p FROM g
        ), c AS (
            SELECT conv_id, turn, msg, (generate_subscripts(json_extract(p, '$.tool_calls[*]'), 1) - 1)::INT AS pos, unnest(json_extract(p, '$.tool_calls[*]')) AS call
            FROM j WHERE role = 'assistant' AND json_array_length(p, '$.tool_calls') > 0
        ), d AS (
            SELECT conv_id, turn, msg, pos, json_extract_string(call, '$.id') AS id, json_extract_string(call, '$.name') AS name, json_extract(call, '$.arguments') AS args,
                   json_extract_string(call, '$.depends_on[*]') AS needs FROM c
        ), e AS (
            SELECT *, id IS NOT NULL AND row_number() OVER (PARTITION BY conv_id, id ORDER BY turn, msg, pos) > 1 AS dup FROM d
        ), n AS (
            SELECT conv_id, id, unnest(list_distinct(needs)) AS need FROM e WHERE NOT dup AND id IS NOT NULL
        ), w AS (
            SELECT n.* FROM n JOIN e ON e.conv_id = n.conv_id AND e.id = n.need AND NOT e.dup
        ), r(conv_id, id, level) AS (
            SELECT conv_id, id, 0 FROM e WHERE NOT dup AND id IS NOT NULL AND (conv_id, id) NOT IN (SELECT (conv_id, id) FROM w)
            UNION SELECT w.conv_id, w.id, level + 1 FROM r JOIN w ON w.conv_id = r.conv_id AND w.need = r.id
        ), v AS (
            SELECT conv_id, id, max(level) AS level FROM r GROUP BY ALL
        ), x AS (
            SELECT e.conv_id, e.turn, e.msg, e.pos, min((t.turn, json_extract_string(t.p, '$.content'))) AS answer FROM e
            JOIN j t ON t.role = 'tool' AND t.conv_id = e.conv_id AND json_extract_string(t.p, '$.tool_call_id') = e.id AND t.turn > e.turn WHERE NOT dup GROUP BY ALL
        ), tools(tool, field, kind, required) AS (
            VALUES ('search', 'query', 'string', TRUE), ('search', 'limit', 'integer', FALSE), ('fetch', 'url', 'string', TRUE), ('calculate', 'expression', 'string', TRUE), ('calculate', 'precision', 'integer', FALSE)
        ), f AS (
            SELECT conv_id, turn, msg, pos, name, unnest(json_keys(args)) AS field, args FROM e
        ), b AS (
            SELECT conv_id, turn, msg, pos, CASE WHEN kind IS NULL THEN 'unknown:' || f.field ELSE 'type:' || f.field END AS problem
            FROM f LEFT JOIN tools ON tool = name AND tools.field = f.field
            WHERE kind IS NULL OR kind <> CASE json_type(args, '$.' || f.field) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' ELSE 'other' END
            UNION ALL SELECT conv_id, turn, msg, pos, 'missing:' || field FROM e JOIN tools ON tool = name AND required WHERE NOT list_contains(json_keys(args), field)
            UNION ALL SELECT conv_id, turn, msg, pos, 'duplicate' FROM e WHERE dup
            UNION ALL SELECT conv_id, turn, msg, pos, 'tool' FROM e WHERE name IS NULL OR name NOT IN (SELECT tool FROM tools)
        ), y AS (
            SELECT conv_id, turn, msg, pos, to_json(list(problem ORDER BY problem))::VARCHAR AS problems FROM b GROUP BY ALL
        ), z AS (
            SELECT e.conv_id, e.turn, e.msg, count(*) AS calls, count(answer) AS linked, count(problems) AS invalid,
                   string_agg(concat('{"arguments":', args, ',"id":' || to_json(e.id), ',"level":' || level, ',"name":' || to_json(name), ',"problems":' || problems, CASE WHEN answer IS NOT NULL THEN ',"result":' || to_json(coalesce(answer[2], '')) END, '}'), ',' ORDER BY level NULLS LAST, e.pos) AS made
            FROM e LEFT JOIN v ON v.conv_id = e.conv_id AND v.id = e.id AND NOT dup
            LEFT JOIN x ON x.conv_id = e.conv_id AND x.turn = e.turn AND x.msg = e.msg AND x.pos = e.pos
            LEFT JOIN y ON y.conv_id = e.conv_id AND y.turn = e.turn AND y.msg = e.msg AND y.pos = e.pos GROUP BY ALL
        ), o AS (
            SELECT j.conv_id, j.turn, role, text, calls, linked, invalid, CASE
                WHEN calls > 0 THEN concat('{"content":', to_json(coalesce(json_extract_string(p, '$.content'), '')), ',"role":"assistant","tool_calls":[', made, ']}')
                WHEN role = 'tool' AND json_extract_string(p, '$.tool_call_id') IS NOT NULL THEN to_json({'content': coalesce(json_extract_string(p, '$.content'), ''), 'role': role, 'tool_call_id': json_extract_string(p, '$.tool_call_id')})::VARCHAR
                ELSE to_json({'content': text, 'role': role})::VARCHAR END AS json
            FROM j LEFT JOIN z ON z.conv_id = j.conv_id AND z.turn = j.turn AND z.msg = j.msg
        )
        SELECT conv_id, count(*) AS n_messages, coalesce(sum(calls), 0)::BIGINT AS n_calls, coalesce(sum(linked), 0)::BIGINT AS n_linked, coalesce(sum(invalid), 0)::BIGINT AS n_invalid,
               sha256('[' || string_agg(json, ',' ORDER BY turn, role, text) || ']') AS chat_sha256
        FROM o GROUP BY conv_id
    """,
    "op5_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
        ), t AS (
            SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM l
        ), w AS (
            SELECT line FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 5
        ), k AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE line IN (SELECT line FROM w)) AS n_removed,
                   string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE line NOT IN (SELECT line FROM w)) AS kept
            FROM t GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id
    """,
    "op6_license_scan": licenses.oracle_sql(),
}
