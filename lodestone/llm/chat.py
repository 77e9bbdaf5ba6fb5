"""Chat formatting with linked tool calls.

Messages are rows (conv_id, turn, role, text). An assistant text that is a JSON object with `tool_calls`, a list of
objects with id, name, arguments and depends_on, makes calls; a tool text that is one with `tool_call_id` and `content`
answers one. Calls and answers are hash-joined by conversation and identifier, without their texts; calls get a level, one
more than the highest level they depend on; arguments are checked, within their message, against the fields that a tool's
schema lists; messages become canonical JSON (keys in order, no white space, null fields left out), with calls in topological
order.

Null text counts as empty and a null role as `user`. A text that isn't such JSON is plain content. Messages of one turn
are ordered by role and text; repeated rows count each. Of calls with one identifier the first is linked, the rest are
`duplicate`; an answer goes to its call if it is of a later turn, the first such answer counts. Dependencies on unknown
identifiers are ignored; calls in a cycle have no level, come last and are `cyclic`. Rows with a null conv_id form a
conversation of their own. A null among the calls is a call without identifier, tool and arguments. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import discard, materialise, scratch_path

#: (tool, field, type, required); types as in JSON schema.
ToolField = tuple[str, str, str, bool]
TOOLS: Sequence[ToolField] = (
    ("search", "query", "string", True),
    ("search", "limit", "integer", False),
    ("fetch", "url", "string", True),
    ("calculate", "expression", "string", True),
    ("calculate", "precision", "integer", False),
)
PAYLOAD = "tool_calls array<struct<id string, name string, arguments string, depends_on array<string>>>, tool_call_id string, content string"


def json_type(value: Column) -> Column:
    """JSON schema's name for the type of a variant; a number without a fraction is an integer, however it is written."""
    kind = F.schema_of_variant(value)
    whole = F.try_variant_get(value, "$", "double") % 1 == 0
    return (
        F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when((kind == "BIGINT") | whole, "integer").otherwise("number")
    )


def read_messages(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, payload (null for plain content)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit("user"))
    looks_json = text.startswith("{") & role.isin("assistant", "tool")
    payload = F.when(looks_json & F.try_parse_json(text).isNotNull(), F.from_json(text, PAYLOAD))
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), payload.alias("payload"))
    calls = (F.col("role") == "assistant") & (F.size("payload.tool_calls") > 0)
    answers = (F.col("role") == "tool") & F.col("payload.tool_call_id").isNotNull()
    return plain.withColumn("payload", F.when(calls | answers, F.col("payload")))


def numbered(messages: DataFrame) -> DataFrame:
    """messages with msg, their number within conversation and turn, ordered by role and text."""
    return messages.withColumn("msg", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))


def link_calls(messages: DataFrame) -> DataFrame:
    """conv_id, turn, msg, pos, call_id, depends_on, duplicate, answer (turn and msg of the tool's message) for every call."""
    calls = messages.filter("role = 'assistant'").select("conv_id", "turn", "msg", F.posexplode(F.transform("payload.tool_calls", lambda c: F.struct(c["id"].alias("id"), c["depends_on"].alias("depends_on")))).alias("pos", "c"))
    calls = calls.select("conv_id", "turn", "msg", "pos", F.col("c.id").alias("call_id"), F.col("c.depends_on").alias("depends_on"))
    in_order = Window.partitionBy("conv_id", "call_id").orderBy("turn", "msg", "pos")
    calls = calls.withColumn("duplicate", (F.row_number().over(in_order) > 1) & F.col("call_id").isNotNull())
    answers = messages.filter("role = 'tool'").select(F.col("conv_id").alias("a_conv"), F.col("payload.tool_call_id").alias("a_call"), F.col("turn").alias("a_turn"), F.col("msg").alias("a_msg"))
    same = calls["conv_id"].eqNullSafe(answers["a_conv"]) & (calls["call_id"] == answers["a_call"]) & ~calls["duplicate"] & (answers["a_turn"] > calls["turn"])
    joined = calls.join(answers.hint("shuffle_hash"), same, "left")
    keys = ["conv_id", "turn", "msg", "pos", "call_id", "depends_on", "duplicate"]
    return joined.groupBy(*keys).agg(F.min(F.when(F.col("a_turn").isNotNull(), F.struct(F.col("a_turn").alias("turn"), F.col("a_msg").alias("msg")))).alias("answer"))


def order_calls(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of the calls that are not duplicates; no level for those in or behind a cycle.

    Every round frees the calls whose needs are all met and appends them to one table, so plans don't grow with levels.
    """
    spark = calls.sparkSession
    nodes = calls.filter("NOT duplicate AND call_id IS NOT NULL").select("conv_id", "call_id", F.col("depends_on"))
    wanted = nodes.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("needs"))
    known = nodes.select(F.col("conv_id").alias("k_conv"), F.col("call_id").alias("k_call"))
    open_edges = materialise(wanted.join(known, wanted["conv_id"].eqNullSafe(known["k_conv"]) & (wanted["needs"] == known["k_call"]), "left_semi"), "call-edges")
    names = nodes.select("conv_id", "call_id")

    def without(rows: DataFrame, others: DataFrame) -> DataFrame:
        other = others.select(F.col("conv_id").alias("o_conv"), F.col("call_id").alias("o_call")).distinct()
        return rows.join(other, rows["conv_id"].eqNullSafe(other["o_conv"]) & (rows["call_id"] == other["o_call"]), "left_anti")

    path, level = scratch_path(spark, "call-levels"), 0
    without(names, open_edges).withColumn("level", F.lit(0)).write.parquet(path)
    schema = spark.read.parquet(path).schema
    while not open_edges.isEmpty():
        ready = spark.read.schema(schema).parquet(path).filter(F.col("level") == level).select(F.col("conv_id").alias("d_conv"), F.col("call_id").alias("d_call"))
        rest = materialise(open_edges.join(ready, open_edges["conv_id"].eqNullSafe(ready["d_conv"]) & (open_edges["needs"] == ready["d_call"]), "left_anti"), "call-edges")
        freed = materialise(without(open_edges.select("conv_id", "call_id").distinct(), rest), "calls-freed")
        if freed.isEmpty():
            break
        level += 1
        freed.withColumn("level", F.lit(level)).write.mode("append").parquet(path)
        discard(open_edges, freed)
        open_edges = rest
    done = spark.read.schema(schema).parquet(path).select(F.col("conv_id").alias("d_conv"), F.col("call_id").alias("d_call"), "level")
    return names.join(done, names["conv_id"].eqNullSafe(done["d_conv"]) & (names["call_id"] == done["d_call"]), "left").select("conv_id", "call_id", "level")


def tool_schemas(tools: Sequence[ToolField]) -> Column:
    """The tools as a constant map: name to the types of its fields and the required ones."""
    schemas: dict[str, dict] = {}
    for tool, field, kind, required in tools:
        own = schemas.setdefault(tool, {"fields": {}, "required": []})
        own["fields"][field] = kind
        own["required"] += [field] * required
    return F.from_json(F.lit(json.dumps(schemas)), "map<string,struct<fields:map<string,string>,required:array<string>>>")


def argument_problems(call: Column, schema: Column) -> Column:
    """What is wrong with a call's arguments by the schema of its tool (null: no such tool)."""
    none = F.array().cast("array<string>")
    given = F.when(is_object(call["arguments"]), F.from_json(call["arguments"], "map<string,variant>"))

    def wrong(entry: Column) -> Column:
        kind, own = F.element_at(schema["fields"], entry["key"]), json_type(entry["value"])
        fits = (kind == own) | ((kind == "number") & (own == "integer"))
        return F.when(kind.isNull(), F.concat(F.lit("unknown:"), entry["key"])).when(~fits, F.concat(F.lit("type:"), entry["key"]))

    found = F.array_compact(F.transform(F.coalesce(F.map_entries(given), F.array().cast("array<struct<key:string,value:variant>>")), wrong))
    have = F.coalesce(F.map_keys(given), none)
    missing = F.transform(F.filter(schema["required"], lambda r: ~F.array_contains(have, r)), lambda r: F.concat(F.lit("missing:"), r))
    return F.when(schema.isNull(), none).otherwise(F.concat(found, missing))


def is_object(arguments: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(arguments)).startswith("OBJECT"), F.lit(False))


def call_json(call: Column, mark: Column, schemas: Column) -> Column:
    """A call with its mark (duplicate, cyclic, level, result): struct of place, json, linked, invalid. Arguments that are no object stay as the text they are."""
    own = F.array_compact(F.array(
        F.when(mark["duplicate"], "duplicate"), F.when(~is_object(call["arguments"]), "arguments"), F.when(F.element_at(schemas, call["name"]).isNull(), "tool"), F.when(mark["cyclic"], "cyclic"),
    ))
    problems = F.array_sort(F.array_distinct(F.concat(own, argument_problems(call, F.element_at(schemas, call["name"])))))
    shown = F.when(is_object(call["arguments"]), F.to_json(F.try_parse_json(call["arguments"]))).otherwise(F.to_json(F.struct(F.coalesce(call["arguments"], F.lit("")).alias("text"))))
    rest = F.to_json(F.struct(call["id"].alias("id"), mark["level"].alias("level"), call["name"].alias("name"), F.when(F.size(problems) > 0, problems).alias("problems"), mark["result"].alias("result")))
    text = F.concat(F.lit('{"arguments":'), shown, F.when(rest == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), F.substr(rest, F.lit(2)))))
    return F.struct(F.coalesce(mark["level"], F.lit(1 << 30)).alias("level"), mark["pos"].alias("pos"), text.alias("json"), mark["result"].isNotNull().alias("linked"), (F.size(problems) > 0).alias("invalid"))


def call_marks(structured: DataFrame) -> DataFrame:
    """c_conv, c_turn, c_msg, marks: what linking and ordering tell of each message's calls, in their places."""
    links = materialise(link_calls(structured), "call-links")
    levels = order_calls(links).select(F.col("conv_id").alias("l_conv"), F.col("call_id").alias("l_call"), "level")
    own = links.join(levels, links["conv_id"].eqNullSafe(levels["l_conv"]) & (links["call_id"] == levels["l_call"]) & ~links["duplicate"], "left")
    cyclic = F.col("level").isNull() & ~F.col("duplicate") & F.col("call_id").isNotNull()
    contents = structured.filter("role = 'tool'").select(F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("msg").alias("a_msg"), F.coalesce("payload.content", F.lit("")).alias("result"))
    met = own["conv_id"].eqNullSafe(contents["a_conv"]) & (own["answer.turn"] == contents["a_turn"]) & (own["answer.msg"] == contents["a_msg"])
    marked = own.join(contents, met, "left").select("conv_id", "turn", "msg", F.struct("pos", "duplicate", cyclic.alias("cyclic"), "level", "result").alias("mark"))
    grouped = marked.groupBy(F.col("conv_id").alias("c_conv"), F.col("turn").alias("c_turn"), F.col("msg").alias("c_msg"))
    return grouped.agg(F.array_sort(F.collect_list("mark")).alias("marks"))


def format_chats(rows: DataFrame, tools: Sequence[ToolField] = TOOLS) -> DataFrame:
    """conv_id, chat (canonical JSON), n_messages, n_calls, n_linked, n_invalid for every conversation."""
    messages = read_messages(rows)
    structured = materialise(numbered(messages.filter("payload IS NOT NULL")), "chat-calls")
    none = F.lit(0).cast("long")
    counts = [none.alias("calls"), none.alias("linked"), none.alias("invalid")]
    out = messages.filter("payload IS NULL").select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("json"), *counts)
    if not structured.isEmpty():
        marks = call_marks(structured)
        asked = structured.filter("role = 'assistant'")
        asked = asked.join(marks, asked["conv_id"].eqNullSafe(marks["c_conv"]) & asked["turn"].eqNullSafe(marks["c_turn"]) & (asked["msg"] == marks["c_msg"]))
        schemas = tool_schemas(tools)
        asked = asked.withColumn("made", F.array_sort(F.zip_with("payload.tool_calls", "marks", lambda c, m: call_json(c, m, schemas))))
        head = F.to_json(F.struct(F.coalesce("payload.content", F.lit("")).alias("content"), "role"))
        made_json = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"tool_calls":['), F.array_join(F.col("made.json"), ","), F.lit("]}"))
        count = lambda field: F.size(F.filter("made", lambda c: c[field])).cast("long")
        made = asked.select("conv_id", "turn", "role", "text", made_json.alias("json"), F.size("made").cast("long").alias("calls"), count("linked").alias("linked"), count("invalid").alias("invalid"))
        answer = F.to_json(F.struct(F.coalesce("payload.content", F.lit("")).alias("content"), "role", F.col("payload.tool_call_id").alias("tool_call_id")))
        out = out.unionByName(made).unionByName(structured.filter("role = 'tool'").select("conv_id", "turn", "role", "text", answer.alias("json"), *counts))
    grouped = out.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "json"))).alias("m"), F.count(F.lit(1)).alias("n_messages"),
        F.sum("calls").alias("n_calls"), F.sum("linked").alias("n_linked"), F.sum("invalid").alias("n_invalid"),
    )
    # plain messages are written here, so that their text travels once
    written = F.transform("m", lambda m: F.coalesce(m["json"], F.to_json(F.struct(m["text"].alias("content"), m["role"].alias("role")))))
    chat = F.concat(F.lit("["), F.array_join(written, ","), F.lit("]"))
    return grouped.select("conv_id", chat.alias("chat"), "n_messages", "n_calls", "n_linked", "n_invalid")
