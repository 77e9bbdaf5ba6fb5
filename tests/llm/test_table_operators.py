"""Exact dedup, mixing, line dedup, licence scans and chat formatting."""

import hashlib
import json
import textwrap
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from compare import same_as_sql

from lodestone.llm.chat import format_chats
from lodestone.llm.exact_dedup import exact_dedup, fingerprints, update_state
from lodestone.llm.licenses import KNOWN, license_files, scan_licenses
from lodestone.llm.line_dedup import dedup_lines, line_dedup_digests
from lodestone.llm.mixing import integrate, mix_documents, mix_plan, mix_sources
from lodestone.llm.queries import ORACLE_SQL, QUERIES
from lodestone.storage import scratch_path


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, small, name):
    same_as_sql(QUERIES[name](spark, small), duck, ORACLE_SQL[name])


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


DOCS = "doc_id long, text string, source string, keep_id int, size string"


def test_exact_dedup_odd_rows(spark):
    rows = [(1, "A É", "s"), (2, "a É", "s"), (3, "a é", "s"), (4, None, "s"), (5, "", None), (6, "x" * 100_000, "s"), (7, "X" * 100_000, "s"), (8, "same", "s"), (8, "same", "s"), (None, "A é", "s")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], DOCS)
    got = Counter(tuple(r)[:4] for r in exact_dedup(docs).collect())
    want = [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, True), (4, 5, 2, False), (5, 5, 2, True), (6, 7, 2, False), (7, 7, 2, True), (8, 8, 2, True), (8, 8, 2, True), (None, 3, 2, False)]
    assert got == Counter(want)
    assert exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_reads_the_bytes_of_hits(spark, tmp_path):
    """Under a digest of one character, different texts clash; the rows stay apart, with the sizes of their own groups."""
    rows = [(1, "apple"), (2, "Apple"), (3, "axe"), (4, "axe"), (5, "bee"), (6, "bee"), (7, "cow"), (8, None), (9, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    weak = lambda body: F.sha2(F.substring(body, 1, 1).cast("binary"), 256)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs, weak).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (4, 2, False), 4: (4, 2, True), 5: (6, 2, False), 6: (6, 2, True), 7: (7, 1, True), 8: (9, 2, False), 9: (9, 2, True)}


def test_exact_dedup_hot_group(spark, tmp_path):
    rows = [(i, "the same" if i % 3 else f"own {i}") for i in range(6000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    out = exact_dedup(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert len(out) == 6000 and all((r["keep_id"], r["group_size"]) == ((5999, 4000) if r["doc_id"] % 3 else (r["doc_id"], 1)) for r in out)


def test_state_goes_on_without_expiry(spark):
    prints_path, state_path = scratch_path(spark, "prints"), scratch_path(spark, "state")
    for rows in ([(1, "a"), (2, "b")], [(3, "A"), (0, "b")]):
        new = fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
        new.write.mode("append").parquet(prints_path)
        state = update_state(spark.read.parquet(prints_path), state_path, prints_path)
        found = {r["text_sha256"]: (r["keep_id"], r["n_rows"]) for r in state.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found == {sha("a"): (3, 2), sha("b"): (2, 2)}


def shares(sizes, cap=3):
    """Targets by repeated sharing, with fractions of the whole."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, closed = sum(sizes.values()), {}
    while True:
        left = total - sum(closed.values())
        rest = [s for s in names if s not in closed]
        even = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if even[s] > cap * sizes[s]]
        if not over:
            return {**closed, **even}
        closed.update({s: cap * sizes[s] for s in over})


def test_mix_meets_targets(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(5, "a"), (7, "a"), (100, "b"), (300, "b"), (1, "c"), (0, "c"), (2, None), (400, "d"), (50, "Z"), (50, "Z")])]
    rows += [(90, None, "a"), (91, "only", "e"), (92, "w " * 5000, "f"), (8, "w " * 50, "Z")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], DOCS)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = shares(sizes)
    plan = mix_plan(docs).collect()
    assert len(plan) == len(rows)
    taken = defaultdict(int)
    for r in plan:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) < 1.001 for s in want)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    first, again = ([tuple(r) for r in mix_sources(docs).collect()] for _ in range(2))
    assert first == again
    positions = [r[5] for r in first if r[5] is not None]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    assert mix_sources(docs.limit(0)).count() == 0


def test_mixed_documents(spark):
    rows = [(1, "a b c d", "s1"), (2, "e f", "s1"), (3, "g " * 60, "s2"), (4, None, "s2")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], DOCS)
    plan = {r["doc_id"]: (r["taken"], r["size"]) for r in mix_plan(docs).collect()}
    got = Counter(r["doc_id"] for r in mix_documents(docs).collect())
    assert got == Counter({d: -(-t // s) for d, (t, s) in plan.items() if t})
    assert mix_documents(docs).columns == docs.columns


def test_mixed_documents_with_repeated_ids(spark):
    """Rows that share a doc_id are planned and taken each by itself; columns may have the plan's names."""
    rows = [(1, "a b c d", "s1"), (1, "g " * 60, "s2"), (1, "g " * 60, "s2"), (None, "e f", "s1"), (None, "e f", "s3"), (2, "h i j", "s3")]
    docs = spark.createDataFrame([(*r, 1, 2, "z", 3) for r in rows], "doc_id long, text string, source string, position int, copy int, mix_position string, row int").repartition(2)
    want = Counter()
    for r in mix_plan(docs).collect():
        want[r["doc_id"], r["source"], r["size"]] += -(-r["taken"] // r["size"])
    out = mix_documents(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in out.collect()) == +want


def test_schedules_integrate_to_one():
    for start, length, weight, slope, before in integrate(((0, 2), (0.25, 0), (1, 4))):
        assert length > 0 and 0 <= before < 1
    start, length, weight, slope, before = integrate(((0, 2), (0.25, 0), (1, 4)))[-1]
    assert before + weight * length + slope * length**2 / 2 == pytest.approx(1)


def test_line_dedup_odd_rows(spark):
    rows = [(i, f"own {i}\nshared line \n\nalso {i % 2}", f"s{i % 6}") for i in range(12)] + [(50, None, "s1"), (51, "", "s2"), (52, "shared line", None), (53, "\tshared line\r\n" * 500, "s0"), (1, "other text\nshared line", "s1")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], DOCS)
    got = {(r["doc_id"], r["size"]): r for r in dedup_lines(docs).filter("doc_id >= 50").collect()}
    assert got[50, "z"]["text"] is None and got[51, "z"]["text"] == "" and got[52, "z"]["text"] == "" and got[53, "z"]["n_removed"] == 500
    texts = [r["text"] for r in dedup_lines(docs).filter("doc_id < 50").collect()]
    assert len(texts) == 13 and "own 3\n\nalso 1" in texts and "other text" in texts
    assert line_dedup_digests(docs.limit(0)).count() == 0


def test_line_dedup_clashing_columns(spark, tmp_path):
    rows = [(i, "shared line\nown", f"s{i}", "g", 7, 8, "x") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, gone string, n_lines int, gone_id int, gone_text string")
    out = dedup_lines(docs)
    assert sorted(out.columns) == sorted(docs.columns + ["n_removed"])
    out.write.parquet(str(tmp_path / "o"))
    assert {(r["text"], r["gone"], r["n_lines"], r["n_removed"]) for r in out.collect()} == {("", "g", 2, 2)}


def test_line_dedup_many_sites(spark):
    rows = [(i, "everywhere\nrare" if i < 4 else "everywhere", f"site{i}") for i in range(400)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["text"] for r in out.collect()} == {"rare", ""}


def test_licenses(spark):
    mit = KNOWN["MIT"][0]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ;")), (3, "text\nReleased under the MIT licence!\nLicensed under the Apache License, Version 2.0."), (4, None), (5, ""), (6, mit + " more"), (1, mit), (7, "word " * 50_000)]
    docs = spark.createDataFrame([(*r, "s", 1, "z") for r in rows], DOCS)
    got = scan_licenses(docs).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: (r["whole_license"], r["line_licenses"]) for r in got}
    assert found[1] == ("MIT", "") and found[2][0] == "MIT" and found[3] == (None, "Apache-2.0,MIT")
    assert all(found[i] == (None, "") for i in (4, 5, 6, 7))
    assert scan_licenses(docs.limit(0)).count() == 0


def test_license_spellings_are_whole_words(spark):
    mit = KNOWN["MIT"][0]
    rows = [(1, mit.replace("noninfringement", "non infringement").replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace("sublicense", "sub-licence")), (2, "paper centre"), (3, "papercentre"), (4, "Licenced under the MIT licence."), (5, "Unlicenced")]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["whole_license"] == "MIT" and got[4]["line_licenses"] == "MIT"
    assert got[2]["text_md5"] == hashlib.md5(b"paper centre").hexdigest() and got[5]["text_md5"] == hashlib.md5(b"unlicenced").hexdigest()


def test_license_query_finds_files(spark, small):
    found = {r["doc_id"]: r["whole_license"] for r in QUERIES["op6_license_scan"](spark, small).filter("doc_id < 0").collect()}
    assert len(found) == len(license_files()) and None not in found.values() and len(set(found.values())) >= 6


def test_license_files(spark):
    wrapped = lambda t: "\n".join(line for p in t.split("\n") for line in textwrap.wrap(p, 76))
    notice = "Copyright (c) 2025 Someone\n"
    bsd = KNOWN["BSD-3-Clause"][0]
    wrapped_at_copyright = bsd.replace(" copyright", "\ncopyright").replace(" COPYRIGHT", "\nCOPYRIGHT")
    rows = [
        (1, "MIT", "MIT License\n\n" + notice + "\n" + wrapped(KNOWN["MIT"][0]) + "\n"), (2, "MIT", "The MIT License (MIT)\n" + notice + wrapped(KNOWN["MIT"][0])),
        (3, "BSD-3-Clause", "BSD 3-Clause License\n\n" + notice + "All rights reserved.\n\n" + wrapped_at_copyright), (4, "ISC", "ISC License\n\nCopyright Someone\n\n" + wrapped(KNOWN["ISC"][0])),
        (5, "BSD-2-Clause", KNOWN["BSD-2-Clause"][0].replace("1. ", "* ").replace("2. ", "* ")), (6, None, "MIT License\n\n" + notice), (7, None, "All rights reserved.\n"), (8, None, "MIT License\n\n" + KNOWN["MIT"][0] + "\nand more"),
    ]
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3"}
    rows += [(100 + i, name, (folder / f).read_text()) for i, (f, name) in enumerate(files.items()) if (folder / f).exists()]
    got = scan_licenses(spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["whole_license"] for r in got} == {d: name for d, name, _ in rows}


def call(i, name, arguments, *needs):
    return {"id": i, "name": name, "arguments": arguments, "depends_on": list(needs)}


def test_chat_links_orders_and_validates(spark):
    rows = [
        (1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", json.dumps({"content": "ok", "tool_calls": [call("c", "fetch", {"url": "u", "extra": {"z": 1, "a": [True, None]}}, "b"), call("b", "search", {"query": "q"}, "a", "gone"), call("a", "search", {"limit": 3, "query": "é"})]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "R"})), (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "late"})), (1, 4, "tool", json.dumps({"tool_call_id": "nobody", "content": ""})),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("x", "calculate", {"precision": "two"}, "y"), call("y", "nope", "text", "x"), call("x", "search", {"query": 1})]})),
        (3, None, None, None), (None, 1, "assistant", "{bad"), (4, 0, "user", "w " * 60_000),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_calls int")
    got = {r["conv_id"]: r for r in format_chats(frame).collect()}
    assert {k: (r["n_messages"], r["n_calls"], r["n_linked"], r["n_invalid"]) for k, r in got.items()} == {1: (5, 3, 1, 1), 2: (1, 3, 0, 3), 3: (1, 0, 0, 0), None: (1, 0, 0, 0), 4: (1, 0, 0, 0)}
    chat = json.loads(got[1]["chat"])
    assert [(c["id"], c["level"], c.get("result"), c.get("problems")) for c in chat[1]["tool_calls"]] == [("a", 0, "R", None), ("b", 1, None, None), ("c", 2, None, ["unknown:extra"])]
    assert '"arguments":{"extra":{"a":[true,null],"z":1},"url":"u"}' in got[1]["chat"]
    problems = [c["problems"] for c in json.loads(got[2]["chat"])[0]["tool_calls"]]
    assert problems == [["cyclic", "missing:expression", "type:precision"], ["arguments", "cyclic", "tool"], ["duplicate", "type:query"]]
    assert format_chats(frame.limit(0)).count() == 0


def test_chat_keeps_messages_of_one_turn(spark):
    ask = lambda content, *calls: json.dumps({"content": content, "tool_calls": list(calls)})
    free = {"name": "search", "arguments": {"query": "q"}}
    messages = [("assistant", ask("a", call("x", "search", {"query": "1"}))), ("assistant", ask("b", call("y", "search", {"query": "2"}), call("x", "search", {"query": "3"}))), ("assistant", ask("c", free, free)), ("assistant", ask("c", free, free))]
    rows = [(c, turn, *m) for c, turn in ((1, 5), (2, None)) for m in messages] + [(1, 6, "tool", json.dumps({"tool_call_id": "y", "content": "R"}))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in format_chats(frame.repartition(3)).collect()}
    assert {k: (r["n_messages"], r["n_calls"], r["n_linked"], r["n_invalid"]) for k, r in got.items()} == {1: (5, 7, 1, 1), 2: (4, 7, 0, 1)}
    for c in (1, 2):
        chat = json.loads(got[c]["chat"])[:4]
        assert [(m["content"], [(k.get("id"), k["arguments"]["query"], k.get("problems")) for k in m["tool_calls"]]) for m in chat] == [
            ("a", [("x", "1", None)]), ("b", [("y", "2", None), ("x", "3", ["duplicate"])]), ("c", [(None, "q", None)] * 2), ("c", [(None, "q", None)] * 2),
        ]


def test_chat_numbers_and_null_calls(spark):
    """Numbers without a fraction are integers, also as 1.0 and beyond 64 bits; a null among calls is a call without anything."""
    texts = ["1.0", "2", "1.5", "12345678901234567890123", "1e3", "0.0", "-3.0", '"1"', "true", "[1]"]
    made = "".join(f',{{"id":"c{i}","name":"calculate","arguments":{{"expression":"x","precision":{t}}}}}' for i, t in enumerate(texts))
    rows = [(1, 0, "assistant", f'{{"tool_calls":[{made[1:]}]}}'), (2, 0, "assistant", '{"tool_calls":[null,{"id":"a","name":"search","arguments":{"query":"q"}}]}')]
    got = {r["conv_id"]: r for r in format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    problems = {c["id"]: c.get("problems") for c in json.loads(got[1]["chat"])[0]["tool_calls"]}
    assert problems == {f"c{i}": None if i in (0, 1, 3, 4, 5, 6) else ["type:precision"] for i in range(len(texts))}
    assert (got[2]["n_calls"], got[2]["n_invalid"]) == (2, 1)
    assert sorted(len(c.get("problems", [])) > 0 for c in json.loads(got[2]["chat"])[0]["tool_calls"]) == [False, True]
