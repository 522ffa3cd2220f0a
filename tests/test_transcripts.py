"""Readers against small transcripts written out here."""

import json

import pytest
from pyspark.sql import functions as F

from turnlake.sources import transcripts as tr
from turnlake.streaming.sync import stream_new


def rows(spark, entries, path="f"):
    lines = [(path, k, e if isinstance(e, str) else json.dumps(e)) for k, e in enumerate(entries)]
    return spark.createDataFrame(lines, "path string, line_no long, line string")


def test_claude(spark):
    entries = [
        {"uuid": "a", "sessionId": "s", "type": "user", "timestamp": "2026-01-01T00:00:00Z", "cwd": "/w/.claude/worktrees/x", "message": {"role": "user", "content": "[hello"}},
        "not json", {"type": "progress"},
        {"uuid": "b", "sessionId": "s", "type": "assistant", "timestamp": "bad", "message": {"model": "m", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "ls"}}, {"type": "tool_use", "id": "c2", "name": "Task", "input": {}}], "usage": {"input_tokens": 3, "output_tokens": 4}}},
        {"uuid": "c", "sessionId": "s", "type": "user", "timestamp": "2026-01-01T00:00:02Z", "message": {"content": [{"type": "tool_result", "tool_use_id": "c1", "content": "first", "is_error": True}]}},
        {"uuid": "d", "sessionId": "s", "type": "user", "timestamp": "2026-01-01T00:00:03Z", "message": {"content": [{"type": "tool_result", "tool_use_id": "c1", "content": "second"}]}},
    ]
    lines = rows(spark, entries, "/p/s.jsonl")
    turns = tr.claude_turns(lines)
    got = [(r.id, r.type, r.content, r.ordinal) for r in turns.orderBy("ordinal").collect()]
    assert got == [
        ("a", "user", "[hello", 0), ("b", "assistant", "hm\nok\n[Tool: Bash] $ ls\n[Tool: Task]", 1),
        ("c", "tool_result", "[Tool Result: first]", 2), ("d", "tool_result", "[Tool Result: second]", 3),
    ]
    calls = {r.tool_use_id: (r.result_content, r.is_error, r.result_length, r.turn_ordinal) for r in tr.claude_calls(turns).collect()}
    assert calls == {"c1": ("first", True, 5, 0), "c2": (None, None, None, 1)}
    skip = tr.skipped(lines).first()
    assert (skip.unreadable, skip.without_id) == (1, 1)
    s = tr.session_rows(turns, tr.claude_calls(turns), "claude-code").first()
    assert (s.id, s.model, s.turn_count, s.has_error, s.has_subagent, s.project_path, s.input_tokens) == ("s", "m", 4, True, True, "/w", 3)


def test_codex(spark):
    def event(**payload):
        return {"type": "event_msg", "payload": payload}

    def item(**payload):
        return {"type": "response_item", "timestamp": "2026-01-01T00:00:00Z", "payload": payload}

    def usage(i, c, o):
        return event(type="token_count", info={"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}})

    entries = [
        {"type": "session_meta", "payload": {"id": "s1", "cwd": "/w"}}, {"type": "session_meta", "payload": {"id": "s2"}}, usage(10, 4, 1),
        item(type="function_call", name="early", call_id="x", arguments="{}"), item(type="message", role="developer", content=[]),
        item(type="message", role="user", content=[{"type": "input_text", "text": "hi"}]),
        item(type="message", role="assistant", content=[{"type": "output_text", "text": "a"}, {"type": "output_text", "text": "b"}]), usage(30, 10, 3), usage(5, 9, 1),
        item(type="custom_tool_call", name="exec", call_id="y", input="run()"), item(type="function_call_output", call_id="y", output="1"), item(type="function_call_output", call_id="y", output="2"),
    ]
    lines = rows(spark, entries)
    got = [(r.id, r.content, r.input_tokens, r.cache_read_tokens, r.output_tokens) for r in tr.codex_turns(lines).orderBy("ordinal").collect()]
    assert got == [("s1-turn-1", "hi", 0, 0, 0), ("s1-turn-2", "a\n\nb", 6 + 14 + 5, 4 + 6 + 0, 1 + 2 + 1)]
    assert [(r.turn_id, r.tool_name, r.input_json, r.result_content) for r in tr.codex_calls(lines).collect()] == [("s1-turn-2", "exec", "run()", "2")]


def test_jeff(spark):
    entry = lambda kind, second=0, **data: {"timestamp": f"2026-03-01T10:00:{second:02d}Z", "entry_type": kind, "conversation_id": "c9", "data": data}
    ask = lambda name, key="", **params: entry("tool_request", tool_name=name, tool_id=key, params=params)
    tell = lambda text, key="": entry("tool_result", tool_id=key, output_preview=text)
    entries = [
        {"entry_type": "session_start", "data": {"model": "old"}}, entry("session_start", 1, model="new"), ask("dropped"), tell("nothing waits"), entry("user_message", 2, content="hi"),
        entry("assistant_message", 3, content="yes"), ask("a", n=1), ask("b"), ask("k", "id1"), ask("l", "id2"), tell("2nd", "id2"), tell("1"), tell("1st", "id1"), tell("again", "id1"), tell("2"), tell("nobody"),
        "not json", entry("error", 50), entry("assistant_message", 4, content="more"), ask("Read"), tell("whole file"), ask("open"),
    ]
    lines = rows(spark, entries)
    assert [(r.session_id, r.id, r.type, r.content) for r in tr.jeff_turns(lines).orderBy("ordinal").collect()] == [
        ("jeff:c9", "jeff:c9-turn-1", "user", "hi"), ("jeff:c9", "jeff:c9-turn-2", "assistant", "yes"), ("jeff:c9", "jeff:c9-turn-3", "assistant", "more"),
    ]
    got = {r.tool_name: (r.turn_id[-1], r.turn_ordinal, r.tool_use_id, r.result_content, r.result_omitted_reason) for r in tr.jeff_calls(lines).collect()}
    assert got == {
        "a": ("2", 0, "", "1", None), "b": ("2", 1, "", "2", None), "k": ("2", 2, "id1", "1st", None), "l": ("2", 3, "id2", "2nd", None),
        "Read": ("3", 0, "", None, "bulk_read"), "open": ("3", 1, "", None, None),
    }
    assert [r.input_json for r in tr.jeff_calls(lines).filter("tool_name = 'a'").collect()] == ['{"n":1}']
    head = tr.jeff_heads(lines).first()
    assert (head.id, head.model, head.has_error, head.started_at.second, head.ended_at.second) == ("jeff:c9", "new", True, 0, 50)


def test_pi(spark):
    entries = [
        {"type": "session", "id": "h", "cwd": "/w", "provider": "p", "modelId": "m", "parentSession": "old"},
        {"type": "message", "id": "1", "message": {"role": "bashExecution", "command": "ls", "output": "x", "exitCode": 2}},
        {"type": "message", "id": "2", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "t"}, {"type": "text", "text": "u"}], "stopReason": "error", "usage": {"input": 1, "cacheRead": 2}}},
        {"type": "message", "id": "3", "message": {"role": "toolResult", "toolCallId": "z", "content": "r"}},
        {"type": "model_change", "provider": "q", "modelId": "n"}, {"type": "compaction", "id": "4", "summary": "short"}, {"type": "custom_message", "id": "5", "content": "note"},
    ]
    got = [(r.id, r.type, r.content, r.model, r.forked_from) for r in tr.pi_turns(rows(spark, entries)).orderBy("ordinal").collect()]
    assert got == [
        ("1", "user", "$ ls\nx\n\n(exit 2)", "q/n", "old"), ("2", "assistant", "t\n\nu", "q/n", "old"), ("4", "system", "short", "q/n", "old"), ("5", "system", "note", "q/n", "old"),
    ]


def test_stray_files_are_not_transcripts(spark, tmp_path):
    root = tmp_path / "home"
    folder = root / "projects" / "-w-app"
    agents = folder / "01234567-89ab-cdef-0123-456789abcdef" / "subagents"
    agents.mkdir(parents=True)
    name = "01234567-89ab-cdef-0123-456789abcdef.jsonl"
    line = lambda k: json.dumps({"uuid": f"u{k}", "sessionId": "s", "type": "user", "message": {"content": f"m{k}"}})
    (folder / name).write_text(line(0) + "\r\n" + line(1) + "\n")
    for stray in (folder / "notes.jsonl", agents / "notes.jsonl", agents / name, root / "history.jsonl"):
        stray.write_text(line(9) + "\n")
    (agents / "agent-a b.jsonl").write_text(line(2) + "\n")
    found = {r.below: r.path for r in tr.listed(spark, str(root), "claude-code").collect()}
    assert {b.rsplit("/", 1)[1] for b in found} == {name, "agent-a b.jsonl"}
    assert tr.listed(spark, str(tmp_path / "nowhere"), "codex").count() == 0

    stream = stream_new(spark, str(root), "claude-code", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert stream.awaitTermination(60)
    assert sorted(r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["m0", "m1", "m2"]


def test_unknown_sources_are_left_out(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "h1", "messages": [{"role": "user", "content": "x"}]}))
    got = tr.read_sources(spark, [{"name": "mine", "type": "hex", "path": str(tmp_path)}, {"name": "no", "type": "other", "path": "/nowhere"}])
    assert [(r.source, r.content) for r in got.collect()] == [("mine", "x")]
    with pytest.raises(ValueError):
        tr.read_sources(spark, [{"name": "no", "type": "other", "path": "/nowhere"}])


def test_history_and_sidecars(spark, tmp_path):
    (tmp_path / "history.jsonl").write_text('{"display":"d","timestamp":1700000000000,"project":"/p","pastedContents":{"1":"x"}}\n{broken\n')
    got = tr.history(spark, str(tmp_path / "history.jsonl")).collect()
    assert [(r.display, r.pastedContents) for r in got] == [("d", {"1": "x"})]
    (tmp_path / "agent-1.meta.json").write_text('{"agentType":"search"}')
    assert tr.sidecars(spark, str(tmp_path)).first().agentType == "search"


def test_stored_line_on_both_sides_of_a_limit(spark, data):
    from turnlake.functions import blocks as bl
    from turnlake.plans import registry

    lines = ['{"uuid":"a","text":"é"}', '{"uuid":"b","text":"ée"}']
    kept = [r.k for r in spark.createDataFrame([(x,) for x in lines], "line string").select(bl.stored_line(F.col("line"), 24).alias("k")).collect()]
    assert kept[0] == lines[0] and json.loads(kept[1]) == {"_stripped": True, "_original_size": 25, "uuid": "b"}
    everything = registry.QUERIES["strip_raw_json_all"](spark, data).groupBy("cut").count().collect()
    assert {r.cut for r in everything} == {True, False}
    assert sum(r["count"] for r in everything) == registry.QUERIES["stripped_lines"](spark, data).count()


def test_integrity_of_a_window_and_of_all(spark):
    from turnlake.operators import integrity as it

    turns = spark.createDataFrame([("s", str(k), f"2026-01-0{k}", "{oops" if k == 1 else "{}") for k in range(1, 6)], "session_id string, id string, timestamp string, raw_json string")
    found = lambda newest: [(r.session_id, r.checked, r.invalid) for r in it.raw_json_integrity(turns, newest).collect()]
    assert found(4) == [] and found(0) == found(9) == [("s", 5, 1)]


def test_pi_calls(spark):
    call = lambda i, n: {"type": "toolCall", "id": i, "name": n, "arguments": {"path": i}}
    told = lambda i, content, bad: {"type": "message", "id": "r" + i, "message": {"role": "toolResult", "toolCallId": i, "content": content, "isError": bad}}
    entries = [
        {"type": "session", "id": "h"},
        {"type": "message", "id": "1", "message": {"role": "assistant", "content": [{"type": "text", "text": "t"}, call("a", "bash"), call("b", "Read")]}},
        told("a", "old", True), told("a", [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}], False), told("b", "whole file", False), told("nobody", "z", True),
        {"type": "message", "id": "2", "message": {"role": "assistant", "content": [call("c", "bash"), call("d", "bash")]}}, told("c", "failed", True),
    ]
    lines = rows(spark, entries)
    got = {r.tool_use_id: (r.turn_id, r.turn_ordinal, r.tool_name, json.loads(r.input_json), r.result_content, r.result_length, r.result_omitted_reason, r.is_error) for r in tr.pi_calls(lines).collect()}
    assert got == {
        "a": ("1", 0, "bash", {"path": "a"}, "x\n\ny", 4, None, False), "b": ("1", 1, "Read", {"path": "b"}, None, 10, "bulk_read", False),
        "c": ("2", 0, "bash", {"path": "c"}, "failed", 6, None, True), "d": ("2", 1, "bash", {"path": "d"}, None, None, None, None),
    }
    assert {r.id: r.has_error for r in tr.pi_turns(lines).collect()} == {"1": False, "2": True}
