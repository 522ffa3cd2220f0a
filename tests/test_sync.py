"""An archive kept up with folders of transcripts: changed, grown, moved and removed files, and lost runs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from turnlake.functions.query_string import parse
from turnlake.operators import search
from turnlake.streaming.sync import SyncedArchive

PARENT, OTHER = "01234567-89ab-cdef-0123-456789abcdef", "11111111-89ab-cdef-0123-456789abcdef"
CLOCK = [1_760_000_000]


def put(path, lines):
    """Write a transcript, later than all before."""
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    CLOCK[0] += 60
    os.utime(path, (CLOCK[0], CLOCK[0]))


def said(session, k, text, kind="user", cwd="/w/app", **message):
    content = message.pop("content", text)
    return {"uuid": f"{session}-u{k}", "sessionId": session, "type": kind, "timestamp": f"2026-0{1 + k % 3}-01T00:00:{k:02d}Z", "cwd": cwd, "message": {"role": kind, "content": content, **message}}


def called(session, k, name, key):
    usage = {"input_tokens": 5, "output_tokens": 2}
    return said(session, k, "", "assistant", content=[{"type": "text", "text": "on it"}, {"type": "tool_use", "id": key, "name": name, "input": {"command": "make deploy"}}], usage=usage, model="m1")


def answered(session, k, key, text, bad=False):
    return said(session, k, "", content=[{"type": "tool_result", "tool_use_id": key, "content": text, "is_error": bad}])


@pytest.fixture
def home(tmp_path):
    claude, jeff = tmp_path / "claude", tmp_path / "jeff"
    folder = claude / "projects" / "-w-app"
    put(folder / f"{PARENT}.jsonl", [said(PARENT, 0, "start"), called(PARENT, 1, "Bash", "c1"), answered(PARENT, 2, "c1", "it failed", True)])
    put(folder / PARENT / "subagents" / "agent-a1.jsonl", [said(PARENT, 0, "from an agent", cwd="/elsewhere")])
    put(folder / f"{OTHER}.jsonl", [said(OTHER, 0, "other words", cwd="/w/second")])
    put(folder / "notes.jsonl", [said("stray", 0, "stray words")])
    put(jeff / "sessions" / "one.jsonl", [{"entry_type": "session_start", "conversation_id": "c", "data": {"model": "j1"}}, {"entry_type": "user_message", "conversation_id": "c", "data": {"content": "jeff says"}}])
    put(jeff / "sessions" / "empty.jsonl", ["broken"])
    return tmp_path, [{"name": "mine", "type": "claude-code", "path": str(claude)}, {"name": "jeff", "type": "jeff", "path": str(jeff)}, {"name": "no", "type": "unknown", "path": "/nowhere"}]


def state(a):
    sessions = {r.id: (r.project_path, r.source, r.turn_count, r.model, r.has_error) for r in a.sessions.collect()}
    turns = sorted((r.session_id, r.ordinal, r.content) for r in a.turns.collect())
    return sessions, turns


def test_all_tables_follow_the_files(spark, home, tmp_path_factory):
    root, sources = home
    folder = root / "claude" / "projects" / "-w-app"
    lake = SyncedArchive(spark, str(tmp_path_factory.mktemp("synced")))
    assert lake.sync(sources) == 4
    a = lake.archive()
    sessions, turns = state(a)
    agent = f"claude-code:{PARENT}:a1"
    assert sessions == {
        PARENT: ("/w/app", "mine", 3, "m1", True), agent: ("/w/app", "mine", 1, None, False), OTHER: ("/w/second", "mine", 1, None, False),
        "jeff:c": (f"jeff:{root / 'jeff'}", "jeff", 1, "j1", False),
    }
    assert [t[2] for t in turns if t[0] == PARENT] == ["start", "on it\n[Tool: Bash] $ make deploy", "[Tool Result: it failed]"]
    assert not any("stray" in t[2] for t in turns)
    (call,) = a.tool_uses.collect()
    assert (call.session_id, call.turn_id, call.tool_name, call.result_content, call.is_error, call.turn_ordinal) == (PARENT, f"{PARENT}-u1", "Bash", "it failed", True, 0)
    assert {r.path: (r.session_count, r.total_tokens) for r in a.projects.collect()} == {"/w/app": (2, 7), "/w/second": (1, 0), f"jeff:{root / 'jeff'}": (1, 0)}
    assert a.source_files.count() == 5  # the file without a session is not read again either
    assert {r.session_id: r.parent_session_id for r in a.sessions.select(F.col("id").alias("session_id"), "parent_session_id").collect()}[agent] == f"claude-code:{PARENT}"
    assert lake.sync(sources) == 0

    # the index follows; a grown, a changed and a removed file
    lake.build_index()
    put(folder / f"{PARENT}.jsonl", [said(PARENT, 0, "start"), called(PARENT, 1, "Bash", "c1"), answered(PARENT, 2, "c1", "it failed", True), said(PARENT, 3, "grown")])
    put(root / "jeff" / "sessions" / "one.jsonl", [{"entry_type": "user_message", "conversation_id": "c", "data": {"content": "rewritten"}}])
    (folder / f"{OTHER}.jsonl").unlink()
    assert lake.sync(sources) == 2
    again = SyncedArchive(spark, lake.folder)
    a = again.archive()
    sessions, turns = state(a)
    assert sessions[PARENT][2] == 4 and sessions["jeff:c"][3] == "j1"  # a model once known stays
    assert [t[2] for t in turns if t[0] == "jeff:c"] == ["rewritten"] and [t[2] for t in turns if t[0] == OTHER] == ["other words"]
    assert a.tool_uses.count() == 1 and a.sessions.count() == 4
    index = lake.build_index().__class__(spark, f"{lake.folder}/text_index")
    assert {r.session_id for r in search.matching(a, parse("grown OR rewritten OR other"), index).select("session_id").collect()} == {PARENT, "jeff:c", OTHER}


def test_index_and_bookkeeping_follow(spark, home, tmp_path_factory):
    root, sources = home
    folder = root / "claude" / "projects" / "-w-app"
    lake = SyncedArchive(spark, str(tmp_path_factory.mktemp("synced")))
    lake.sync(sources)
    index = lake.build_index()
    # a transcript that moved keeps its session and leaves its former path
    (folder / f"{OTHER}.jsonl").unlink()
    moved = root / "claude" / "projects" / "-w-new" / f"{OTHER}.jsonl"
    put(moved, [said(OTHER, 0, "other words", cwd="/w/new"), said(OTHER, 1, "moved words", cwd="/w/new")])
    assert lake.sync(sources) == 1
    a = lake.archive()
    assert [r.path.rsplit("/", 2)[1] for r in a.source_files.collect() if OTHER in r.path] == ["-w-new"]
    assert {r.id: r.project_path for r in a.sessions.collect()}[OTHER] == "/w/new"
    assert "/w/second" not in {r.path for r in a.projects.collect()}
    assert index.__class__(spark, f"{lake.folder}/text_index").strict(a).isEmpty()
    assert all(r.n_missing == r.n_orphans == 0 for r in index.__class__(spark, f"{lake.folder}/text_index").integrity(a).collect())
    # a run that is lost before its last file changes nothing, for readers and for the next run
    before = state(a)
    put(moved, [said(OTHER, 0, "lost", cwd="/w/new")])
    write = lake.spark.createDataFrame

    def lost(*args, **kwargs):
        if "generation int" in str(args[1:]):
            raise RuntimeError("lost")
        return write(*args, **kwargs)

    lake.spark.createDataFrame = lost
    try:
        with pytest.raises(RuntimeError, match="lost"):
            lake.sync(sources)
    finally:
        del lake.spark.createDataFrame
    assert state(SyncedArchive(spark, lake.folder).archive()) == before
    assert lake.sync(sources) == 1 and ("lost" in {t[2] for t in state(lake.archive())[1]})
    assert lake.sync(sources, everything=True) == 4


def test_agents_their_parents_and_what_is_read_again(spark, home, tmp_path_factory):
    from turnlake.operators.integrity import reparse_selection
    from turnlake.sources.generations import keys

    root, sources = home
    folder = root / "claude" / "projects" / "-w-app"
    beside, third = folder / PARENT / "subagents", "22222222-89ab-cdef-0123-456789abcdef"
    (beside / "agent-a1.meta.json").write_text('{"agentType":"search","description":"looks","toolUseId":"c1","spawnDepth":1,"more":[1]}')
    put(beside / "agent-a2.jsonl", [said(PARENT, 0, "badly described", cwd="/else")])
    (beside / "agent-a2.meta.json").write_text('{"agentType":"plan","spawnDepth":"deep"}')
    # a parent that has a folder and no turn; one that is not there
    put(folder / f"{third}.jsonl", ["broken", {"type": "mode"}, {"type": "snapshot", "cwd": "/w/third/.claude/worktrees/x"}])
    put(folder / third / "subagents" / "agent-b.jsonl", [said(third, 0, "an agent before its parent", cwd="/else")])
    put(folder / "gone" / "subagents" / "agent-c.jsonl", [said("gone", 0, "alone", cwd="/alone")])
    lake = SyncedArchive(spark, str(tmp_path_factory.mktemp("synced")))
    assert lake.sync(sources) == 7
    a = lake.archive()
    name = lambda p, x: f"claude-code:{p}:{x}"
    agents = {r.id: (r.project_path, r.agent_type, r.agent_description, r.agent_call_id, r.spawn_depth) for r in a.sessions.filter("parent_session_id is not null").collect()}
    assert agents == {
        name(PARENT, "a1"): ("/w/app", "search", "looks", "c1", 1), name(PARENT, "a2"): ("/w/app", None, None, None, None),
        name(third, "b"): ("/w/third", None, None, None, None), name("gone", "c"): ("/alone", None, None, None, None),
    }
    assert reparse_selection(a).isEmpty() and lake.sync(sources, mend=True) == 0

    # as an older run may have left it: one session short of turns, one agent elsewhere or nowhere, one whose file is gone
    before = state(a)
    short, lost = F.col("id") == OTHER, F.col("id") == "jeff:c"
    astray, nowhere = F.col("id") == name(PARENT, "a1"), F.col("id") == name(PARENT, "a2")
    worse = a.sessions.withColumn("turn_count", F.when(short | lost, F.lit(9).cast("long")).otherwise(F.col("turn_count"))).withColumn(
        "project_id", F.when(astray, F.lit(1).cast("long")).when(~nowhere, F.col("project_id"))
    ).withColumn("project_path", F.when(astray, "/else").otherwise(F.col("project_path")))
    tables = {"sessions": (worse.drop("spawn_depth"), []), "turns": (a.turns, ["month"]), "tool_uses": (a.tool_uses, []), "source_files": (a.source_files.drop("generation"), [])}
    lake._tables.write(tables, keys(a.sessions, "id").unionByName(keys(a.source_files, "path", "file")), whole=True)
    (root / "jeff" / "sessions" / "one.jsonl").unlink()
    chosen = {r.session_id: (r.short, r.strayed) for r in reparse_selection(lake.archive()).collect()}
    assert chosen == {OTHER: (True, False), "jeff:c": (True, False), name(PARENT, "a1"): (False, True), name(PARENT, "a2"): (False, True)}
    assert lake.sync(sources) == 0 and lake.sync(sources, mend=True) == 3
    sessions, turns = state(lake.archive())
    assert sessions.pop("jeff:c")[2] == 9 and before[0].pop("jeff:c") and (sessions, turns) == before
    assert lake.archive().sessions.filter(astray).first().spawn_depth == 1


def test_linked_folders_give_one_session(spark, tmp_path):
    head = {"type": "session", "id": "p1", "cwd": "/w", "provider": "p", "modelId": "m", "timestamp": "2026-01-01T00:00:00Z"}
    message = {"type": "message", "id": "1", "timestamp": "2026-01-01T00:00:05Z", "message": {"role": "user", "content": "hello"}}
    put(tmp_path / "pi" / "sessions" / "--w--" / "a.jsonl", [head, message])
    put(tmp_path / "pi" / "sessions" / "--w--" / "no header.jsonl", [message])
    (tmp_path / "pi" / "sessions" / "current").symlink_to(tmp_path / "pi" / "sessions" / "--w--")
    lake = SyncedArchive(spark, str(tmp_path / "archive"))
    lake.sync([{"name": "pi", "type": "pi", "path": str(tmp_path / "pi")}])
    a = lake.archive()
    assert [(r.id, r.model, r.project_path, r.turn_count) for r in a.sessions.collect()] == [("pi:p1", "p/m", "/w", 1)]
    assert a.turns.count() == 1
    with pytest.raises(ValueError):
        lake.sync([{"name": "no", "type": "other", "path": "/nowhere"}])


def test_backfill_from_stored_lines(spark, tmp_path):
    from turnlake.functions import blocks as bl
    from turnlake.operators import repair

    usage = {"input_tokens": 5, "output_tokens": 2, "cache_read_input_tokens": 3}
    names = [f"{k}{PARENT[1:]}" for k in range(5)]
    for k, name in enumerate(names):
        put(tmp_path / "c" / "projects" / "-w" / f"{name}.jsonl", [said(name, 0, "hi"), said(name, 1, "yo", "assistant", usage={**usage, "cache_read_input_tokens": 0} if k == 4 else usage)])
    lake = SyncedArchive(spark, str(tmp_path / "archive"))
    lake.sync([{"name": "mine", "type": "claude-code", "path": str(tmp_path / "c")}])
    a = lake.archive()
    assert {r.cache_read_tokens for r in a.sessions.collect()} == {0, 3}
    lost = a.sessions.withColumn("cache_read_tokens", F.lit(0).cast("long"))
    line = F.when((F.col("session_id") == names[1]) & (F.col("ordinal") == 0), "{oops").when((F.col("session_id") == names[2]) & (F.col("ordinal") == 1), bl.stored_line(F.col("raw_json"), 10)).otherwise(F.col("raw_json"))
    a = a._replace(sessions=lost, turns=a.turns.withColumn("raw_json", line).filter(F.col("session_id") != names[3]))
    outcomes, repaired = repair.backfill(a, {"mine": "claude-code"})
    assert {r.id: (r.outcome, r.stub_lines) for r in outcomes.collect()} == {names[0]: ("repaired", 0), names[1]: ("failed", 0), names[2]: ("mismatch", 1), names[3]: ("unreadable", 0), names[4]: ("no cache usage", 0)}
    assert {r.id: r.cache_read_tokens for r in repaired.collect() if r.cache_read_tokens} == {names[0]: 3}
    # counters that changed meanwhile are not written over, and a second run changes nothing
    from turnlake.operators.writes import apply_backfill

    assert apply_backfill(lost.withColumn("input_tokens", F.col("input_tokens") + 1), outcomes).filter("cache_read_tokens > 0").isEmpty()
    again, same = repair.backfill(a._replace(sessions=repaired), {"mine": "claude-code"})
    assert again.filter("outcome = 'repaired'").isEmpty() and sorted(map(tuple, same.collect()), key=repr) == sorted(map(tuple, repaired.collect()), key=repr)
