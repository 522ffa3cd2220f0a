"""Transcripts of every kind as turns, calls and sessions of one shape.

Each kind gives turns, calls and, where the transcript names them, heads: what
holds for the whole file. A common fold makes the session of a file: bounds,
counters and flags from its turns and calls, and whatever the head knows better.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions import paths as pt
from turnlake.sources import transcripts as tr

TURN = {
    "path": "string", "session_id": "string", "id": "string", "parent_id": "string", "ordinal": "long", "type": "string", "timestamp": "timestamp", "content": "string",
    "model": "string", "cwd": "string", "git_branch": "string", "input_tokens": "long", "output_tokens": "long", "cache_read_tokens": "long", "cache_write_tokens": "long",
    "has_error": "boolean", "raw_json": "string",
}
CALL = {
    "path": "string", "session_id": "string", "turn_id": "string", "turn_ordinal": "long", "tool_use_id": "string", "tool_name": "string", "timestamp": "timestamp",
    "input_json": "string", "input_length": "long", "file_path": "string", "result_content": "string", "result_length": "long", "result_omitted_reason": "string", "is_error": "boolean",
}
HEAD = {"path": "string", "id": "string", "cwd": "string", "git_branch": "string", "model": "string", "started_at": "timestamp", "ended_at": "timestamp", "has_error": "boolean"}
COUNTERS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


class Parsed(NamedTuple):
    turns: DataFrame
    calls: DataFrame
    sessions: DataFrame


def shaped(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns of a shape, null where a reader has none."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def _claude(found: DataFrame, turns) -> tuple[DataFrame, DataFrame, None]:
    t = turns(tr.lines(found))
    return t, tr.claude_calls(t), None


def _lined(turns, calls, heads):
    def run(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        rows = tr.lines(found)
        return turns(rows), calls(rows), heads(rows)

    return run


#: (turns, calls or None, heads or None) of files, by kind.
KINDS = {
    "claude-code": lambda f: _claude(f, tr.claude_turns),
    "nanoclaw": lambda f: _claude(f, tr.nanoclaw_turns),
    "codex": _lined(tr.codex_turns, tr.codex_calls, tr.codex_heads),
    "jeff": _lined(tr.jeff_turns, tr.jeff_calls, tr.jeff_heads),
    "pi": _lined(tr.pi_turns, tr.pi_calls, tr.pi_heads),
    "hex": lambda f: (tr.hex_turns(f), None, tr.hex_heads(f)),
}
#: Fixed value: tools whose calls start agents of their own.
AGENT_TOOLS = ("Task",)


def _first(column: str) -> Column:
    """The first value by the file's order that is not empty."""
    v = F.nullif(F.col(column), F.lit(""))
    return F.min_by(v, F.when(v.isNotNull(), F.col("ordinal")))


def fold(turns: DataFrame, calls: DataFrame, heads: DataFrame, kind: str) -> DataFrame:
    """The session of each file: id, bounds, model, branch, folder, counters, flags, last turn and parent.

    A file belongs to the session that its head names, else its first turn; a
    subagent's file to a session of its own below its parent's. Files of which
    neither is known have no session.
    """
    t = turns.groupBy("path").agg(
        _first("session_id").alias("t_id"), F.min("timestamp").alias("t_start"), F.max("timestamp").alias("t_end"), _first("model").alias("t_model"),
        _first("git_branch").alias("t_branch"), _first("cwd").alias("t_cwd"), F.count(F.lit(1)).alias("turn_count"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTERS], F.max_by("id", "ordinal").alias("last_entry_uuid"), F.bool_or(F.coalesce("has_error", F.lit(False))).alias("t_error"),
    )
    c = calls.groupBy("path").agg(F.bool_or(F.coalesce("is_error", F.lit(False))).alias("c_error"), F.bool_or(F.col("tool_name").isin(*AGENT_TOOLS)).alias("c_agent"))
    known = t.join(heads.withColumnRenamed("has_error", "h_error"), "path", "full").join(c, "path", "left")
    agent = pt.subagent_id(F.lit(kind), F.col("path"))
    either = lambda *names: reduce_or([F.coalesce(n, F.lit(False)) for n in names])
    return known.select(
        F.coalesce(agent, F.nullif("id", F.lit("")), "t_id").alias("id"), "path",
        F.coalesce("started_at", "t_start").alias("started_at"), F.coalesce("ended_at", "t_end").alias("ended_at"),
        F.coalesce("model", "t_model").alias("model"), F.coalesce("git_branch", "t_branch").alias("git_branch"),
        pt.canonical(F.coalesce(F.nullif("cwd", F.lit("")), "t_cwd")).alias("cwd"), F.coalesce("turn_count", F.lit(0)).cast("long").alias("turn_count"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS], "last_entry_uuid",
        either("h_error", "t_error", "c_error").alias("has_error"), either("c_agent").alias("has_subagent"),
        F.when(agent.isNotNull(), pt.parent_session(agent)).alias("parent_session_id"),
    ).filter("id is not null")


def reduce_or(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def parse(found: DataFrame, kind: str) -> Parsed:
    """Turns, calls and sessions of files (path, value) of a kind; turns and calls carry the session's id and their turn's time."""
    turns, calls, heads = KINDS[kind](found)
    turns = shaped(turns, TURN)
    calls = shaped(calls, CALL) if calls is not None else shaped(turns.limit(0), CALL)
    heads = shaped(heads, HEAD) if heads is not None else shaped(turns.select("path").distinct(), HEAD)
    sessions = fold(turns, calls, heads, kind)
    ids = sessions.select("path", F.col("id").alias("session_id"))
    turns = turns.drop("session_id").join(ids, "path").select(*TURN)
    times = turns.select("path", F.col("id").alias("turn_id"), F.col("timestamp").alias("_time"))
    calls = calls.drop("session_id").join(ids, "path").join(times.dropDuplicates(["path", "turn_id"]), ["path", "turn_id"])
    return Parsed(turns, calls.withColumn("timestamp", F.col("_time")).select(*CALL), sessions)
