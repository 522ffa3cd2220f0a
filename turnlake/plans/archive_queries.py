"""Analytics, listing and window queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.operators import analytics as an
from turnlake.operators import listing as li
from turnlake.plans.common import query

_ALL = "coalesce(input_tokens, 0) + coalesce(output_tokens, 0) + coalesce(cache_read_tokens, 0) + coalesce(cache_write_tokens, 0)"
_EXPORT = f""",
export AS (SELECT s.id, coalesce(project_id, 0) AS project_id, coalesce(p.path, '') AS project_path, started_at, ended_at, coalesce(model, '') AS model,
    CAST(coalesce(turn_count, 0) AS INTEGER) AS turn_count, coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens,
    coalesce(cache_read_tokens, 0) AS cache_read_tokens, CAST({_ALL} AS BIGINT) AS total_tokens, s.source,
    coalesce(parent_session_id, '') AS parent_session_id, coalesce(cache_write_tokens, 0) AS cache_write_tokens
    FROM sessions s LEFT JOIN projects p ON s.project_id = p.id)
"""
_TOTALS = f""",
totals AS (SELECT p.id, p.path, p.display_name, p.source, coalesce(n, 0) AS session_count, CAST(coalesce(t, 0) AS BIGINT) AS total_tokens,
    f AS first_seen_at, l AS last_activity_at FROM projects p LEFT JOIN (SELECT project_id, count(*) AS n, sum({_ALL}) AS t, min(started_at) AS f,
    max(ended_at) AS l FROM sessions GROUP BY 1) ON p.id = project_id)
"""
_E = lambda f: lambda a: f(an.session_export(a))

query("session_export", _EXPORT + "SELECT * FROM export")(an.session_export)
query("tokens_by_day", _EXPORT + """SELECT strftime(started_at, '%Y-%m-%d') AS day, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS sessions
    FROM export WHERE started_at > TIMESTAMP '1995-01-01' GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")(_E(lambda e: an.tokens_by_day(e, "1995-01-01", 30)))
query("top_projects", _EXPORT + """SELECT project_path, count(*) AS sessions, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, max(started_at) AS last_active
    FROM export GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10""")(_E(lambda e: an.top_projects(e, 10)))
query("tokens_by_model", _EXPORT + "SELECT model, count(*) AS sessions, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM export WHERE model <> '' GROUP BY 1")(_E(an.tokens_by_model))
query("tokens_by_source", _EXPORT + "SELECT coalesce(source, 'claude-code') AS source, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM export GROUP BY 1")(_E(an.tokens_by_source))
query("sessions_by_source", _EXPORT + "SELECT coalesce(source, 'claude-code') AS source, count(*) AS sessions FROM export GROUP BY 1")(_E(an.sessions_by_source))
_ROLES = _EXPORT + """, roles AS (SELECT CASE WHEN parent_session_id <> '' THEN 'subagent' ELSE 'top-level' END AS role, count(*) AS sessions,
    CAST(sum(turn_count) AS BIGINT) AS turns, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM export GROUP BY 1)
"""
query("agent_role_stats", _ROLES + "SELECT *, round(turns / sessions, 6) AS avg_turns, round(total_tokens / sessions, 6) AS avg_tokens FROM roles")(
    _E(lambda e: an.agent_role_stats(e).withColumn("avg_turns", F.round("avg_turns", 6)).withColumn("avg_tokens", F.round("avg_tokens", 6)))
)
query("role_share", _ROLES + "SELECT role, total_tokens, round(100 * total_tokens / sum(total_tokens) OVER (), 4) AS share, round(total_tokens / max(total_tokens) OVER (), 4) AS bar FROM roles")(_E(an.role_share))
query("archive_summary", _EXPORT + "SELECT count(*) AS sessions, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, min(started_at) AS first_session, max(started_at) AS last_session, count(DISTINCT model) AS models FROM export")(_E(an.archive_summary))
query("session_stats", f"SELECT count(*) AS sessions, CAST(coalesce(sum({_ALL}), 0) AS BIGINT) AS total_tokens, (SELECT count(*) FROM turns) AS turns FROM sessions")(an.session_stats)
query("io_tokens_by_model", "SELECT model, CAST(coalesce(sum(input_tokens + output_tokens), 0) AS BIGINT) AS tokens FROM sessions WHERE model <> '' GROUP BY 1")(an.io_tokens_by_model)
query("project_stats", _TOTALS + "SELECT count(*) AS projects, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens FROM totals")(an.project_stats)
query("activity_range", _TOTALS + "SELECT min(first_seen_at) AS first_seen, max(last_activity_at) AS last_activity FROM totals")(an.activity_range)
query("tool_usage", "SELECT tool_name, count(*) AS uses FROM tool_uses GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")(an.tool_usage)
query("subagent_counts", "SELECT id, coalesce(n, 0) AS subagent_count FROM sessions LEFT JOIN (SELECT parent_session_id AS p, count(*) AS n FROM sessions WHERE parent_session_id IS NOT NULL GROUP BY 1) ON id = p")(an.subagent_counts)
query("project_reconcile", _TOTALS + "SELECT id, session_count, total_tokens FROM totals")(lambda a: an.project_totals(a).select("id", "session_count", "total_tokens"))
query("turn_counts_by_type", "SELECT session_id, type, count(*) AS turns FROM turns GROUP BY 1, 2")(an.turn_counts_by_type)
query("session_summary", """, t AS (SELECT session_id, count(*) AS turns, count(*) FILTER (type = 'user') AS user_turns, count(*) FILTER (type = 'assistant') AS assistant_turns,
    arg_min(content, ordinal) FILTER (type = 'user') AS first_user, arg_max(content, ordinal) FILTER (type = 'user') AS last_user FROM turns GROUP BY 1),
c AS (SELECT session_id, count(*) AS n, count(*) FILTER (is_error) AS f FROM tool_uses GROUP BY 1)
SELECT t.*, coalesce(n, 0) AS calls, coalesce(f, 0) AS failed_calls FROM t LEFT JOIN c USING (session_id)""")(an.session_summary)
query("top_tools_per_session", """SELECT session_id, tool_name, uses, rank FROM (SELECT session_id, tool_name, count(*) AS uses,
    row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, tool_name) AS rank FROM tool_uses GROUP BY 1, 2) WHERE rank <= 3""")(lambda a: an.top_tools_per_session(a, 3))
query("session_token_totals", f"SELECT id, CAST({_ALL} AS BIGINT) AS total_tokens FROM sessions")(an.session_token_totals)
query("session_bounds", "SELECT session_id, min(timestamp) AS started_at, max(timestamp) AS ended_at, arg_min(type, ordinal) AS first_type FROM turns GROUP BY 1")(an.session_bounds)
query("ordered_concat", "SELECT session_id, string_agg(content, chr(10) ORDER BY ordinal) AS text FROM turns WHERE type = 'user' GROUP BY 1")(an.ordered_concat)
query("bool_or_flags", "SELECT session_id, coalesce(bool_or(is_error), false) AS any_error, coalesce(bool_or(NOT is_error), false) AS any_success FROM tool_uses GROUP BY 1")(an.call_flags)
query("last_synced", "SELECT source, min(mtime) AS oldest, max(mtime) AS newest, count(*) FILTER (mtime IS NULL) AS unknown FROM source_files GROUP BY 1")(an.last_synced)

query("list_projects", _TOTALS + "SELECT * FROM totals ORDER BY total_tokens DESC, path LIMIT 25")(lambda a: li.list_projects(a, "tokens", 25))
query("list_sessions", "SELECT id, project_id, started_at FROM sessions ORDER BY started_at DESC, id LIMIT 50")(lambda a: li.list_sessions(a, limit=50).select("id", "project_id", "started_at"))
query("sessions_top_level", "SELECT id FROM sessions WHERE parent_session_id IS NULL OR parent_session_id NOT IN (SELECT id FROM sessions)")(lambda a: li.top_level(a).select("id"))
query("subagents_of", "SELECT id, started_at FROM sessions WHERE parent_session_id = '9'")(lambda a: li.subagents_of(a, "9").select("id", "started_at"))
query("page_offset", "SELECT id FROM sessions ORDER BY started_at DESC, id LIMIT 20 OFFSET 40")(lambda a: li.list_sessions(a, limit=20, offset=40).select("id"))
query("turn_page", "SELECT * FROM turns WHERE session_id = '5' AND type = 'user' AND ordinal > 0 ORDER BY ordinal LIMIT 20")(lambda a: li.turn_page(a, "5", "user", 0, 20))
query("session_cursor", "SELECT session_id, max(ordinal) AS ordinal, arg_max(id, ordinal) AS id FROM turns GROUP BY 1")(li.session_cursor)
query("session_turns", ", r AS (SELECT *, CASE WHEN ordinal % 2 = 0 THEN '{\"n\": 1}' ELSE '{broken' END AS raw_json FROM turns) SELECT session_id, id, CASE WHEN json_valid(raw_json) THEN raw_json END AS raw_json FROM r")(
    lambda a: li.session_turns(a._replace(turns=a.turns.withColumn("raw_json", F.when(F.col("ordinal") % 2 == 0, '{"n": 1}').otherwise("{broken")))).select("session_id", "id", "raw_json")
)
query("calls_by_turn", "SELECT session_id, turn_id, string_agg(tool_name || ':' || coalesce(is_error, false), ',' ORDER BY turn_ordinal) AS calls FROM tool_uses WHERE turn_id IS NOT NULL GROUP BY 1, 2")(
    lambda a: li.calls_by_turn(a).select("session_id", "turn_id", F.array_join(F.transform("calls", lambda c: F.concat_ws(":", c["tool_name"], c["failed"].cast("string"))), ",").alias("calls"))
)
query("failed_calls", "SELECT id, turn_id FROM tool_uses WHERE session_id = '3' AND is_error AND turn_id IN ('t1', 't2')")(lambda a: li.failed_calls(a, "3", ["t1", "t2"]).select("id", "turn_id"))
query("tool_names_by_turn", "SELECT session_id, turn_id, string_agg(tool_name, ',' ORDER BY turn_ordinal) AS tool_names FROM tool_uses WHERE tool_name <> '' GROUP BY 1, 2")(
    lambda a: li.tool_names_by_turn(a).withColumn("tool_names", F.array_join("tool_names", ","))
)
query("project_by_path", _TOTALS + "SELECT id, path, session_count FROM totals WHERE path = (SELECT min(path) FROM projects)")(
    lambda a: an.project_totals(a).join(a.projects.agg(F.min("path").alias("path")), "path", "left_semi").select("id", "path", "session_count")
)
query("session_by_id", f"SELECT id, coalesce(cache_write_tokens, 0) AS cache_write_tokens, (SELECT count(*) FROM sessions WHERE parent_session_id = '7') AS subagent_count FROM sessions WHERE id = '7'")(
    lambda a: li.session_by_id(a, "7").select("id", "cache_write_tokens", "subagent_count")
)
query("session_by_file", "SELECT id FROM sessions WHERE source_file = '/files/12.jsonl' LIMIT 1")(lambda a: li.session_by_file(a, "/files/12.jsonl").select("id"))
query("source_mtimes", "SELECT path, mtime FROM source_files WHERE mtime IS NOT NULL AND source = 'F'")(lambda a: li.source_mtimes(a, "F").select("path", "mtime"))
query("backfill_candidates", "SELECT id, started_at FROM sessions WHERE coalesce(cache_read_tokens, 0) = 0 AND coalesce(cache_write_tokens, 0) = 0")(lambda a: li.backfill_candidates(a).select("id", "started_at"))
query("turn_ordinals", "SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, id) - 1 AS new_ordinal FROM turns")(lambda a: li.turn_ordinals(a.turns).select("session_id", "id", "new_ordinal"))
query("call_ordinals", "SELECT id, row_number() OVER (PARTITION BY session_id, turn_id ORDER BY timestamp, id) - 1 AS call_ordinal FROM tool_uses")(lambda a: li.call_ordinals(a.tool_uses).select("id", "call_ordinal"))
query("dedup_calls", "SELECT min(id) AS id, session_id, tool_name, file_path, count(*) AS copies FROM tool_uses GROUP BY session_id, tool_name, file_path")(
    lambda a: li.dedup_calls(a.tool_uses, ("session_id", "tool_name", "file_path")).select("id", "session_id", "tool_name", "file_path", "copies")
)
query("positional_join", """, b AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn_id, tool_name ORDER BY id) AS n FROM tool_uses),
d AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn_id, tool_name ORDER BY -id) AS n FROM tool_uses)
SELECT b.id AS position, -d.id AS block_position FROM b JOIN d USING (session_id, turn_id, tool_name, n)""")(
    lambda a: li.positional_join(
        a.tool_uses.select("session_id", "turn_id", "tool_name", F.col("id").alias("position")),
        a.tool_uses.select("session_id", "turn_id", "tool_name", (-F.col("id")).alias("position")),
    ).select("position", "block_position")
)
query("counter_delta", """, x AS (SELECT id, output_tokens AS v, lag(output_tokens) OVER (PARTITION BY project_id ORDER BY CAST(id AS BIGINT)) AS b FROM sessions WHERE output_tokens IS NOT NULL)
SELECT id, CASE WHEN b IS NULL OR v < b THEN v ELSE v - b END AS delta FROM x""")(
    lambda a: li.counter_delta(a.sessions.filter("output_tokens is not null").withColumn("n", F.col("id").cast("long")), "project_id", "n", "output_tokens").select("id", "delta")
)
query("last_assistant", "SELECT session_id, id, last_value(CASE WHEN type = 'assistant' THEN id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS last_assistant FROM turns")(
    lambda a: li.last_assistant(a).select("session_id", "id", "last_assistant")
)
