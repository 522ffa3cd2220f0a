"""Ingest, integrity, write and export queries over transcripts made from the archive views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.functions import blocks as bl
from turnlake.functions import paths as pt
from turnlake.operators import export as ex
from turnlake.operators import integrity as it
from turnlake.operators import listing as li
from turnlake.operators import repair as rp
from turnlake.operators import writes as wr
from turnlake.plans.common import query
from turnlake.sources import sessions as ss
from turnlake.sources import transcripts as tr
from turnlake.sources.archive import Archive

TOOLS = ("Bash", "Read", "Grep", "TodoWrite", "Mystery")


def claude_lines(a: Archive) -> DataFrame:
    """claude-code lines: every third user turn is a tool result, every assistant turn has a call."""
    s, o, text = F.col("session_id"), F.col("ordinal"), F.col("content")
    name = F.element_at(F.array(*map(F.lit, TOOLS)), (o % 5 + 1).cast("int"))
    call = F.concat(F.lit("c"), s, F.lit("-"), o.cast("string"))
    arguments = F.struct(
        F.when(name == "Bash", text).alias("command"), F.when(name == "Read", F.concat(F.lit("/src/"), s)).alias("file_path"),
        F.when(name == "Grep", text).alias("pattern"), F.when(name == "TodoWrite", F.array(F.lit(1), F.lit(2))).alias("todos"),
        F.when(name == "Mystery", F.concat(F.lit("q"), s)).alias("query"),
    )
    kind = lambda t: F.lit(t).alias("type")
    result = F.to_json(F.array(F.struct(kind("tool_result"), F.concat(F.lit("c"), s, F.lit("-"), (o - 1).cast("string")).alias("tool_use_id"), text.alias("content"), F.when(o % 2 == 0, o % 4 == 0).alias("is_error"))))
    spoken = F.to_json(F.array(F.struct(kind("text"), text.alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast(arguments_type()).alias("input")), F.struct(kind("tool_use"), F.lit(None).cast("string").alias("text"), call.alias("id"), name.alias("name"), arguments.alias("input"))))
    body = F.when((F.col("type") == "user") & (o % 3 == 0), result).when(F.col("type") == "assistant", spoken).otherwise(F.to_json(F.struct(text.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(text.alias("x")))) - 6))
    head = F.to_json(F.struct(
        F.concat(F.lit("u"), s, F.lit("-"), o.cast("string")).alias("uuid"), s.alias("sessionId"), F.col("type"),
        F.when(o == 5, "soon").otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"), F.concat(F.lit("/home/u/p"), s).alias("cwd"),
    ))
    usage = F.concat(F.lit(',"usage":{"input_tokens":'), F.length(text).cast("string"), F.lit(',"output_tokens":'), o.cast("string"), F.lit(',"cache_read_input_tokens":7}'))
    message = F.concat(F.lit(',"message":{"role":"'), "type", F.lit('","model":"m'), (o % 2).cast("string"), F.lit('","content":'), body, F.when(F.col("type") == "assistant", usage).otherwise(""), F.lit("}}"))
    line = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), message)
    return a.turns.filter("content is not null").select(F.concat(F.lit("/p/"), s, F.lit(".jsonl")).alias("path"), o.alias("line_no"), line.alias("line"))


def arguments_type() -> str:
    return "struct<command:string,file_path:string,pattern:string,todos:array<int>,query:string>"


_CAP = """CASE o % 5 WHEN 0 THEN '[Tool: Bash] $ ' || CASE WHEN length(content) > 100 THEN substring(content, 1, 97) || '...' ELSE content END
 WHEN 1 THEN '[Tool: Read] /src/' || session_id
 WHEN 2 THEN '[Tool: Grep] /' || CASE WHEN length(content) > 50 THEN substring(content, 1, 47) || '...' ELSE content END || '/'
 WHEN 3 THEN '[Tool: TodoWrite] 2 items' ELSE '[Tool: Mystery] q' || session_id END"""
_CUT = "CASE WHEN length(content) > 200 THEN substring(content, 1, 197) || '...' ELSE content END"
_T = ", tt AS (SELECT *, ordinal AS o FROM turns WHERE content IS NOT NULL) "
_ID = "'u' || session_id || '-' || o"
_CLAUDE = lambda a: tr.claude_turns(claude_lines(a))

query("turn_content", _T + f"""SELECT {_ID} AS id, CASE WHEN type = 'assistant' THEN content || chr(10) || {_CAP}
  WHEN type = 'user' AND o % 3 = 0 THEN '[Tool Result: ' || {_CUT} || ']' ELSE content END AS content FROM tt""")(lambda a: _CLAUDE(a).select("id", "content"))
query("retag_tool_results", _T + f"SELECT {_ID} AS id, CASE WHEN type = 'user' AND o % 3 = 0 THEN 'tool_result' ELSE type END AS type FROM tt")(lambda a: _CLAUDE(a).select("id", "type"))
query("turn_tokens", _T + f"""SELECT {_ID} AS id, CASE WHEN type = 'assistant' THEN length(content) ELSE 0 END AS input_tokens,
  CASE WHEN type = 'assistant' THEN o ELSE 0 END AS output_tokens, CASE WHEN type = 'assistant' THEN 7 ELSE 0 END AS cache_read_tokens FROM tt""")(
    lambda a: _CLAUDE(a).select("id", "input_tokens", "output_tokens", "cache_read_tokens")
)
_CALLS = _T + """, r AS (SELECT session_id, o - 1 AS o, content AS rc, CASE WHEN o % 2 = 0 THEN o % 4 = 0 ELSE false END AS err FROM tt WHERE type = 'user' AND o % 3 = 0),
calls AS (SELECT 'c' || tt.session_id || '-' || o AS tool_use_id, ['Bash', 'Read', 'Grep', 'TodoWrite', 'Mystery'][o % 5 + 1] AS tool_name, tt.session_id, rc, err,
  rc IS NOT NULL AS has FROM tt LEFT JOIN r USING (session_id, o) WHERE type = 'assistant')
"""
query("tool_calls", _CALLS + "SELECT tool_use_id, tool_name, CASE WHEN has THEN err END AS is_error, CASE WHEN tool_name = 'Read' THEN '/src/' || session_id END AS file_path FROM calls")(
    lambda a: tr.claude_calls(_CLAUDE(a)).select("tool_use_id", "tool_name", "is_error", "file_path")
)
query("result_policy", _CALLS + """SELECT tool_use_id, CASE WHEN tool_name <> 'Read' THEN rc END AS result_content, strlen(rc) AS result_length,
  CASE WHEN has AND tool_name = 'Read' THEN 'bulk_read' END AS result_omitted_reason FROM calls""")(
    lambda a: tr.claude_calls(_CLAUDE(a)).select("tool_use_id", "result_content", F.col("result_length").cast("long").alias("result_length"), "result_omitted_reason")
)
query("session_flags", _CALLS + """, s AS (SELECT session_id, count(*) AS turn_count, min(timestamp) FILTER (o <> 5) AS started_at FROM tt GROUP BY 1)
SELECT session_id AS id, turn_count, started_at, coalesce((SELECT bool_or(err) FROM calls c WHERE c.session_id = s.session_id), false) AS has_error, '/home/u/p' || session_id AS project_path FROM s""")(
    lambda a: tr.session_rows(_CLAUDE(a), tr.claude_calls(_CLAUDE(a)), "claude-code").select("id", "turn_count", "started_at", "has_error", "project_path")
)
query("unreadable_timestamps", _T + "SELECT '/p/' || session_id || '.jsonl' AS path, count(*) AS unreadable, min('soon') AS sample FROM tt WHERE o = 5 GROUP BY 1")(
    lambda a: _CLAUDE(a).filter("timestamp is null").groupBy("path").agg(F.count(F.lit(1)).alias("unreadable"), F.min("timestamp_text").alias("sample"))
)
query("skipped_lines", _T + """SELECT '/p/' || session_id || '.jsonl' AS path, count(*) FILTER (o % 4 = 1) AS unreadable, count(*) FILTER (o % 4 = 2) AS without_id FROM tt GROUP BY 1""")(
    lambda a: tr.skipped(claude_lines(a).withColumn("line", F.when(F.col("line_no") % 4 == 1, "{cut off").when(F.col("line_no") % 4 == 2, '{"type":"progress"}').otherwise(F.col("line"))))
)
query("oversized_lines", "SELECT session_id AS path, count(*) FILTER (strlen(content) > 300) AS oversized FROM turns GROUP BY 1")(
    lambda a: tr.oversized(a.turns.select(F.col("session_id").alias("path"), F.replace("content", F.lit("\n"), F.lit(" ")).alias("value")), 300)
)
query("strip_raw_json", _T + f"SELECT {_ID} AS id, 'u' || session_id || '-' || o AS uuid, 1048576 < 2 * 600000 + length(content) * 0 AS cut FROM tt WHERE o < 2")(
    lambda a: claude_lines(a).filter("line_no < 2").withColumn("big", F.concat(F.substring("line", F.lit(1), F.length("line") - 1), F.lit(',"pad":"'), F.repeat(F.lit("ab"), F.lit(600000)), F.lit('"}')))
    .select(F.get_json_object("line", "$.uuid").alias("id"), bl.stored_line(F.col("big")).alias("k"))
    .select("id", F.get_json_object("k", "$.uuid").alias("uuid"), F.coalesce(F.get_json_object("k", "$._stripped") == "true", F.lit(False)).alias("cut"))
)
_WHOLE = f"""'{{"uuid":' || to_json({_ID}) || ',"text":' || to_json(content) || '}}'"""
query("strip_raw_json_all", _T + f"SELECT {_ID} AS id, strlen({_WHOLE}) > 300 AS cut, CASE WHEN strlen({_WHOLE}) > 300 THEN strlen({_WHOLE}) END AS size, CASE WHEN strlen({_WHOLE}) <= 300 THEN content END AS text FROM tt")(
    lambda a: a.turns.filter("content is not null")
    .select(F.to_json(F.struct(F.concat(F.lit("u"), "session_id", F.lit("-"), F.col("ordinal").cast("string")).alias("uuid"), F.col("content").alias("text"))).alias("line"))
    .select(bl.stored_line(F.col("line"), 300).alias("k"))
    .select(
        F.get_json_object("k", "$.uuid").alias("id"), F.coalesce(F.get_json_object("k", "$._stripped") == "true", F.lit(False)).alias("cut"),
        F.get_json_object("k", "$._original_size").cast("long").alias("size"), F.get_json_object("k", "$.text").alias("text"),
    )
)
query("stripped_lines", _T + f"SELECT {_ID} AS id, o % 2 = 0 AS stub FROM tt")(
    lambda a: claude_lines(a).select(
        F.get_json_object("line", "$.uuid").alias("id"), bl.is_stub(F.when(F.col("line_no") % 2 == 0, F.lit('{"_mine_stripped":true}')).otherwise(F.col("line"))).alias("stub")
    )
)
query("truncate_text", f"SELECT session_id, id, {_CUT} AS text FROM turns")(lambda a: a.turns.select("session_id", "id", bl.truncated(F.col("content"), 200).alias("text")))
query("tool_caption", _T + f"SELECT {_ID} AS id, {_CAP} AS caption FROM tt WHERE type = 'assistant'")(
    lambda a: _CLAUDE(a).filter("type = 'assistant'").select("id", F.inline(bl.blocks(F.col("message_content")))).filter("type = 'tool_use'").toDF("id", *[f"b_{c}" for c in ("type", "text", "thinking", "id", "name", "input", "tool_use_id", "content", "is_error")])
    .select("id", bl.caption(F.col("b_name"), F.col("b_input")).alias("caption"))
)
query("tool_file_path", "SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN file_path END, 'x' || id) AS path FROM tool_uses")(
    lambda a: a.tool_uses.select("id", bl.file_path(F.to_json(F.struct(F.when(F.col("id") % 3 == 0, F.col("file_path")).otherwise("").alias("file_path"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("filename")))).alias("path"))
)
query("subagent_ids", "SELECT id, 'cc:' || id || ':a7' AS composite, 'cc:' || id AS parent FROM sessions")(
    lambda a: a.sessions.select("id", pt.subagent_id(F.lit("cc"), F.concat(F.lit("/r/"), "id", F.lit("/subagents/agent-a7.jsonl"))).alias("composite")).withColumn("parent", pt.parent_session(F.col("composite")))
)
query("canonical_path", "SELECT id, CASE WHEN id % 2 = 0 THEN path ELSE path || '/.claude/worktrees/' END AS path FROM projects")(
    lambda a: a.projects.select("id", pt.canonical(F.concat("path", F.when(F.col("id") % 2 == 0, "/.claude/worktrees/w1/x").otherwise("/.claude/worktrees/"))).alias("path"))
)
query("decode_path", "SELECT id, '/a+b/' || source || ' 1' AS path FROM projects")(
    lambda a: a.projects.select("id", pt.decoded(F.concat(F.lit("-a+b-"), "source", F.lit("%201"))).alias("path"))
)
query("basename", "SELECT id, display_name AS name FROM projects")(lambda a: a.projects.select("id", pt.basename(F.concat("path", F.when(F.col("id") % 2 == 0, "/").otherwise(""))).alias("name")))
query("parse_timestamp", "SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 3 THEN NULL ELSE started_at + INTERVAL 1 SECOND - INTERVAL 1 SECOND END AS ts, CASE WHEN CAST(id AS BIGINT) % 4 <> 3 THEN strftime(started_at, '%Y-%m-%dT%H:%M:%S') || '.000000000Z' END AS text FROM sessions")(
    lambda a: a.sessions.select(
        "id",
        pt.parsed_time(
            F.when(F.col("id").cast("long") % 4 == 0, F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
            .when(F.col("id").cast("long") % 4 == 1, F.concat(F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000 UTC m=+0.5")))
            .when(F.col("id").cast("long") % 4 == 2, F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))
            .otherwise("last tuesday")
        ).alias("ts"),
    ).withColumn("text", pt.rendered_time(F.col("ts")))
)
query("timestamp_layout", "SELECT 'ended' AS name, count(*) AS filled, count(*) AS off_layout, min(strftime(ended_at, '%Y-%m-%d')) AS sample FROM sessions UNION ALL SELECT 'started', count(*), 0, NULL FROM sessions")(
    lambda a: it.timestamp_layout(a.sessions.select(pt.rendered_time(F.col("started_at")).alias("started"), F.date_format("ended_at", "yyyy-MM-dd").alias("ended")), ["started", "ended"])
)
query("raw_json_integrity", ", w AS (SELECT session_id, ordinal FROM turns ORDER BY timestamp DESC, session_id, id LIMIT 200) SELECT session_id, count(*) AS checked, count(*) FILTER (ordinal % 3 = 1) AS invalid FROM w GROUP BY 1 HAVING count(*) FILTER (ordinal % 3 = 1) > 0")(
    lambda a: it.raw_json_integrity(a.turns.withColumn("raw_json", F.when(F.col("ordinal") % 3 == 1, "{oops").otherwise('{"a": [1]}')), 200)
)
query("raw_json_integrity_all", "SELECT session_id, count(*) AS checked, count(*) FILTER (ordinal % 3 = 1) AS invalid FROM turns GROUP BY 1 HAVING count(*) FILTER (ordinal % 3 = 1) > 0")(
    lambda a: it.raw_json_integrity(a.turns.withColumn("raw_json", F.when(F.col("ordinal") % 3 == 1, "{oops").otherwise('{"a": [1]}')), 0)
)


def codex_lines(a: Archive) -> DataFrame:
    """A rollout per session: a header, and for each turn its message and a running total that restarts."""
    s, o = F.col("session_id"), F.col("ordinal")
    path = F.concat(F.lit("/c/"), s)
    total = F.when(o >= 4, (o - 3) * 40).otherwise((o + 1) * 100)
    meta = a.turns.filter("ordinal = 0").select(path.alias("path"), F.lit(0).cast("long").alias("line_no"), F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(s.alias("id"), F.lit("/w").alias("cwd")).alias("payload"))).alias("line"))
    text = F.array(F.struct(F.lit("input_text").alias("type"), F.col("content").alias("text")), F.struct(F.lit("output_text").alias("type"), F.lit("end").alias("text")))
    message = a.turns.select(path.alias("path"), (2 * o + 2).alias("line_no"), F.to_json(F.struct(F.lit("response_item").alias("type"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.struct(F.lit("message").alias("type"), F.when(F.col("type") == "system", "developer").otherwise(F.col("type")).alias("role"), text.alias("content")).alias("payload"))).alias("line"))
    usage = F.struct(total.alias("input_tokens"), F.floor(total / 4).alias("cached_input_tokens"), (o + 1).alias("output_tokens"))
    count = a.turns.select(path.alias("path"), (2 * o + 1).alias("line_no"), F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(usage.alias("total_token_usage")).alias("info")).alias("payload"))).alias("line"))
    return meta.unionByName(message).unionByName(count)


_CODEX = """, m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) AS n FROM turns WHERE type <> 'system'),
b AS (SELECT t.session_id, t.ordinal, CASE WHEN t.ordinal >= 4 THEN (t.ordinal - 3) * 40 ELSE (t.ordinal + 1) * 100 END AS tot FROM turns t),
d AS (SELECT *, tot // 4 AS cach, lag(tot, 1, 0) OVER (PARTITION BY session_id ORDER BY ordinal) AS p, lag(tot // 4, 1, 0) OVER (PARTITION BY session_id ORDER BY ordinal) AS pc FROM b),
e AS (SELECT session_id, ordinal, CASE WHEN tot < p THEN tot ELSE tot - p END AS i, CASE WHEN cach < pc THEN cach ELSE cach - pc END AS c FROM d),
g AS (SELECT e.*, coalesce((SELECT max(n) FROM m WHERE m.session_id = e.session_id AND m.type = 'assistant' AND m.ordinal < e.ordinal),
  (SELECT min(n) FROM m WHERE m.session_id = e.session_id AND m.type = 'assistant'), (SELECT max(n) FROM m WHERE m.session_id = e.session_id)) AS n FROM e),
tok AS (SELECT session_id, n, CAST(sum(i - CASE WHEN c > i THEN 0 ELSE c END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN c > i THEN 0 ELSE c END) AS BIGINT) AS cache_read_tokens,
  CAST(sum(1) AS BIGINT) AS output_tokens FROM g WHERE n IS NOT NULL GROUP BY 1, 2)
"""
query("codex_token_split", _CODEX + "SELECT '/c/' || session_id AS path, n AS turn_no, input_tokens, cache_read_tokens, output_tokens FROM tok")(lambda a: tr.codex_tokens(codex_lines(a)))
query("codex_turns", _CODEX + """SELECT session_id || '-turn-' || n AS id, n - 1 AS ordinal, type, timestamp, content || chr(10) || chr(10) || 'end' AS content,
  coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens FROM m LEFT JOIN tok USING (session_id, n)""")(
    lambda a: tr.codex_turns(codex_lines(a)).select("id", "ordinal", "type", "timestamp", "content", "input_tokens", "output_tokens")
)
_ISO = lambda: F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")


def jeff_lines(a: Archive) -> DataFrame:
    """A log per session: messages, a call after every assistant one, answered four turns later if there is an answer; even calls have no id."""
    s, o = F.col("session_id"), F.col("ordinal")
    path, conv = F.concat(F.lit("/j/sessions/"), s, F.lit(".jsonl")).alias("path"), s.alias("conversation_id")
    line = lambda kind, **data: F.to_json(F.struct(_ISO(), F.lit(kind).alias("entry_type") if isinstance(kind, str) else kind.alias("entry_type"), conv, F.struct(*[v.alias(k) for k, v in data.items()]).alias("data"))).alias("line")
    tool = F.when(o % 2 == 0, "").otherwise(F.concat(F.lit("k"), o.cast("string")))
    spoken = a.turns.filter("type <> 'system'")
    calls = spoken.filter("type = 'assistant'")
    parts = [
        a.turns.filter("ordinal = 0").select(path, F.lit(-1).cast("long").alias("line_no"), line("session_start", model=F.concat(F.lit("j"), s))),
        spoken.select(path, (3 * o).alias("line_no"), line(F.concat("type", F.lit("_message")), content=F.col("content"))),
        calls.select(path, (3 * o + 1).alias("line_no"), line("tool_request", tool_name=F.when(o % 3 == 0, "Read").otherwise("Bash"), tool_id=tool, params=F.struct(o.alias("n")))),
        calls.filter("ordinal < 6").select(path, (3 * o + 14).alias("line_no"), line("tool_result", tool_id=tool, output_preview=F.col("content"))),
        a.turns.filter("ordinal = 5").select(path, (3 * o + 2).alias("line_no"), line("error", content=F.lit("x"))),
    ]
    return reduce(DataFrame.unionByName, parts)


_JEFF = ", m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) AS n FROM turns WHERE type <> 'system')"
query("jeff_turns", _JEFF + " SELECT 'jeff:' || session_id AS session_id, 'jeff:' || session_id || '-turn-' || n AS id, CAST(n - 1 AS BIGINT) AS ordinal, type, coalesce(content, '') AS content, timestamp FROM m WHERE content IS NOT NULL")(
    lambda a: tr.jeff_turns(jeff_lines(a)).select("session_id", "id", F.col("ordinal").cast("long").alias("ordinal"), "type", "content", "timestamp")
)
query("jeff_calls", _JEFF + """ SELECT 'jeff:' || session_id || '-turn-' || n AS turn_id, CASE WHEN ordinal % 2 = 0 THEN '' ELSE 'k' || ordinal END AS tool_use_id,
  CASE WHEN ordinal % 3 = 0 THEN 'Read' ELSE 'Bash' END AS tool_name, '{"n":' || ordinal || '}' AS input_json, CASE WHEN ordinal < 6 AND ordinal % 3 <> 0 THEN content END AS result_content,
  CASE WHEN ordinal < 6 THEN CAST(strlen(content) AS BIGINT) END AS result_length, CASE WHEN ordinal < 6 AND ordinal % 3 = 0 THEN 'bulk_read' END AS result_omitted_reason FROM m WHERE type = 'assistant'""")(
    lambda a: tr.jeff_calls(jeff_lines(a)).select("turn_id", "tool_use_id", "tool_name", "input_json", "result_content", F.col("result_length").cast("long").alias("result_length"), "result_omitted_reason")
)


def hex_files(a: Archive) -> DataFrame:
    """A document per session, with its messages in order."""
    messages = F.array_sort(F.collect_list(F.struct("ordinal", F.col("type").alias("role"), "content", _ISO())))
    rows = a.turns.groupBy("session_id").agg(messages.alias("messages"), F.max("timestamp").alias("timestamp"))
    doc = F.struct(F.col("session_id").alias("id"), F.lit("t").alias("title"), F.lit("2023-12-31T00:00:00Z").alias("created_at"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"), "messages")
    return rows.select(F.concat(F.lit("/h/sessions/"), "session_id", F.lit(".json")).alias("path"), F.to_json(doc).alias("value"))


query("hex_turns", """SELECT 'hex:' || session_id AS session_id, 'hex:' || session_id || '-' || n AS id, CASE WHEN n > 0 THEN 'hex:' || session_id || '-' || (n - 1) END AS parent_id, type, content, timestamp
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) - 1 AS n FROM turns)""".replace("SELECT 'hex:'", ", x AS (SELECT 1) SELECT 'hex:'", 1))(
    lambda a: tr.hex_turns(hex_files(a)).select("session_id", "id", "parent_id", "type", "content", "timestamp")
)


def pi_lines(a: Archive) -> DataFrame:
    """A transcript per session: a header, a model change, messages, and summaries for system turns."""
    nothing = F.lit(None).cast("string")
    spoken = F.array(
        F.struct(F.lit("text").alias("type"), F.col("content").alias("text"), nothing.alias("thinking")),
        F.struct(F.lit("thinking").alias("type"), nothing.alias("text"), F.when(F.col("type") == "assistant", "hm").alias("thinking")),
    )
    message = F.struct(F.col("type").alias("role"), F.struct(F.col("ordinal").alias("input")).alias("usage"), spoken.alias("content")).alias("message")
    line = F.when(F.col("type") == "system", F.to_json(F.struct(F.lit("compaction").alias("type"), "id", _ISO(), F.col("content").alias("summary"))))
    first = a.turns.filter("ordinal = 0")
    head = F.to_json(F.struct(F.lit("session").alias("type"), F.col("session_id").alias("id"), F.lit("p").alias("provider"), F.lit("m1").alias("modelId"), F.concat(F.lit("/w/"), "session_id").alias("cwd")))
    path, at = F.col("session_id").alias("path"), lambda n: F.lit(n).cast("long").alias("line_no")
    return (
        a.turns.select(path, (F.col("ordinal") + 2).alias("line_no"), line.otherwise(F.to_json(F.struct(F.lit("message").alias("type"), "id", _ISO(), message))).alias("line"))
        .unionByName(first.select(path, at(0), head.alias("line")))
        .unionByName(first.select(path, at(1), F.lit('{"type":"model_change","provider":"p","modelId":"m9"}').alias("line")))
    )


query("pi_turns", "SELECT 'pi:' || session_id AS session_id, id, type, CASE WHEN type = 'assistant' THEN content || chr(10) || chr(10) || 'hm' ELSE content END AS content, 'p/m9' AS model, CASE WHEN type = 'assistant' THEN ordinal ELSE 0 END AS input_tokens FROM turns")(
    lambda a: tr.pi_turns(pi_lines(a)).select("session_id", "id", "type", "content", "model", "input_tokens")
)


def as_files(lines: DataFrame) -> DataFrame:
    """Numbered lines as the files that they are of."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("value"))


_SESSION = ("id", "started_at", "ended_at", "model", "cwd", "turn_count", "input_tokens", "output_tokens", "cache_read_tokens", "last_entry_uuid", "has_error")


def _sessions(name: str, kind: str, files, sql: str) -> None:
    query(name, sql)(lambda a: ss.parse(files(a), kind).sessions.select(*_SESSION))


_LONG = lambda e, name: f"CAST({e} AS BIGINT) AS {name}"
_CLAUDE_SESSIONS = _CALLS + f"""SELECT '{{prefix}}' || tt.session_id AS id, min(timestamp) FILTER (o <> 5) AS started_at, max(timestamp) FILTER (o <> 5) AS ended_at,
  'm' || (min(o) % 2) AS model, '/home/u/p' || tt.session_id AS cwd, count(*) AS turn_count, {_LONG("sum(CASE WHEN type = 'assistant' THEN length(content) ELSE 0 END)", "input_tokens")},
  {_LONG("sum(CASE WHEN type = 'assistant' THEN o ELSE 0 END)", "output_tokens")}, {_LONG("sum(CASE WHEN type = 'assistant' THEN 7 ELSE 0 END)", "cache_read_tokens")},
  arg_max({_ID.replace("session_id", "tt.session_id")}, o) AS last_entry_uuid, coalesce(bool_or(e.err), false) AS has_error
  FROM tt LEFT JOIN (SELECT session_id, bool_or(has AND err) AS err FROM calls GROUP BY 1) e ON e.session_id = tt.session_id GROUP BY tt.session_id"""
_sessions("claude_sessions", "claude-code", lambda a: as_files(claude_lines(a)), _CLAUDE_SESSIONS.replace("{prefix}", ""))
_sessions("nanoclaw_sessions", "nanoclaw", lambda a: as_files(claude_lines(a)), _CLAUDE_SESSIONS.replace("{prefix}", "nanoclaw:"))


def codex_files(a: Archive) -> DataFrame:
    """The rollouts with the model named at every third turn."""
    context = a.turns.filter("ordinal % 3 = 0").select(
        F.concat(F.lit("/c/"), "session_id").alias("path"), (10 * (2 * F.col("ordinal") + 2) + 5).alias("line_no"),
        F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct(F.concat(F.lit("x"), F.col("ordinal").cast("string")).alias("model")).alias("payload"))).alias("line"),
    )
    return as_files(codex_lines(a).withColumn("line_no", F.col("line_no") * 10).unionByName(context))


_sessions("codex_sessions", "codex", codex_files, _CODEX + f""", k AS (SELECT session_id, sum(input_tokens) AS i, sum(cache_read_tokens) AS c, sum(output_tokens) AS u FROM tok GROUP BY 1),
  c AS (SELECT session_id, count(*) AS n, arg_max(session_id || '-turn-' || n, n) AS last FROM m GROUP BY 1)
  SELECT t.session_id AS id, min(timestamp) AS started_at, max(timestamp) AS ended_at, 'x' || max(ordinal) FILTER (ordinal % 3 = 0) AS model, '/w' AS cwd, coalesce(any_value(c.n), 0) AS turn_count,
  {_LONG("coalesce(any_value(i), 0)", "input_tokens")}, {_LONG("coalesce(any_value(u), 0)", "output_tokens")}, {_LONG("coalesce(any_value(c.c), 0)", "cache_read_tokens")}, any_value(last) AS last_entry_uuid, false AS has_error
  FROM turns t LEFT JOIN k USING (session_id) LEFT JOIN c USING (session_id) GROUP BY 1""".replace("c.c)", "k.c)"))
_sessions("jeff_sessions", "jeff", lambda a: as_files(jeff_lines(a)), _JEFF + """, c AS (SELECT session_id, count(*) AS n, arg_max('jeff:' || session_id || '-turn-' || n, n) AS last FROM m GROUP BY 1)
  SELECT 'jeff:' || t.session_id AS id, min(timestamp) AS started_at, max(timestamp) AS ended_at, 'j' || t.session_id AS model, CAST(NULL AS VARCHAR) AS cwd, coalesce(any_value(c.n), 0) AS turn_count,
  CAST(0 AS BIGINT) AS input_tokens, CAST(0 AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cache_read_tokens, any_value(last) AS last_entry_uuid, bool_or(ordinal = 5) AS has_error
  FROM turns t LEFT JOIN c USING (session_id) WHERE type <> 'system' OR ordinal IN (0, 5) GROUP BY t.session_id""")
_sessions("hex_sessions", "hex", hex_files, """, x AS (SELECT 1) SELECT 'hex:' || session_id AS id, TIMESTAMP '2023-12-31 00:00:00' AS started_at, max(timestamp) AS ended_at, CAST(NULL AS VARCHAR) AS model,
  CAST(NULL AS VARCHAR) AS cwd, count(*) AS turn_count, CAST(0 AS BIGINT) AS input_tokens, CAST(0 AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cache_read_tokens,
  'hex:' || session_id || '-' || (count(*) - 1) AS last_entry_uuid, false AS has_error FROM turns GROUP BY session_id""")
_sessions("pi_sessions", "pi", lambda a: as_files(pi_lines(a)), """, x AS (SELECT 1) SELECT 'pi:' || session_id AS id, min(timestamp) AS started_at, max(timestamp) AS ended_at, 'p/m9' AS model, '/w/' || session_id AS cwd,
  count(*) AS turn_count, CAST(sum(CASE WHEN type = 'assistant' THEN ordinal ELSE 0 END) AS BIGINT) AS input_tokens, CAST(0 AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cache_read_tokens,
  arg_max(id, ordinal) AS last_entry_uuid, false AS has_error FROM turns GROUP BY session_id""")
query("nanoclaw_turns", _T + f"SELECT 'nanoclaw:' || session_id AS session_id, {_ID} AS id FROM tt")(lambda a: tr.nanoclaw_turns(claude_lines(a)).select("session_id", "id"))

_DISK = lambda a: a.sessions.filter(F.col("id").cast("long") % 7 != 0).select(F.col("source_file").alias("path"), (F.col("ended_at") + F.expr("make_interval(0,0,0,0,CAST(CAST(id AS BIGINT) % 3 AS INT),0,0)")).alias("disk_mtime"))
_ON = ", disk AS (SELECT source_file AS path, ended_at + to_hours(CAST(CAST(id AS BIGINT) % 3 AS INTEGER)) AS disk_mtime FROM sessions WHERE CAST(id AS BIGINT) % 7 <> 0)"
query("needs_sync", _ON + "SELECT path, disk_mtime FROM disk LEFT JOIN source_files USING (path) WHERE mtime IS NULL OR disk_mtime > mtime")(lambda a: it.needs_sync(_DISK(a), a.source_files))
query("sessions_without_source", _ON + "SELECT source_file, count(*) AS sessions FROM sessions WHERE source_file NOT IN (SELECT path FROM disk) GROUP BY 1")(lambda a: it.sessions_without_source(a, _DISK(a)))
_HELD = ", counted AS (SELECT s.id, s.source_file, s.source, turn_count AS claimed, coalesce(n, 0) AS held FROM sessions s LEFT JOIN (SELECT session_id, count(*) AS n FROM turns GROUP BY 1) ON s.id = session_id)"
query("turn_count_reconcile", _HELD + "SELECT id, claimed, held FROM counted WHERE claimed <> held")(it.turn_count_reconcile)
query("turn_drift", _ON + _HELD + """SELECT CASE WHEN disk_mtime IS NULL THEN 'transcript gone' WHEN mtime IS NOT NULL AND disk_mtime <= mtime THEN 'unstorable' ELSE 'unparsed' END AS cause,
  count(*) AS sessions, CAST(sum(claimed) AS BIGINT) AS claimed, CAST(sum(held) AS BIGINT) AS held FROM counted c LEFT JOIN source_files f ON f.path = c.source_file AND f.source = c.source
  LEFT JOIN disk ON disk.path = c.source_file WHERE claimed <> held GROUP BY 1""")(lambda a: it.turn_drift(a, _DISK(a)))
query("reparse_selection", _HELD + """, strayed AS (SELECT s.id FROM sessions s JOIN sessions p ON p.id = s.parent_session_id WHERE s.project_id IS DISTINCT FROM p.project_id)
SELECT f.path, f.source, c.id AS session_id, claimed <> held AS short, t.id IS NOT NULL AS strayed FROM counted c JOIN source_files f ON f.path = c.source_file AND f.source = c.source
  LEFT JOIN strayed t ON t.id = c.id WHERE claimed <> held OR t.id IS NOT NULL""")(it.reparse_selection)
query("strayed_agents", "SELECT s.id FROM sessions s JOIN sessions p ON p.id = s.parent_session_id WHERE s.project_id IS DISTINCT FROM p.project_id")(lambda a: it.strayed_agents(a.sessions))
query("cache_coverage", """SELECT count(*) AS sessions, count(*) FILTER (coalesce(cache_read_tokens, 0) > 0 OR coalesce(cache_write_tokens, 0) > 0) AS with_cache,
  count(*) FILTER ((coalesce(input_tokens, 0) > 0 OR coalesce(output_tokens, 0) > 0) AND NOT (coalesce(cache_read_tokens, 0) > 0 OR coalesce(cache_write_tokens, 0) > 0)) AS spent_without_cache,
  CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cache_read_tokens, CAST(coalesce(sum(cache_write_tokens), 0) AS BIGINT) AS cache_write_tokens FROM sessions""")(it.cache_coverage)
query("rewritten_sessions", "SELECT id, last_entry_uuid FROM sessions WHERE id IN (SELECT session_id FROM turns) AND (id, last_entry_uuid) NOT IN (SELECT (session_id, id) FROM turns)")(
    lambda a: it.rewritten_sessions(a.sessions.select("id", "last_entry_uuid"), a.turns)
)
query("orphan_calls", "SELECT id FROM tool_uses WHERE (session_id, turn_id) NOT IN (SELECT (session_id, id) FROM turns)")(lambda a: it.orphan_calls(a).select("id"))

_NEW = lambda a: a.sessions.filter(F.col("id").cast("long") % 2 == 0).withColumn("id", F.when(F.col("id").cast("long") % 6 == 0, F.concat(F.lit("n"), "id")).otherwise(F.col("id"))).withColumn("turn_count", F.col("turn_count") + 1).withColumn("model", F.lit(None).cast("string")).withColumn("source_file", F.lit("")).withColumn("ended_at", F.when(F.col("id").endswith("4"), F.col("ended_at") + F.expr("interval 1 hour")).otherwise(F.col("ended_at")))
query("session_upsert", """SELECT id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 AND CAST(id AS BIGINT) % 6 <> 0 THEN turn_count + 1 ELSE turn_count END AS turn_count, model, source_file FROM sessions
  UNION ALL SELECT 'n' || id, turn_count + 1, NULL, '' FROM sessions WHERE CAST(id AS BIGINT) % 6 = 0""")(
    lambda a: wr.session_upsert(a.sessions.drop("last_entry_uuid", "parent_session_id"), _NEW(a)).select("id", "turn_count", "model", "source_file")
)
query("project_upsert", "SELECT p.path, min(started_at) AS first_seen_at, max(started_at) AS last_activity_at, count(*) AS session_count, arg_max(s.id, CAST(s.id AS BIGINT)) AS display_name FROM sessions s JOIN projects p ON s.project_id = p.id GROUP BY 1")(
    lambda a: wr.project_upsert(
        a.sessions.select(F.col("project_id"), F.col("started_at").alias("seen_at"), F.col("id").alias("display_name"), "source", F.lit(1).alias("tokens"), F.col("id").cast("long").alias("order"))
        .join(a.projects.select(F.col("id").alias("project_id"), "path"), "project_id")
    ).select("path", "first_seen_at", "last_activity_at", "session_count", "display_name")
)
query("turn_replace", "SELECT session_id, id, content FROM turns WHERE CAST(session_id AS BIGINT) % 3 <> 0 UNION ALL SELECT session_id, id, 'new' FROM turns WHERE CAST(session_id AS BIGINT) % 3 = 0 AND ordinal < 2")(
    lambda a: wr.turn_replace(a.turns, a.turns.filter((F.col("session_id").cast("long") % 3 == 0) & (F.col("ordinal") < 2)).withColumn("content", F.lit("new"))).select("session_id", "id", "content")
)
query("tool_use_replace", """SELECT id, turn_ordinal FROM tool_uses WHERE turn_id <> 't1' UNION ALL
  SELECT id, row_number() OVER (PARTITION BY session_id, turn_id ORDER BY id DESC) - 1 FROM tool_uses WHERE turn_id = 't1'""")(
    lambda a: wr.tool_use_replace(a.tool_uses, a.tool_uses.filter("turn_id = 't1'").withColumn("position", -F.col("id"))).select("id", "turn_ordinal")
)
query("merge_pick", "SELECT CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN 'n' || id ELSE id END AS id, CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN 'insert' WHEN id LIKE '%4' THEN 'replace' ELSE 'skip' END AS action FROM sessions WHERE CAST(id AS BIGINT) % 2 = 0")(
    lambda a: wr.merge_pick(a.sessions, _NEW(a))
)
def _other(a: Archive) -> Archive:
    """An archive to merge: of four sessions one is later here, one new, one the same, one absent; calls come twice, without positions."""
    number = lambda c: F.col(c).cast("long")
    named = lambda rows, c: rows.filter(number(c) % 4 < 3).withColumn(c, F.when(number(c) % 4 == 1, F.concat(F.lit("n"), c)).otherwise(F.col(c)))
    later = F.when(~F.startswith("id", F.lit("n")) & (number("id") % 4 == 0), F.col("ended_at") + F.expr("interval 1 hour")).otherwise(F.col("ended_at"))
    calls = named(a.tool_uses.drop("turn_ordinal"), "session_id")
    return Archive(
        a.projects, named(a.sessions, "id").withColumn("ended_at", later).withColumn("turn_count", F.col("turn_count") + 1),
        named(a.turns, "session_id").withColumn("content", F.concat(F.lit("in "), "content")), calls.unionByName(calls.withColumn("id", F.col("id") + 10_000_000)), a.source_files,
    )


def _merged(a: Archive) -> Archive:
    a = a._replace(tool_uses=a.tool_uses.withColumn("tool_use_id", F.concat(F.lit("k"), F.col("id").cast("string"))).withColumn("result_length", F.length("result_content")))
    return wr.merge(a, _other(a))


_OTHER = """, pick AS (SELECT id, CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN id WHEN 1 THEN 'n' || id END AS as_id FROM sessions WHERE CAST(id AS BIGINT) % 4 < 2)"""
query("merge_archives", _OTHER + """ SELECT id, project_id, ended_at, model, source, turn_count, input_tokens, source_file, last_entry_uuid FROM sessions WHERE CAST(id AS BIGINT) % 4 <> 0
  UNION ALL SELECT as_id, project_id, CASE WHEN as_id = s.id THEN ended_at + INTERVAL 1 HOUR ELSE ended_at END, model, source, turn_count + 1, input_tokens, source_file, last_entry_uuid FROM sessions s JOIN pick ON s.id = pick.id""")(
    lambda a: _merged(a).sessions.select("id", "project_id", "ended_at", "model", "source", "turn_count", "input_tokens", "source_file", "last_entry_uuid")
)
query("merge_turns", _OTHER + """ SELECT session_id, id, ordinal, type, content FROM turns WHERE session_id NOT IN (SELECT as_id FROM pick)
  UNION ALL SELECT as_id, t.id, ordinal, type, 'in ' || content FROM turns t JOIN pick ON t.session_id = pick.id""")(lambda a: _merged(a).turns.select("session_id", "id", "ordinal", "type", "content"))
query("merge_calls", _OTHER + """ SELECT session_id, turn_id, tool_use_id, turn_ordinal, tool_name, result_content FROM tool_uses u, LATERAL (SELECT 'k' || u.id AS tool_use_id)
  WHERE session_id NOT IN (SELECT as_id FROM pick) AND turn_id IN (SELECT id FROM turns)
  UNION ALL SELECT as_id, turn_id, 'k' || u.id, row_number() OVER (PARTITION BY as_id, turn_id ORDER BY u.id) - 1, tool_name, result_content FROM tool_uses u JOIN pick ON u.session_id = pick.id
  WHERE turn_id IN (SELECT id FROM turns)""")(lambda a: _merged(a).tool_uses.select("session_id", "turn_id", "tool_use_id", "turn_ordinal", "tool_name", "result_content"))
query("prune_projects", "SELECT id FROM projects WHERE id IN (SELECT project_id FROM sessions WHERE source = 'P')")(lambda a: wr.prune_projects(a._replace(sessions=a.sessions.filter("source = 'P'"))).select("id"))
def _kept_lines(a: Archive) -> Archive:
    """An archive of claude-code lines whose sessions lost their cache counters; of five, one is of another source, one differs, one has a broken line, one no cache usage."""
    n = F.col("session_id").cast("long") % 5
    turns = tr.claude_turns(claude_lines(a))
    counted = turns.groupBy("session_id").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    sessions = counted.select(
        F.col("session_id").alias("id"), F.when(n == 0, "other").otherwise("mine").alias("source"), (F.col("i") + F.when(n == 1, 1).otherwise(0)).alias("input_tokens"),
        F.col("o").alias("output_tokens"), F.lit(0).cast("long").alias("cache_read_tokens"), F.lit(None).cast("long").alias("cache_write_tokens"),
    )
    raw = F.when((n == 2) & (F.col("ordinal") == 0), "{broken").when(n == 3, F.replace("raw_json", F.lit('"cache_read_input_tokens":7'), F.lit('"cache_read_input_tokens":0'))).otherwise(F.col("raw_json"))
    return a._replace(sessions=sessions, turns=turns.withColumn("raw_json", raw))


_KEPT = _T + """, k AS (SELECT session_id AS id, CAST(session_id AS BIGINT) % 5 AS n, count(*) FILTER (type = 'assistant') AS spoken,
    sum(CASE WHEN type = 'assistant' THEN length(content) ELSE 0 END) AS i, sum(CASE WHEN type = 'assistant' THEN o ELSE 0 END) AS u FROM tt GROUP BY 1),
r AS (SELECT *, CASE WHEN n = 0 THEN 'unsupported' WHEN n = 2 THEN 'failed' WHEN n = 1 THEN 'mismatch' WHEN n = 3 OR spoken = 0 THEN 'no cache usage' ELSE 'repaired' END AS outcome FROM k)
"""
query("backfill_outcome", _KEPT + "SELECT id, outcome FROM r")(lambda a: rp.backfill(_kept_lines(a), {"mine": "claude-code", "other": "jeff"})[0].select("id", "outcome"))
query("apply_backfill", _KEPT + """SELECT id, CAST(i + CASE WHEN n = 1 THEN 1 ELSE 0 END AS BIGINT) AS input_tokens, CAST(CASE WHEN outcome = 'repaired' THEN 7 * spoken ELSE 0 END AS BIGINT) AS cache_read_tokens,
    CASE WHEN outcome = 'repaired' THEN CAST(0 AS BIGINT) END AS cache_write_tokens FROM r""")(
    lambda a: rp.backfill(_kept_lines(a), {"mine": "claude-code", "other": "jeff"})[1].select("id", "input_tokens", "cache_read_tokens", "cache_write_tokens")
)
query("backfill_tokens", """SELECT id, CASE WHEN source NOT IN ('O', 'F') THEN 'unsupported' WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'unreadable' WHEN CAST(id AS BIGINT) % 5 = 1 THEN 'failed'
  WHEN CAST(id AS BIGINT) % 5 = 2 THEN 'mismatch' WHEN CAST(id AS BIGINT) % 5 = 3 THEN 'no cache usage' ELSE 'repaired' END AS outcome
  FROM sessions WHERE coalesce(cache_read_tokens, 0) = 0 AND coalesce(cache_write_tokens, 0) = 0""")(
    lambda a: wr.backfill_outcomes(
        a,
        a.sessions.withColumn("k", F.col("id").cast("long") % 5).filter("k <> 0").select(
            F.col("id").alias("session_id"), (F.coalesce("input_tokens", F.lit(0)) + F.when(F.col("k") == 2, 1).otherwise(0)).alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"),
            F.when(F.col("k") == 4, 9).otherwise(0).alias("cache_read_tokens"), F.lit(0).alias("cache_write_tokens"), F.when(F.col("k") == 1, 1).otherwise(0).alias("failed_lines"),
        ),
        ("O", "F"),
    ).select("id", "outcome")
)

query("export_header", """SELECT s.id, '# Conversation: ' || s.id || chr(10) || chr(10) || '## Metadata' || chr(10) || chr(10) || '| Field | Value |' || chr(10) || '|-------|-------|' || chr(10)
  || '| **Session ID** | `' || s.id || '` |' || chr(10) || '| **Project** | `' || p.path || '` |' || chr(10) || '| **Model** | ' || model || ' |' || chr(10)
  || '| **Started** | ' || strftime(started_at, '%Y-%m-%d %H:%M:%S UTC') || ' |' || chr(10) || '| **Ended** | ' || strftime(ended_at, '%Y-%m-%d %H:%M:%S UTC') || ' |' || chr(10)
  || '| **Duration** | ' || turn_count || 'h0m0s |' || chr(10) || '| **Turns** | ' || turn_count || ' |' || chr(10) || '| **Input Tokens** | ' || format('{:,}', input_tokens) || ' |' || chr(10)
  || '| **Output Tokens** | ' || format('{:,}', output_tokens) || ' |' || chr(10) || '| **Total Tokens** | ' || format('{:,}', input_tokens + output_tokens + coalesce(cache_read_tokens, 0) + coalesce(cache_write_tokens, 0)) || ' |' || chr(10)
  || '| **Source** | `' || s.source || '` |' AS header FROM sessions s JOIN projects p ON s.project_id = p.id WHERE turn_count > 0""")(lambda a: ex.header(a._replace(sessions=a.sessions.filter("turn_count > 0"))))
query("export_markdown")(ex.markdown)
query("tool_result_body", "SELECT session_id, id, CASE ordinal % 4 WHEN 0 THEN 'blk' WHEN 1 THEN 'out' || chr(10) || 'err' WHEN 2 THEN 'res' ELSE content END AS body FROM turns")(
    lambda a: a.turns.select(
        "session_id", "id",
        ex.result_body(
            F.when(F.col("ordinal") % 4 == 0, '{"message":{"content":[{"type":"tool_result","content":"blk"}]}}').when(F.col("ordinal") % 4 == 1, '{"data":{"stdout":"out","stderr":"err"}}')
            .when(F.col("ordinal") % 4 == 2, '{"data":{"output":"","result":"res"}}').otherwise("{}"),
            F.col("content"),
        ).alias("body"),
    )
)
query("session_refs", "SELECT s.id, json_extract_string(to_json({'n': p.path}), '$.n') AS path, parent_session_id AS parent FROM sessions s LEFT JOIN projects p ON s.project_id = p.id")(
    lambda a: ex.session_refs(a).select("id", F.get_json_object("ref", "$.project.path").alias("path"), F.get_json_object("ref", "$.parent").alias("parent"))
)
query("resume_turns", "SELECT session_id, id FROM turns WHERE session_id = '7' AND ordinal > 2")(lambda a: li.turn_page(a, "7", after=2).select("session_id", "id"))
