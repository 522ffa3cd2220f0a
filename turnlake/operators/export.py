"""Markdown and JSON renderings of sessions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions import blocks as bl
from turnlake.operators.analytics import all_tokens, zero
from turnlake.sources.archive import Archive


def duration(seconds: Column) -> Column:
    """Whole seconds as 1h2m3s."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    part = lambda v, unit: F.concat(v.cast("bigint").cast("string"), F.lit(unit))
    return F.concat(F.when(h > 0, part(h, "h")).otherwise(""), F.when(seconds >= 60, part(m, "m")).otherwise(""), part(s, "s"))


def header(a: Archive) -> DataFrame:
    """(id, header): a session's table of facts; rows without a value are left out."""
    paths = a.projects.select(F.col("id").alias("project_id"), F.col("path").alias("project_path"))
    row = lambda label, value: F.concat(F.lit(f"| **{label}** | "), value, F.lit(" |"))
    code = lambda c: F.concat(F.lit("`"), F.nullif(c, F.lit("")), F.lit("`"))
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss 'UTC'")
    spent = (zero("input_tokens") > 0) | (zero("output_tokens") > 0)
    number = lambda c: F.when(spent, F.format_number(c, 0))
    seconds = F.unix_timestamp("ended_at") - F.unix_timestamp("started_at")
    lines = [
        F.concat(F.lit("# Conversation: "), "id"), F.lit(""), F.lit("## Metadata"), F.lit(""), F.lit("| Field | Value |"), F.lit("|-------|-------|"),
        row("Session ID", code(F.col("id"))), row("Project", code(F.col("project_path"))), row("Model", F.nullif("model", F.lit(""))),
        row("Started", time("started_at")), row("Ended", time("ended_at")), row("Duration", duration(seconds)), row("Turns", zero("turn_count").cast("string")),
        row("Input Tokens", number(zero("input_tokens"))), row("Output Tokens", number(zero("output_tokens"))), row("Total Tokens", number(all_tokens())),
        row("Source", code(F.replace("source", F.lit("|"), F.lit("\\|")))),
    ]
    return a.sessions.join(paths, "project_id", "left").select("id", F.concat_ws("\n", *lines).alias("header"))


def first_lines(text: Column, most: int) -> Column:
    """The first lines, and how many more there are."""
    parts = F.split(text, "\n")
    return F.when(F.size(parts) <= most, text).otherwise(
        F.concat(F.array_join(F.slice(parts, 1, most), "\n"), F.lit("\n... ("), (F.size(parts) - most).cast("string"), F.lit(" more lines)"))
    )


def fenced(text: Column, language: str = "") -> Column:
    """A code block whose fence is longer than any run of backticks in it."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda r: F.length(r))), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(3)))
    return F.concat(fence, F.lit(language + "\n"), text, F.lit("\n"), fence)


def call_text(name: Column, arguments: Column) -> Column:
    """A call's arguments, laid out by tool; others list them by name."""
    get = lambda key: F.get_json_object(arguments, f"$.{key}")
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
    fields = F.array_sort(F.map_entries(F.from_json(arguments, "map<string,string>")))
    listed = F.array_join(F.transform(fields, lambda e: F.concat(F.lit("- **"), e["key"], F.lit("**: "), cut(e["value"], 100))), "\n")
    body = (
        F.when(F.try_parse_json(arguments).isNull(), fenced(first_lines(arguments, 50)))
        .when(name == "Bash", F.concat_ws("\n\n", fenced(get("command"), "bash"), F.concat(F.lit("> "), F.nullif(get("description"), F.lit("")))))
        .when(name == "Read", F.concat(F.lit("Reading: `"), get("file_path"), F.lit("`")))
        .when(name == "Write", F.concat_ws("\n\n", F.concat(F.lit("Writing: `"), get("file_path"), F.lit("`")), fenced(first_lines(get("content"), 50))))
        .when(name == "Edit", F.concat_ws("\n\n", F.concat(F.lit("Editing: `"), get("file_path"), F.lit("`")), fenced(cut(get("old_string"), 200)), fenced(cut(get("new_string"), 200))))
        .when(name.isin("Glob", "Grep"), F.concat(F.lit("Pattern: `"), get("pattern"), F.lit("`")))
        .when(name == "Task", F.concat_ws("\n\n", get("description"), cut(get("prompt"), 500)))
        .otherwise(listed)
    )
    return F.concat_ws("\n\n", F.concat(F.lit("#### Tool: "), name), F.nullif(body, F.lit("")))


def result_body(raw: Column, content: Column) -> Column:
    """Text of a tool result: its block, then fields of older records, then the turn's content."""
    get = lambda p: F.nullif(F.get_json_object(raw, p), F.lit(""))
    block = F.nullif(bl.result_text(F.get_json_object(raw, "$.message.content[0].content")), F.lit(""))
    output = F.nullif(F.concat_ws("\n", get("$.data.stdout"), get("$.data.stderr")), F.lit(""))
    return F.coalesce(block, get("$.data.output"), output, get("$.data.content"), get("$.data.result"), content)


def markdown(a: Archive) -> DataFrame:
    """(session_id, markdown) of every session with turns: header, then turns in order with their calls."""
    time = F.concat(F.lit("*"), F.date_format("timestamp", "HH:mm:ss"), F.lit("*"))
    calls = a.tool_uses.groupBy("session_id", F.col("turn_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("turn_ordinal", call_text(F.col("tool_name"), F.col("input_json")).alias("text")))).alias("_c")
    )
    title = F.when(F.col("type") == "user", "### User").when(F.col("type") == "assistant", "### Assistant").otherwise(F.concat(F.lit("### "), "type"))
    body = F.when(F.col("type") == "tool_result", fenced(first_lines(F.col("content"), 100))).otherwise(F.col("content"))
    told = F.when(F.col("type") == "assistant", F.array_join(F.transform("_c", lambda c: c["text"]), "\n\n"))
    text = F.concat_ws("\n\n", F.concat(title, F.lit("\n"), time), F.nullif(body, F.lit("")), F.nullif(told, F.lit("")))
    shown = F.col("type").isin("user", "assistant") | (F.coalesce("content", F.lit("")) != "")
    turns = a.turns.join(calls, ["session_id", "id"], "left").filter(shown).select("session_id", F.struct("ordinal", text.alias("text")).alias("t"))
    whole = turns.groupBy("session_id").agg(F.array_sort(F.collect_list("t")).alias("_t"))
    heads = header(a).withColumnRenamed("id", "session_id")
    parts = F.array_join(F.transform("_t", lambda t: t["text"]), "\n\n")
    return whole.join(heads, "session_id").select("session_id", F.concat_ws("\n\n", "header", F.lit("## Conversation"), parts).alias("markdown"))


def session_refs(a: Archive) -> DataFrame:
    """(id, ref): a session and its project as JSON; unknown keys are left out."""
    p = a.projects.select(F.col("id").alias("project_id"), F.struct(F.col("path"), F.col("display_name").alias("name")).alias("project"))
    ref = F.to_json(F.struct(F.col("id"), F.col("project"), F.col("model"), F.col("source"), F.col("parent_session_id").alias("parent")))
    return a.sessions.join(p, "project_id", "left").select("id", ref.alias("ref"))


def compact_path(path: str, width: int = 40) -> str:
    """A path for a narrow column: home as ``~``, middle parts to one letter until it fits."""
    path = re.sub(r"^/(?:home|Users)/[^/]+", "~", path)
    parts = path.split("/")
    for k in range(1, len(parts) - 1):
        if len("/".join(parts)) <= width:
            break
        parts[k] = parts[k][:1]
    return "/".join(parts)
