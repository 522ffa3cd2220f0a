"""Transcripts of several tools as rows of turns and tool calls.

Files are read whole, one row each, and split into numbered lines; everything
after that is expressions and windows by file, so that files are parsed side by
side. A reader takes lines (path, line_no, line) and gives turns in the file's
order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from turnlake.functions import blocks as bl
from turnlake.functions import paths as pt

UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_ENTRY = "uuid string, parentUuid string, sessionId string, type string, timestamp string, cwd string, gitBranch string, message string"
_MESSAGE = (
    "id string, model string, role string, content string, usage struct<input_tokens:long,output_tokens:long,"
    "cache_read_input_tokens:long,cache_creation_input_tokens:long>"
)


#: Where each tool keeps its transcripts below its folder.
PLACES = {
    "claude-code": (rf"/projects/(?:[^/]+/)*{UUID}\.jsonl$", r"/projects/.*/subagents/agent-[^/]*\.jsonl$"),
    "nanoclaw": (rf"/[^/]+/\.claude/projects/(?:[^/]+/)*{UUID}\.jsonl$", r"/[^/]+/\.claude/projects/.*/subagents/agent-[^/]*\.jsonl$"),
    "codex": (r"/sessions/.*\.jsonl$",),
    "jeff": (r"/sessions/.*\.jsonl$",),
    "pi": (r"/sessions/.*\.jsonl$",),
    "hex": (r"/sessions/[^/]+\.json$",),
}


def belongs(kind: str, below: Column) -> Column:
    """Whether a path below a tool's folder is one of its transcripts."""
    found = reduce(Column.__or__, [F.rlike(below, F.lit("^" + p)) for p in PLACES[kind]])
    if kind in ("claude-code", "nanoclaw"):
        # what lies beside agents' files is theirs alone
        found &= ~F.contains(below, F.lit("/subagents/")) | F.rlike(below, F.lit(PLACES[kind][1]))
    return found


def listed(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(path, file, mtime, below) of a tool's transcripts; no file is opened. A folder that is missing has none.

    ``path`` is how readers name a file, ``file`` how it is opened, ``below`` its place in the folder.
    """
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    except AnalysisException:
        return spark.createDataFrame([], "path string, file string, mtime timestamp, below string")
    # schemes and hosts are written in different ways; the folder's own path is not
    folder = "/" + root.partition(":")[2].strip("/") if ":" in root.split("/")[0] else "/" + root.strip("/")
    place = F.regexp_replace("path", r"^[a-z0-9+.-]+:/+", "/")
    below = F.substring(place, F.instr(place, F.lit(folder + "/")) + F.lit(len(folder)), F.length(place))
    rows = found.select(F.col("_metadata.file_path").alias("path"), F.col("path").alias("file"), F.col("modificationTime").alias("mtime"), below.alias("below"))
    return rows.filter(belongs(kind, F.col("below")))


def contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, value): the named files, one row each."""
    if not paths:
        return spark.createDataFrame([], "path string, value string")
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def files(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, mtime, value): each file below root as one row."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), "value")


def lines(found: DataFrame, most: int = bl.MAX_LINE_BYTES) -> DataFrame:
    """Numbered lines; blank ones and those over the limit are left out."""
    rows = found.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.regexp_replace("line", "\r$", ""))
    return rows.filter((F.trim("line") != "") & (F.octet_length("line") <= most))


def oversized(found: DataFrame, most: int = bl.MAX_LINE_BYTES) -> DataFrame:
    """Number of lines over the limit in each file."""
    rows = found.select("path", F.explode(F.split("value", "\n")).alias("line"))
    return rows.groupBy("path").agg(F.count_if(F.octet_length("line") > most).alias("oversized"))


def _entries(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_e", F.from_json("line", _ENTRY)).withColumn("_v", F.try_parse_json("line"))


def skipped(rows: DataFrame) -> DataFrame:
    """Per file: unreadable lines, and readable ones that are no turn."""
    e = _entries(rows)
    bad = F.col("_v").isNull()
    return e.groupBy("path").agg(
        F.count_if(bad).alias("unreadable"), F.count_if(~bad & F.coalesce(F.col("_e.uuid") == "", F.lit(True))).alias("without_id")
    )


def claude_turns(rows: DataFrame) -> DataFrame:
    """Turns of claude-code transcripts, ordinals dense by file."""
    kept = _entries(rows).filter("_v is not null and _e.uuid <> ''").withColumn("_m", F.from_json("_e.message", _MESSAGE))
    content = F.get_json_object("line", "$.message.content")
    usage = lambda name: F.when(F.col("_e.type") == "assistant", F.coalesce(F.col(f"_m.usage.{name}"), F.lit(0))).otherwise(0)
    order = Window.partitionBy("path").orderBy("line_no")
    return kept.select(
        "path", F.col("_e.sessionId").alias("session_id"), F.col("_e.uuid").alias("id"), F.col("_e.parentUuid").alias("parent_id"),
        bl.retagged(F.col("_e.type"), content).alias("type"), pt.parsed_time(F.col("_e.timestamp")).alias("timestamp"),
        F.col("_e.timestamp").alias("timestamp_text"), (F.row_number().over(order) - 1).alias("ordinal"),
        F.coalesce(bl.content_of(F.col("_e.type"), content), F.lit("")).alias("content"), bl.stored_line(F.col("line")).alias("raw_json"),
        usage("input_tokens").alias("input_tokens"), usage("output_tokens").alias("output_tokens"),
        usage("cache_read_input_tokens").alias("cache_read_tokens"), usage("cache_creation_input_tokens").alias("cache_write_tokens"),
        F.col("_m.model").alias("model"), F.col("_e.cwd").alias("cwd"), F.col("_e.gitBranch").alias("git_branch"), content.alias("message_content"),
    )


def claude_calls(turns: DataFrame) -> DataFrame:
    """Calls of assistant turns with the first result of each call id.

    A call without a result has neither length nor outcome; a result that does
    not say is no error.
    """
    own = turns.select("path", "session_id", "id", "ordinal", "type", "timestamp", F.posexplode(bl.blocks(F.col("message_content"))).alias("position", "b"))
    results = own.filter("b.type = 'tool_result'").groupBy("path", F.col("b.tool_use_id").alias("tool_use_id")).agg(
        F.min_by(F.struct("b.content", "b.is_error"), F.struct("ordinal", "position")).alias("r")
    )
    calls = own.filter("b.type = 'tool_use' and type = 'assistant'").select(
        "path", "session_id", F.col("id").alias("turn_id"), "ordinal", "timestamp", "position", F.col("b.id").alias("tool_use_id"),
        F.col("b.name").alias("tool_name"), F.col("b.input").alias("input_json"),
    )
    number = Window.partitionBy("path", "turn_id").orderBy("position")
    policy = bl.result_policy(F.col("tool_name"), F.col("r.content"))
    return calls.join(results, ["path", "tool_use_id"], "left").withColumn("_p", policy).select(
        "path", "session_id", "turn_id", "tool_use_id", "tool_name", "timestamp", "input_json",
        F.octet_length("input_json").alias("input_length"), bl.file_path(F.col("input_json")).alias("file_path"),
        F.col("_p.content").alias("result_content"),
        F.when(F.col("r").isNotNull(), F.coalesce(F.col("_p.length"), F.lit(0))).alias("result_length"),
        F.col("_p.reason").alias("result_omitted_reason"),
        F.when(F.col("r").isNotNull(), F.coalesce(F.col("r.is_error"), F.lit(False))).alias("is_error"),
        (F.row_number().over(number) - 1).alias("turn_ordinal"),
    )


def session_rows(turns: DataFrame, calls: DataFrame, source: str, task_names: tuple[str, ...] = ("Task",)) -> DataFrame:
    """One row per file: bounds, first model, branch and folder in the file's order, totals and flags."""
    first = lambda c: F.min_by(F.nullif(c, F.lit("")), F.when(F.nullif(c, F.lit("")).isNotNull(), F.col("ordinal")))
    t = turns.groupBy("path").agg(
        first(F.col("session_id")).alias("id"), F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"),
        first(F.col("model")).alias("model"), first(F.col("git_branch")).alias("git_branch"), first(F.col("cwd")).alias("cwd"),
        F.count(F.lit(1)).alias("turn_count"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")],
        F.max_by("id", "ordinal").alias("last_entry_uuid"),
    )
    c = calls.groupBy("path").agg(F.coalesce(F.bool_or("is_error"), F.lit(False)).alias("e"), F.bool_or(F.col("tool_name").isin(*task_names)).alias("s"))
    composite = pt.subagent_id(F.lit(source), F.col("path"))
    return t.join(c, "path", "left").select(
        F.coalesce(composite, F.col("id")).alias("id"), *[x for x in t.columns if x not in ("id", "path")],
        F.coalesce("e", F.lit(False)).alias("has_error"), F.coalesce("s", F.lit(False)).alias("has_subagent"), F.lit(source).alias("source"),
        F.when(composite.isNotNull(), pt.parent_session(composite)).alias("parent_session_id"), F.col("path").alias("source_file"),
        pt.canonical(F.col("cwd")).alias("project_path"),
    )


def nanoclaw_turns(rows: DataFrame) -> DataFrame:
    """claude-code lines in a folder per group; scheduled prompts are system turns."""
    t = claude_turns(rows)
    scheduled = (F.col("type") == "user") & F.startswith("content", F.lit("[SCHEDULED TASK - "))
    return t.withColumn("type", F.when(scheduled, "system").otherwise(F.col("type"))).withColumn("session_id", F.concat(F.lit("nanoclaw:"), "session_id"))


_CODEX = (
    "timestamp string, type string, payload struct<type:string,id:string,cwd:string,git:struct<branch:string>,model:string,role:string,content:array<struct<type:string,text:string>>,"
    "name:string,call_id:string,arguments:string,input:string,output:string,info:struct<total_token_usage:struct<input_tokens:long,cached_input_tokens:long,output_tokens:long>>>"
)


def _codex(rows: DataFrame) -> DataFrame:
    r = rows.withColumn("_e", F.from_json("line", _CODEX)).filter("_e is not null")
    p = F.col("_e.payload")
    message = (F.col("_e.type") == "response_item") & (p["type"] == "message") & F.coalesce(p["role"] != "developer", F.lit(True))
    whole = Window.partitionBy("path")
    upto = whole.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(message.cast("int")).over(upto)
    r = r.withColumn("turn_no", n).withColumn("is_turn", message).withColumn("_spoke", F.when(message & (p["role"] == "assistant"), F.col("turn_no")))
    return (
        r.withColumn("session_id", F.min_by(F.when(F.col("_e.type") == "session_meta", p["id"]), F.when(F.col("_e.type") == "session_meta", F.col("line_no"))).over(whole))
        .withColumn("last_spoke", F.last("_spoke", True).over(upto))
        .withColumn("first_spoke", F.min("_spoke").over(whole))
        .withColumn("last_turn", F.max("turn_no").over(whole))
    )


def codex_tokens(rows: DataFrame) -> DataFrame:
    """(path, turn_no, input, cache_read, output): growth of the running totals by turn.

    Growth before the first assistant turn belongs to it; without one the last
    turn carries it. The cached share is taken out of the input, unless it is
    larger than that.
    """
    total = "_e.payload.info.total_token_usage"
    order = Window.partitionBy("path").orderBy("line_no")
    events = _codex(rows).filter("_e.type = 'event_msg' and _e.payload.type = 'token_count'")

    def grown(name: str) -> Column:
        now = F.coalesce(F.col(f"{total}.{name}"), F.lit(0))
        before = F.lag(now, 1, 0).over(order)
        return F.when(now < before, now).otherwise(now - before)

    d = events.select(
        "path", F.coalesce("last_spoke", "first_spoke", F.nullif("last_turn", F.lit(0))).alias("turn_no"), grown("input_tokens").alias("i"),
        grown("cached_input_tokens").alias("c0"), grown("output_tokens").alias("o"),
    ).withColumn("c", F.when(F.col("c0") > F.col("i"), 0).otherwise(F.col("c0")))
    return d.filter("turn_no is not null").groupBy("path", "turn_no").agg(
        F.sum(F.col("i") - F.col("c")).alias("input_tokens"), F.sum("c").alias("cache_read_tokens"), F.sum("o").alias("output_tokens")
    )


def codex_turns(rows: DataFrame) -> DataFrame:
    """Messages as turns named by session and number, with their tokens."""
    text = bl.joined(F.transform("_e.payload.content", lambda b: F.when(b["type"].isin("input_text", "output_text"), b["text"])), "\n\n")
    turns = _codex(rows).filter("is_turn").select(
        "path", "session_id", F.concat("session_id", F.lit("-turn-"), F.col("turn_no").cast("string")).alias("id"), "turn_no",
        (F.col("turn_no") - 1).alias("ordinal"), F.col("_e.payload.role").alias("type"), pt.parsed_time(F.col("_e.timestamp")).alias("timestamp"),
        F.coalesce(text, F.lit("")).alias("content"), F.col("line").alias("raw_json"),
    )
    zero = {c: 0 for c in ("input_tokens", "cache_read_tokens", "output_tokens")}
    return turns.join(codex_tokens(rows), ["path", "turn_no"], "left").fillna(zero).drop("turn_no")


def codex_heads(rows: DataFrame) -> DataFrame:
    """Per file: id, folder and branch of the first header, the last model named, and bounds over all entries."""
    time, kind, p = pt.parsed_time(F.col("_e.timestamp")), F.col("_e.type"), F.col("_e.payload")
    first = F.min_by(F.when(kind == "session_meta", p), F.when(kind == "session_meta", F.col("line_no")))
    model = F.when(kind == "turn_context", F.nullif(p["model"], F.lit("")))
    r = rows.withColumn("_e", F.from_json("line", _CODEX)).filter("_e is not null")
    return r.groupBy("path").agg(
        first.alias("_h"), F.max_by(model, F.when(model.isNotNull(), F.col("line_no"))).alias("model"), F.min(time).alias("started_at"), F.max(time).alias("ended_at")
    ).select("path", F.col("_h.id").alias("id"), F.col("_h.cwd").alias("cwd"), F.col("_h.git.branch").alias("git_branch"), "model", "started_at", "ended_at")


def codex_calls(rows: DataFrame) -> DataFrame:
    """Calls of the latest assistant turn, with the last output of each call id; calls before any are dropped."""
    r = _codex(rows)
    outputs = r.filter(F.col("_e.payload.type").isin("function_call_output", "custom_tool_call_output")).groupBy("path", F.col("_e.payload.call_id").alias("tool_use_id")).agg(
        F.max_by("_e.payload.output", "line_no").alias("result_content")
    )
    turn = Window.partitionBy("path", "last_spoke").orderBy("line_no")
    calls = r.filter(F.col("_e.payload.type").isin("function_call", "custom_tool_call")).filter("last_spoke is not null").select(
        "path", "session_id", (F.row_number().over(turn) - 1).alias("turn_ordinal"), F.concat("session_id", F.lit("-turn-"), F.col("last_spoke").cast("string")).alias("turn_id"), F.col("_e.payload.call_id").alias("tool_use_id"),
        F.col("_e.payload.name").alias("tool_name"), F.coalesce("_e.payload.arguments", "_e.payload.input").alias("input_json"), "line_no",
    )
    return calls.join(outputs, ["path", "tool_use_id"], "left")


_JEFF = (
    "timestamp string, entry_type string, conversation_id string, data struct<content:string,model:string,tool_name:string,tool_id:string,params:string,output_preview:string>"
)


def _jeff(rows: DataFrame) -> DataFrame:
    """Entries with the number of the turn they are or follow; the first conversation named is the file's."""
    whole = Window.partitionBy("path")
    upto = whole.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("_e", F.from_json("line", _JEFF)).filter("_e.entry_type is not null")
    kind, said = F.col("_e.entry_type"), F.col("_e.data").isNotNull()
    named = F.nullif("_e.conversation_id", F.lit(""))
    r = r.withColumn("is_turn", kind.isin("user_message", "assistant_message") & said)
    r = r.withColumn("session_id", F.concat(F.lit("jeff:"), F.min_by(named, F.when(named.isNotNull(), F.col("line_no"))).over(whole)))
    r = r.withColumn("turn_no", F.sum(F.col("is_turn").cast("int")).over(upto))
    return r.withColumn("last_spoke", F.last(F.when(F.col("is_turn") & (kind == "assistant_message"), F.col("turn_no")), True).over(upto))


def _jeff_turn(number: str) -> Column:
    return F.concat("session_id", F.lit("-turn-"), F.col(number).cast("string"))


def jeff_turns(rows: DataFrame) -> DataFrame:
    """User and assistant messages as turns, named by conversation and number from 1."""
    return _jeff(rows).filter("is_turn").select(
        "path", "session_id", _jeff_turn("turn_no").alias("id"), (F.col("turn_no") - 1).alias("ordinal"),
        F.when(F.col("_e.entry_type") == "user_message", "user").otherwise("assistant").alias("type"),
        pt.parsed_time(F.col("_e.timestamp")).alias("timestamp"), F.coalesce("_e.data.content", F.lit("")).alias("content"), F.col("line").alias("raw_json"),
    )


def jeff_calls(rows: DataFrame) -> DataFrame:
    """Calls of the latest assistant turn with their results, first come, first served among those of one id.

    Calls before any assistant turn are dropped; so is a result for which no call
    of its id waits. Calls without an id wait among themselves. With a(n) calls
    and r(n) results seen, the running maximum of r - a tells how many results
    found nothing waiting.
    """
    d = F.col("_e.data")
    r = _jeff(rows).filter(F.col("_e.entry_type").isin("tool_request", "tool_result") & d.isNotNull())
    r = r.withColumn("tool_use_id", F.coalesce(d["tool_id"], F.lit(""))).withColumn("ask", F.col("_e.entry_type") == "tool_request")
    r = r.filter(~F.col("ask") | F.col("last_spoke").isNotNull())
    same = Window.partitionBy("path", "tool_use_id").orderBy("line_no")
    upto = same.rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("asked", F.sum(F.col("ask").cast("int")).over(upto)).withColumn("told", F.sum((~F.col("ask")).cast("int")).over(upto))
    r = r.withColumn("early", F.greatest(F.lit(0), F.max(F.col("told") - F.col("asked")).over(upto)))
    r = r.withColumn("took", F.col("early") == F.coalesce(F.lag("early").over(same), F.lit(0)))
    turn = Window.partitionBy("path", "last_spoke").orderBy("line_no")
    asks = r.filter("ask").select(
        "path", "session_id", _jeff_turn("last_spoke").alias("turn_id"), "line_no", "tool_use_id", F.col("asked").alias("n"),
        d["tool_name"].alias("tool_name"), d["params"].alias("input_json"), (F.row_number().over(turn) - 1).alias("turn_ordinal"),
    )
    tells = r.filter("not ask and took").select("path", "tool_use_id", (F.col("told") - F.col("early")).alias("n"), F.coalesce(d["output_preview"], F.lit("")).alias("_text"), F.lit(True).alias("_told"))
    length = F.octet_length("_text")
    reason = F.when(F.col("tool_name").isin(*bl.BULK_READERS), "bulk_read").when(length > bl.MAX_RESULT_BYTES, "oversize")
    return asks.join(tells, ["path", "tool_use_id", "n"], "left").select(
        "path", "session_id", "turn_id", "line_no", "tool_use_id", "tool_name", "input_json", F.octet_length("input_json").alias("input_length"), "turn_ordinal",
        F.when(reason.isNull(), F.col("_text")).alias("result_content"), length.alias("result_length"), F.when(F.col("_told"), reason).alias("result_omitted_reason"),
        F.lit(None).cast("boolean").alias("is_error"),
    )


def jeff_heads(rows: DataFrame) -> DataFrame:
    """Per file: id, last model named, bounds over all entries, and whether an error was logged."""
    time, kind = pt.parsed_time(F.col("_e.timestamp")), F.col("_e.entry_type")
    model = F.when(kind == "session_start", F.nullif("_e.data.model", F.lit("")))
    return _jeff(rows).groupBy("path").agg(
        F.first("session_id").alias("id"), F.max_by(model, F.when(model.isNotNull(), F.col("line_no"))).alias("model"),
        F.min(time).alias("started_at"), F.max(time).alias("ended_at"), F.bool_or(kind == "error").alias("has_error"),
    )


_HEX = "id string, title string, created_at string, updated_at string, messages array<struct<role:string,content:string,timestamp:string>>"


def _hex(found: DataFrame) -> DataFrame:
    rows = found.select("path", F.from_json("value", _HEX).alias("_d")).filter("_d.id <> ''")
    return rows.withColumn("session_id", F.concat(F.lit("hex:"), "_d.id"))


def hex_turns(found: DataFrame) -> DataFrame:
    """Messages of whole-file JSON documents, each the child of the one before."""
    name = lambda n: F.concat("session_id", F.lit("-"), n.cast("string"))
    return _hex(found).select("path", "session_id", F.posexplode("_d.messages").alias("ordinal", "m")).select(
        "path", "session_id", name(F.col("ordinal")).alias("id"), F.when(F.col("ordinal") > 0, name(F.col("ordinal") - 1)).alias("parent_id"), "ordinal",
        F.col("m.role").alias("type"), pt.parsed_time(F.col("m.timestamp")).alias("timestamp"), F.coalesce("m.content", F.lit("")).alias("content"), F.to_json("m").alias("raw_json"),
    )


def hex_heads(found: DataFrame) -> DataFrame:
    """Per file: id, title, and the bounds that the document names."""
    return _hex(found).select(
        "path", F.col("session_id").alias("id"), F.col("_d.title").alias("title"),
        pt.parsed_time(F.col("_d.created_at")).alias("started_at"), pt.parsed_time(F.col("_d.updated_at")).alias("ended_at"),
    )


_USAGE = "usage:struct<input:long,output:long,cacheRead:long,cacheWrite:long>"
_PI = (
    "type string, id string, parentId string, timestamp string, cwd string, provider string, modelId string, branchedFrom string, parentSession string, summary string, kind string, note string, content string, "
    f"usage struct<input:long,output:long,cacheRead:long,cacheWrite:long>, message struct<role:string,content:string,summary:string,command:string,output:string,cancelled:boolean,exitCode:int,stopReason:string,errorMessage:string,toolCallId:string,isError:boolean,{_USAGE}>"
)


def _pi(rows: DataFrame) -> DataFrame:
    r = rows.withColumn("_e", F.from_json("line", _PI)).filter("_e.type is not null")
    whole = Window.partitionBy("path")
    head, change = F.col("_e.type") == "session", F.col("_e.type") == "model_change"
    name = F.nullif(F.concat_ws("/", F.nullif("_e.provider", F.lit("")), F.nullif("_e.modelId", F.lit(""))), F.lit(""))
    said = F.when(head | change, name)
    return (
        r.withColumn("session_id", F.concat(F.lit("pi:"), F.min_by(F.when(head, F.col("_e.id")), F.when(head, F.col("line_no"))).over(whole)))
        .withColumn("forked_from", F.min(F.when(head, F.coalesce("_e.branchedFrom", "_e.parentSession"))).over(whole))
        .withColumn("model", F.max_by(said, F.when(said.isNotNull(), F.col("line_no"))).over(whole))
    )


def _pi_text(content: Column) -> Column:
    spoken = F.transform(bl.blocks(content), lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "thinking", b["thinking"]))
    return F.when(bl.is_array(content), bl.joined(spoken, "\n\n")).otherwise(content)


def pi_calls(rows: DataFrame) -> DataFrame:
    """Calls of assistant messages with the last result of each call id in the file.

    Matching is by id alone; a call without a result has neither length nor outcome.
    """
    m = F.col("_e.message")
    said = rows.withColumn("_e", F.from_json("line", _PI)).filter("_e.type = 'message'")
    results = said.filter((m["role"] == "toolResult") & (m["toolCallId"] != "")).groupBy("path", m["toolCallId"].alias("tool_use_id")).agg(
        F.max_by(F.struct(F.coalesce(_pi_text(m["content"]), F.lit("")).alias("text"), m["isError"].alias("is_error")), "line_no").alias("r")
    )
    listed = F.when(bl.is_array(m["content"]), F.from_json(m["content"], "array<struct<type:string,id:string,name:string,arguments:string>>"))
    calls = said.filter(m["role"] == "assistant").select("path", "line_no", F.col("_e.id").alias("turn_id"), F.posexplode(listed).alias("position", "b")).filter("b.type = 'toolCall'")
    calls = calls.select(
        "path", "line_no", "turn_id", F.col("b.id").alias("tool_use_id"), F.col("b.name").alias("tool_name"), F.col("b.arguments").alias("input_json"),
        (F.row_number().over(Window.partitionBy("path", "line_no").orderBy("position")) - 1).alias("turn_ordinal"),
    )
    length = F.octet_length("r.text")
    reason = F.when(F.col("tool_name").isin(*bl.BULK_READERS), "bulk_read").when(length > bl.MAX_RESULT_BYTES, "oversize")
    return calls.join(results, ["path", "tool_use_id"], "left").select(
        "path", "line_no", "turn_id", "tool_use_id", "tool_name", "input_json", F.octet_length("input_json").alias("input_length"), "turn_ordinal",
        F.when(reason.isNull(), F.col("r.text")).alias("result_content"), length.alias("result_length"),
        F.when(F.col("r").isNotNull(), reason).alias("result_omitted_reason"), F.col("r.is_error").alias("is_error"),
    )


def pi_heads(rows: DataFrame) -> DataFrame:
    """Per file: id and folder of the header, the last model named, and bounds over all entries."""
    time, head = pt.parsed_time(F.col("_e.timestamp")), F.col("_e.type") == "session"
    return _pi(rows).groupBy("path").agg(
        F.first("session_id").alias("id"), F.min_by(F.when(head, F.col("_e.cwd")), F.when(head, F.col("line_no"))).alias("cwd"), F.first("model").alias("model"),
        F.min(time).alias("started_at"), F.max(time).alias("ended_at"),
    )


def pi_turns(rows: DataFrame) -> DataFrame:
    """Messages, usage notes, summaries and custom messages as turns; tool results are none, but a failed one marks the calling turn."""
    m, kind = F.col("_e.message"), F.col("_e.type")
    text = _pi_text
    shell = F.concat(
        F.lit("$ "), m["command"], F.coalesce(F.concat(F.lit("\n"), F.nullif(m["output"], F.lit(""))), F.lit("")),
        F.when(F.coalesce(m["cancelled"], F.lit(False)), "\n\n(cancelled)").when(m["exitCode"] != 0, F.concat(F.lit("\n\n(exit "), m["exitCode"].cast("string"), F.lit(")"))).otherwise(""),
    )
    content = (
        F.when(kind == "message", F.when(m["role"] == "bashExecution", shell).when(m["role"].isin("branchSummary", "compactionSummary"), m["summary"]).otherwise(text(m["content"])))
        .when(kind == "usage", F.concat_ws(": ", F.nullif("_e.kind", F.lit("")), F.nullif("_e.note", F.lit(""))))
        .when(kind == "custom_message", text(F.col("_e.content")))
        .otherwise(F.col("_e.summary"))
    )
    role = F.when((kind == "message") & m["role"].isin("user", "bashExecution"), "user").when((kind == "message") & (m["role"] == "assistant"), "assistant").otherwise("system")
    spent = F.when((kind == "message") & (m["role"] == "assistant"), m["usage"]).when(kind.isin("usage", "compaction", "branch_summary"), F.col("_e.usage"))
    own = _pi(rows).filter(kind.isin("message", "usage", "compaction", "branch_summary", "custom_message")).filter((kind != "message") | F.coalesce(m["role"] != "toolResult", F.lit(True)))
    failed = pi_calls(rows).filter("is_error").select("path", "line_no", F.lit(True).alias("_failed")).distinct()
    own = own.join(failed, ["path", "line_no"], "left")
    order = Window.partitionBy("path").orderBy("line_no")
    return own.select(
        "path", "session_id", F.col("_e.id").alias("id"), F.col("_e.parentId").alias("parent_id"), (F.row_number().over(order) - 1).alias("ordinal"), role.alias("type"),
        pt.parsed_time(F.col("_e.timestamp")).alias("timestamp"), F.coalesce(content, F.lit("")).alias("content"), "model", "forked_from", F.col("line").alias("raw_json"),
        (F.coalesce(m["stopReason"] == "error", F.lit(False)) | F.coalesce(m["errorMessage"] != "", F.lit(False)) | F.coalesce("_failed", F.lit(False))).alias("has_error"),
        *[F.coalesce(spent[a], F.lit(0)).alias(b) for a, b in (("input", "input_tokens"), ("output", "output_tokens"), ("cacheRead", "cache_read_tokens"), ("cacheWrite", "cache_write_tokens"))],
    )


def history(spark: SparkSession, path: str) -> DataFrame:
    """Typed prompts with their pasted parts; malformed lines are skipped."""
    schema = "display string, pastedContents map<string,string>, timestamp long, project string, sessionId string"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("time", F.timestamp_millis("timestamp"))


def described(found: DataFrame) -> DataFrame:
    """Agent descriptions (path, value) by their transcript's path; one that is unreadable in any part is empty in all."""
    fields = "agentType string, description string, toolUseId string, spawnDepth int"
    meta = F.from_json("value", f"{fields}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = found.select(F.regexp_replace("path", r"\.meta\.json$", ".jsonl").alias("path"), meta.alias("m"))
    return rows.withColumn("m", F.when(F.col("m._bad").isNull(), F.col("m"))).select("path", "m.*").drop("_bad")


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """The descriptions of all agents below a folder."""
    return described(files(spark, root, "agent-*.meta.json"))


def listed_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(path, meta): the description files below a folder by their transcript's path, as ``listed`` names it; none is opened."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "agent-*.meta.json").load(root)
    except AnalysisException:
        return spark.createDataFrame([], "path string, meta string")
    return found.select(F.regexp_replace("_metadata.file_path", r"\.meta\.json$", ".jsonl").alias("path"), F.col("path").alias("meta"))


def parent_path(path: Column) -> Column:
    """The transcript of the session that started the agent of a file; null for other files."""
    return F.when(F.rlike(path, F.lit(r"[^/]/subagents/[^/]+\.jsonl$")), F.regexp_replace(path, r"/subagents/[^/]+$", ".jsonl"))


def parent_folder(rows: DataFrame, most: int = 200) -> DataFrame:
    """First working folder named in the first lines of each file."""
    cwd = F.nullif(F.get_json_object("line", "$.cwd"), F.lit(""))
    return rows.filter(F.col("line_no") < most).withColumn("_c", cwd).filter("_c is not null").groupBy("path").agg(F.min_by("_c", "line_no").alias("cwd"))


#: Readers by the type of a configured source; each takes the files found below its root.
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "claude-code": lambda f: claude_turns(lines(f)),
    "nanoclaw": lambda f: nanoclaw_turns(lines(f)),
    "codex": lambda f: codex_turns(lines(f)),
    "jeff": lambda f: jeff_turns(lines(f)),
    "hex": hex_turns,
    "pi": lambda f: pi_turns(lines(f)),
}


def read_sources(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Turns of all configured sources (name, type, path), tagged with the source's name.

    Sources of an unknown type are left out.
    """
    known = [s for s in sources if s["type"] in READERS]
    if not known:
        raise ValueError("no source has a known type")
    parts = [
        READERS[s["type"]](files(spark, s["path"], "*.json" if s["type"] == "hex" else "*.jsonl"))
        .select("session_id", "ordinal", "type", "timestamp", "content", F.lit(s["name"]).alias("source"))
        for s in known
    ]
    return reduce(DataFrame.unionByName, parts)
