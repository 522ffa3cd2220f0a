"""Message blocks, tool captions and the storage rules of tool results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = (
    "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,"
    "tool_use_id:string,content:string,is_error:boolean>>"
)
#: Limits of what is stored.
MAX_RESULT_BYTES, MAX_RAW_BYTES, MAX_LINE_BYTES = 128 * 1024, 1 << 20, 200 << 20
#: Marks a stub; other writers may put their name before it.
STRIPPED = "_stripped"
BULK_READERS = ("Read", "NotebookRead")


def truncated(text: Column, most: int) -> Column:
    """At most so many characters; three dots end a cut text."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def is_array(json: Column) -> Column:
    """Whether JSON text holds an array, not a string that looks like one."""
    kind = F.schema_of_variant(F.try_parse_json(json))
    return F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False))


def blocks(json: Column) -> Column:
    """Blocks of an array; null for anything else."""
    return F.when(is_array(json), F.from_json(json, BLOCKS))


def joined(parts: Column, gap: str) -> Column:
    """Non-empty parts joined."""
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), gap)


def _has_image(content: Column) -> Column:
    return F.coalesce(F.exists(blocks(content), lambda b: b["type"] == "image"), F.lit(False))


def result_text(content: Column) -> Column:
    """Text of a tool result: the string itself, or its text blocks; null if it shows an image."""
    inner = joined(F.transform(blocks(content), lambda b: F.when(b["type"] == "text", b["text"])), "\n")
    return F.when(is_array(content), F.when(~_has_image(content), inner)).otherwise(content)


def result_preview(content: Column) -> Column:
    text = result_text(content)
    return F.when(text != "", F.concat(F.lit("[Tool Result: "), truncated(text, 200), F.lit("]")))


def caption(name: Column, arguments: Column) -> Column:
    """A call in one line, with the argument that tells most."""
    get = lambda key: F.get_json_object(arguments, f"$.{key}")
    usual = F.coalesce(*[F.nullif(get(k), F.lit("")) for k in ("file_path", "path", "query", "command", "name")])
    todo = F.json_array_length(get("todos"))
    detail = (
        F.when(name == "Bash", F.concat(F.lit("$ "), truncated(get("command"), 100)))
        .when(name.isin("Read", "Edit"), get("file_path"))
        .when(name == "Write", F.concat(F.lit("-> "), get("file_path")))
        .when(name == "Glob", get("pattern"))
        .when(name == "Grep", F.concat(F.lit("/"), truncated(get("pattern"), 50), F.lit("/")))
        .when(name == "Task", get("description"))
        .when(name == "WebFetch", get("url"))
        .when(name == "WebSearch", F.concat(F.lit('"'), get("query"), F.lit('"')))
        .when(name == "TodoWrite", F.concat(todo.cast("string"), F.lit(" items")))
        .when(name == "Skill", get("skill"))
        .otherwise(truncated(usual, 60))
    )
    return F.concat(F.lit("[Tool: "), name, F.lit("]"), F.coalesce(F.concat(F.lit(" "), detail), F.lit("")))


def file_path(arguments: Column) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(arguments, f"$.{k}"), F.lit("")) for k in ("file_path", "path", "filepath", "filename")])


def result_policy(tool: Column, content: Column) -> Column:
    """(content, length, reason): what is stored of a result and why the rest is not.

    The length is always known where there is a result; null, empty or JSON
    null content is no result.
    """
    none = content.isNull() | F.trim(content).isin("", "null")
    text = result_text(content)
    length = F.octet_length(content)
    reason = (
        F.when(_has_image(content), "image")
        .when(tool.isin(*BULK_READERS), "bulk_read")
        .when(F.octet_length(F.coalesce(text, F.lit(""))) > MAX_RESULT_BYTES, "oversize")
    )
    return F.when(
        ~none,
        F.struct(F.when(reason.isNull(), text).alias("content"), length.alias("length"), reason.alias("reason")),
    )


def content_of(kind: Column, content: Column) -> Column:
    """Readable content of a user or an assistant message."""
    own = blocks(content)
    user = joined(
        F.transform(own, lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_result", result_preview(b["content"]))), "\n"
    )
    assistant = joined(
        F.transform(
            own,
            lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "thinking", b["thinking"]).when(b["type"] == "tool_use", caption(b["name"], b["input"])),
        ),
        "\n",
    )
    return F.when(is_array(content), F.when(kind == "assistant", assistant).otherwise(user)).otherwise(content)


def retagged(kind: Column, content: Column) -> Column:
    """User messages of nothing but tool results become ``tool_result``."""
    own = blocks(content)
    only = F.coalesce((F.size(own) > 0) & F.forall(own, lambda b: b["type"] == "tool_result"), F.lit(False))
    return F.when((kind == "user") & only, "tool_result").otherwise(kind)


def stored_line(line: Column, most: int = MAX_RAW_BYTES) -> Column:
    """A line as kept: long ones leave a stub with their ids and size."""
    get = lambda key: F.get_json_object(line, f"$.{key}").alias(key)
    stub = F.to_json(
        F.struct(
            F.lit(True).alias(STRIPPED), F.octet_length(line).alias("_original_size"),
            *[get(k) for k in ("uuid", "parentUuid", "sessionId", "type", "timestamp")],
        )
    )
    return F.when(F.octet_length(line) > most, stub).otherwise(line)


def is_stub(line: Column) -> Column:
    return (F.octet_length(line) <= 1024) & F.rlike(line, F.lit(rf'"\w*{STRIPPED}"'))
