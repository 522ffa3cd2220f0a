"""Listings, paging, point lookups and window derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnlake.operators.analytics import project_totals, subagent_counts, zero
from turnlake.sources.archive import Archive

PROJECT_ORDERS = {
    "name": [F.asc, "display_name"],
    "activity": [F.desc_nulls_last, "last_activity_at"],
    "tokens": [F.desc, "total_tokens"],
    "sessions": [F.desc, "session_count"],
}


def paged(rows: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    """Offset and limit of an ordered frame; a limit of 0 is none, negative values count as 0."""
    rows = rows.offset(offset) if offset > 0 else rows
    return rows.limit(limit) if limit > 0 else rows


def list_projects(a: Archive, order: str = "activity", limit: int = 0, offset: int = 0) -> DataFrame:
    how, column = PROJECT_ORDERS.get(order, PROJECT_ORDERS["activity"])
    return paged(project_totals(a).orderBy(how(column), "path"), limit, offset)


def top_level(a: Archive) -> DataFrame:
    """Sessions without a parent, or whose parent is not in the archive."""
    parents = a.sessions.select(F.col("id").alias("parent_session_id"))
    return a.sessions.join(parents, "parent_session_id", "left_anti").select(*a.sessions.columns)


def subagents_of(a: Archive, parent: str) -> DataFrame:
    if not parent:
        raise ValueError("a parent session is needed")
    return a.sessions.filter(F.col("parent_session_id") == parent)


def list_sessions(a: Archive, scope: str = "all", project_id: int | None = None, parent: str = "", limit: int = 0, offset: int = 0) -> DataFrame:
    rows = {"all": lambda: a.sessions, "top": lambda: top_level(a), "children": lambda: subagents_of(a, parent)}[scope]()
    if project_id is not None:
        rows = rows.filter(F.col("project_id") == project_id)
    return paged(rows.orderBy(F.desc("started_at"), "id"), limit, offset)


def turn_page(a: Archive, session: str, kind: str | None = None, after: int | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
    rows = a.turns.filter(F.col("session_id") == session)
    rows = rows.filter(F.col("type") == kind) if kind else rows
    rows = rows.filter(F.col("ordinal") > after) if after is not None else rows
    return paged(rows.orderBy("ordinal"), limit, offset)


def session_cursor(a: Archive) -> DataFrame:
    """The highest ordinal of each session and the turn that has it."""
    return a.turns.groupBy("session_id").agg(F.max("ordinal").alias("ordinal"), F.max_by("id", "ordinal").alias("id"))


def session_turns(a: Archive, raw: str = "raw_json") -> DataFrame:
    """Turns in order, with raw JSON that cannot be read set to null."""
    rows = a.turns
    if raw in rows.columns:
        rows = rows.withColumn(raw, F.when(F.expr(f"try_parse_json({raw})").isNotNull(), F.col(raw)))
    return rows.orderBy("session_id", "ordinal")


def calls_by_turn(a: Archive) -> DataFrame:
    """Calls of each turn in their order; unknown outcomes count as not failed here."""
    failed = F.coalesce("is_error", F.lit(False))
    call = F.struct("turn_ordinal", "tool_name", failed.alias("failed"))
    rows = a.tool_uses.filter("turn_id is not null").groupBy("session_id", "turn_id")
    return rows.agg(F.array_sort(F.collect_list(call)).alias("calls"))


def failed_calls(a: Archive, session: str, turns: list[str] | None = None) -> DataFrame:
    rows = a.tool_uses.filter((F.col("session_id") == session) & F.col("is_error"))
    return rows.filter(F.col("turn_id").isin(turns)) if turns is not None else rows


def tool_names_by_turn(a: Archive) -> DataFrame:
    """Names in call order, repeats kept, blanks skipped."""
    rows = a.tool_uses.filter("tool_name <> ''").groupBy("session_id", "turn_id")
    names = rows.agg(F.array_sort(F.collect_list(F.struct("turn_ordinal", "tool_name"))).alias("_n"))
    return names.select("session_id", "turn_id", F.transform("_n", lambda x: x["tool_name"]).alias("tool_names"))


def project_by_path(a: Archive, path: str) -> DataFrame:
    return project_totals(a).filter(F.col("path") == path).limit(1)


def session_by_id(a: Archive, session: str) -> DataFrame:
    one = a.sessions.filter(F.col("id") == session)
    counters = ("turn_count", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
    rest = [c for c in a.sessions.columns if c not in counters]
    return one.select(*rest, *[zero(c).alias(c) for c in counters]).join(subagent_counts(a).filter(F.col("id") == session), "id")


def session_by_file(a: Archive, path: str) -> DataFrame:
    return a.sessions.filter(F.col("source_file") == path).limit(1)


def source_mtimes(a: Archive, source: str | None = None) -> DataFrame:
    rows = a.source_files.filter("mtime is not null")
    return rows.filter(F.col("source") == source) if source else rows


def backfill_candidates(a: Archive) -> DataFrame:
    """Sessions whose two cache counters are zero, newest first."""
    none = (zero("cache_read_tokens") == 0) & (zero("cache_write_tokens") == 0)
    return a.sessions.filter(none).orderBy(F.desc("started_at"), "id")


def turn_ordinals(rows: DataFrame, by: str = "session_id", order: tuple[str, ...] = ("timestamp", "id")) -> DataFrame:
    """Dense ordinals from 0, in the order of real columns."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("new_ordinal", (F.row_number().over(w) - 1).cast("long"))


def call_ordinals(calls: DataFrame) -> DataFrame:
    w = Window.partitionBy("session_id", "turn_id").orderBy("timestamp", "id")
    return calls.withColumn("call_ordinal", (F.row_number().over(w) - 1).cast("long"))


def dedup_calls(calls: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Of calls with one key the first by id stays; each knows how many it stands for."""
    w = Window.partitionBy(*key)
    numbered = calls.withColumn("_n", F.row_number().over(w.orderBy("id"))).withColumn("copies", F.count(F.lit(1)).over(w))
    return numbered.filter("_n = 1").drop("_n")


def positional_join(calls: DataFrame, blocks: DataFrame) -> DataFrame:
    """The n-th call of a tool in a turn with the n-th block of that tool."""
    number = lambda rows: rows.withColumn(
        "n", F.row_number().over(Window.partitionBy("session_id", "turn_id", "tool_name").orderBy("position"))
    )
    return number(calls).join(number(blocks).withColumnRenamed("position", "block_position"), ["session_id", "turn_id", "tool_name", "n"])


def counter_delta(rows: DataFrame, by: str, order: str, counter: str) -> DataFrame:
    """Growth of a cumulative counter; one that shrank has started anew."""
    before = F.lag(counter).over(Window.partitionBy(by).orderBy(order))
    value = F.col(counter)
    return rows.withColumn("delta", F.when(before.isNull() | (value < before), value).otherwise(value - before))


def last_assistant(a: Archive) -> DataFrame:
    """For every turn the latest assistant turn up to it."""
    w = Window.partitionBy("session_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return a.turns.withColumn("last_assistant", F.last(F.when(F.col("type") == "assistant", F.col("id")), True).over(w))
