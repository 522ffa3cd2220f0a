"""Upserts, replacement and merging as functions of old and new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnlake.operators.analytics import COUNTERS, zero
from turnlake.sources.archive import Archive

ALWAYS = ("ended_at", "turn_count", *COUNTERS, "has_error", "has_subagent", "source")
AGENT = ("agent_type", "agent_description", "agent_call_id", "spawn_depth")
IF_POSITIVE, IF_KNOWN, IF_FILLED = ("project_id",), ("parent_session_id", "last_entry_uuid", "model", *AGENT), ("source_file",)


def session_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New sessions in, known ones updated by the rule of each column; the first start is kept."""

    def pick(c: str) -> Column:
        was, now = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in ALWAYS:
            kept = now
        elif c in IF_POSITIVE:
            kept = F.when(now > 0, now).otherwise(was)
        elif c in IF_KNOWN:
            kept = F.coalesce(now, was)
        elif c in IF_FILLED:
            kept = F.coalesce(F.nullif(now, F.lit("")), was)
        else:
            kept = was
        return F.when(F.col("n.id").isNull(), was).when(F.col("o.id").isNull(), now).otherwise(kept).alias(c)

    joined = old.alias("o").join(new.select(*old.columns).alias("n"), F.col("o.id") == F.col("n.id"), "full")
    return joined.select(F.coalesce("o.id", "n.id").alias("id"), *[pick(c) for c in old.columns if c != "id"])


def project_upsert(seen: DataFrame) -> DataFrame:
    """One row per path of (path, display_name, source, seen_at, tokens, order): extremes, sums and the last label."""
    return seen.groupBy("path").agg(
        F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_activity_at"), F.count(F.lit(1)).alias("session_count"),
        F.sum("tokens").alias("total_tokens"), F.max_by("display_name", "order").alias("display_name"), F.max_by("source", "order").alias("source"),
    )


def turn_replace(old: DataFrame, new: DataFrame) -> DataFrame:
    """All turns of the new sessions replaced; one ordinal twice in a session is an error."""
    double = F.count(F.lit(1)).over(Window.partitionBy("session_id", "ordinal"))
    checked = new.withColumn("_d", F.when(double > 1, F.raise_error(F.concat(F.lit("ordinal twice in session "), "session_id")).cast("int")))
    kept = old.join(new.select("session_id").distinct(), "session_id", "left_anti").select(*old.columns)
    return kept.unionByName(checked.filter(F.col("_d").isNull()).select(*old.columns))


def tool_use_replace(old: DataFrame, new: DataFrame, position: str = "position") -> DataFrame:
    """Calls of the new turns replaced; new ones are numbered in each turn by their position."""
    w = Window.partitionBy("session_id", "turn_id").orderBy(position)
    numbered = new.withColumn("turn_ordinal", (F.row_number().over(w) - 1).cast("long"))
    kept = old.join(new.select("session_id", "turn_id").distinct(), ["session_id", "turn_id"], "left_anti").select(*old.columns)
    return kept.unionByName(numbered.select(*old.columns))


def merge_pick(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, action) for every incoming session: insert, replace if it ended later, else skip."""
    zero_time = F.lit("0001-01-01 00:00:00").cast("timestamp")
    c = current.select("id", F.coalesce("ended_at", zero_time).alias("_c"))
    i = incoming.select("id", F.coalesce("ended_at", zero_time).alias("_i"))
    action = F.when(F.col("_c").isNull(), "insert").when(F.col("_i") > F.col("_c"), "replace").otherwise("skip")
    return i.join(c, "id", "left").select("id", action.alias("action"))


def check_mergeable(current: Archive, incoming: Archive, known_version: int = 17, incoming_version: int = 17, force: bool = False) -> None:
    """Refuse archives that lack key columns or are newer than what is known."""
    need = {"projects": {"path"}, "sessions": {"id", "ended_at"}, "turns": {"session_id", "id"}, "tool_uses": {"session_id", "turn_id"}}
    for table, columns in need.items():
        lacking = columns - set(getattr(incoming, table).columns)
        if lacking:
            raise ValueError(f"{table} of the incoming archive lacks {sorted(lacking)}")
    if incoming_version > known_version and not force:
        raise ValueError(f"the incoming archive is of version {incoming_version}, {known_version} is known")


def own_number(*columns: str) -> Column:
    """A number for a key of this archive, beyond all small ones that other archives count with."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)


def _like(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with a table's columns; those they lack are null."""
    have = {f.name: f.dataType for f in table.schema}
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in have.items()])


def rehomed(calls: DataFrame, turns: DataFrame) -> DataFrame:
    """Calls filed under a session that does not hold their turn go to the one session that does; without one alone they stay."""
    keys = turns.select("session_id", F.col("id").alias("turn_id")).distinct()
    homes = keys.groupBy("turn_id").agg(F.min("session_id").alias("_home"), F.count(F.lit(1)).alias("_homes")).filter("_homes = 1").select("turn_id", "_home")
    strays = calls.join(keys, ["session_id", "turn_id"], "left_anti").join(homes, "turn_id", "left").withColumn("session_id", F.coalesce("_home", "session_id"))
    return calls.join(keys, ["session_id", "turn_id"], "left_semi").unionByName(strays.select(*calls.columns))


def distinct_calls(calls: DataFrame, order: str = "id") -> DataFrame:
    """One of equal calls of a turn: the first of each call id, and the first without id, input and result of each tool.

    Without the columns that tell calls apart all stay.
    """
    if not {"tool_use_id", "input_json", "result_length"} <= set(calls.columns):
        return calls
    named = Window.partitionBy("session_id", "turn_id", "tool_name", "tool_use_id").orderBy(order)
    bare = Window.partitionBy("session_id", "turn_id", "tool_name").orderBy(order)
    empty = F.col("tool_use_id").isNull() & F.col("input_json").isNull() & F.col("result_length").isNull()
    rows = calls.withColumn("_a", F.row_number().over(named)).withColumn("_b", F.row_number().over(bare))
    return rows.filter(~((F.col("tool_use_id").isNotNull() & (F.col("_a") > 1)) | (empty & (F.col("_b") > 1)))).drop("_a", "_b")


def numbered_calls(calls: DataFrame, order: str = "id") -> DataFrame:
    """Calls with ordinals: those they have where a turn's differ, else by their order."""
    if "turn_ordinal" not in calls.columns:
        calls = calls.withColumn("turn_ordinal", F.lit(None).cast("long"))
    turn = Window.partitionBy("session_id", "turn_id")
    same = F.count(F.lit(1)).over(Window.partitionBy("session_id", "turn_id", "turn_ordinal"))
    rows = calls.withColumn("_same", same).withColumn("_unfit", F.max(F.when(F.col("turn_ordinal").isNull() | (F.col("_same") > 1), 1).otherwise(0)).over(turn))
    number = F.row_number().over(turn.orderBy(F.asc_nulls_last("turn_ordinal"), order)) - 1
    return rows.withColumn("turn_ordinal", F.when(F.col("_unfit") == 1, number).otherwise(F.col("turn_ordinal"))).drop("_same", "_unfit")


def merge(current: Archive, incoming: Archive) -> Archive:
    """Both archives as one: absent and later sessions come in with their turns, calls and files.

    Columns are the current archive's; what the incoming one lacks is null, but
    positions of turns and calls are counted. Projects are matched by path; ids
    of projects and calls are an archive's own, so what comes in gets new ones,
    beyond all small numbers. A call comes in if any turn of the merged archive
    has its turn's id, under the session that holds the turn; of equal calls one
    does. It takes the place of what the current archive has for that turn.
    Calls of the current archive whose turns the merge removed go.
    """
    taken = merge_pick(current.sessions, incoming.sessions).filter("action <> 'skip'").select("id")
    key = taken.select(F.col("id").alias("session_id"))

    new_projects = incoming.projects.join(current.projects.select("path"), "path", "left_anti").withColumn("id", own_number("path"))
    projects = current.projects.unionByName(_like(new_projects, current.projects))
    named = incoming.projects.select(F.col("id").alias("project_id"), F.col("path").alias("_path"))
    ids = projects.select(F.col("path").alias("_path"), F.col("id").alias("_project"))

    come = incoming.turns.join(key, "session_id", "left_semi")
    if "ordinal" not in come.columns:
        come = come.withColumn("ordinal", F.row_number().over(Window.partitionBy("session_id").orderBy(F.asc_nulls_last("timestamp"), "id")) - 1)
    come = _like(come, current.turns)
    staying = current.turns.join(key, "session_id", "left_anti")
    turns = staying.unionByName(come)

    sessions = incoming.sessions.join(taken, "id", "left_semi").join(named, "project_id", "left").join(ids, "_path", "left")
    sessions = _like(sessions.withColumn("project_id", F.col("_project")), current.sessions)
    if "last_entry_uuid" in sessions.columns:
        last = come.groupBy(F.col("session_id").alias("id")).agg(F.max_by(come["id"], "ordinal").alias("_last"))
        sessions = sessions.join(last, "id", "left").withColumn("last_entry_uuid", F.coalesce("last_entry_uuid", "_last")).select(*current.sessions.columns)
    sessions = current.sessions.join(taken, "id", "left_anti").unionByName(sessions)

    order = "id" if "id" in incoming.tool_uses.columns else "timestamp"
    calls = incoming.tool_uses.join(key, "session_id", "left_semi").join(turns.select(F.col("id").alias("turn_id")).distinct(), "turn_id", "left_semi")
    calls = numbered_calls(distinct_calls(rehomed(calls, turns), order), order).withColumn("id", own_number("session_id", "turn_id", "turn_ordinal"))
    old = current.tool_uses.join(key, "session_id", "left_anti")
    old = old.filter("turn_id is null").unionByName(old.join(staying.select(F.col("id").alias("turn_id")).distinct(), "turn_id", "left_semi").select(*old.columns))
    old = old.join(calls.select("session_id", "turn_id").distinct(), ["session_id", "turn_id"], "left_anti").select(*current.tool_uses.columns)
    tool_uses = old.unionByName(_like(calls, current.tool_uses))

    paths = incoming.sessions.join(taken, "id", "left_semi").select(F.col("source_file").alias("path")).distinct() if "source_file" in incoming.sessions.columns else None
    files = current.source_files
    if paths is not None:
        new_files = incoming.source_files.join(paths, "path", "left_semi").join(current.source_files.select("path"), "path", "left_anti")
        files = files.unionByName(_like(new_files, current.source_files))
    return Archive(projects, sessions, turns, tool_uses, files)


def prune_projects(a: Archive) -> DataFrame:
    """Projects that have a session."""
    return a.projects.join(a.sessions.select(F.col("project_id").alias("id")), "id", "left_semi")


def backfill_outcomes(a: Archive, parsed: DataFrame, supported: tuple[str, ...]) -> DataFrame:
    """(id, outcome, cache_read_tokens, cache_write_tokens, seen_input, seen_output, stub_lines) of every session without cache counters.

    parsed has per session_id the totals of its stored lines, how many lines
    could not be read and how many were stubs. Counters are taken only where
    input and output equal the stored pair.
    """
    own = a.sessions.filter((zero("cache_read_tokens") == 0) & (zero("cache_write_tokens") == 0)).select("id", "source", zero("input_tokens").alias("i"), zero("output_tokens").alias("o"))
    stubs = F.col("stub_lines") if "stub_lines" in parsed.columns else F.lit(0).cast("long")
    p = parsed.select(F.col("session_id").alias("id"), "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "failed_lines", stubs.alias("stub_lines"))
    outcome = (
        F.when(~F.col("source").isin(*supported), "unsupported")
        .when(F.col("input_tokens").isNull(), "unreadable")
        .when(F.col("failed_lines") > 0, "failed")
        .when((F.col("i") != F.col("input_tokens")) | (F.col("o") != F.col("output_tokens")), "mismatch")
        .when(zero("cache_read_tokens") + zero("cache_write_tokens") == 0, "no cache usage")
        .otherwise("repaired")
    )
    return own.join(p, "id", "left").select(
        "id", outcome.alias("outcome"), "cache_read_tokens", "cache_write_tokens", F.col("i").alias("seen_input"), F.col("o").alias("seen_output"), F.coalesce("stub_lines", F.lit(0)).alias("stub_lines")
    )


def apply_backfill(sessions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Counters of repaired sessions written, only where the session still is as it was when the outcome was found."""
    fixed = outcomes.filter("outcome = 'repaired'").select("id", F.col("cache_read_tokens").alias("_r"), F.col("cache_write_tokens").alias("_w"), "seen_input", "seen_output")
    same = (zero("input_tokens") == F.col("seen_input")) & (zero("output_tokens") == F.col("seen_output"))
    free = (zero("cache_read_tokens") == 0) & (zero("cache_write_tokens") == 0) & F.coalesce(same, F.lit(False))
    new = {"cache_read_tokens": F.col("_r"), "cache_write_tokens": F.col("_w")}
    return sessions.join(fixed, "id", "left").select(*[F.when(free, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in sessions.columns])
