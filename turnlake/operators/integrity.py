"""Audits: drift, JSON validity, time layouts, token coverage, files that are gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.functions import paths as pt
from turnlake.operators.analytics import zero
from turnlake.sources.archive import Archive


def counted_turns(a: Archive) -> DataFrame:
    """(id, claimed, held) of every session."""
    held = a.turns.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return a.sessions.select("id", zero("turn_count").alias("claimed"), "source_file", "source").join(held, "id", "left").select(
        "id", "claimed", F.coalesce("n", F.lit(0)).alias("held"), "source_file", "source"
    )


def turn_count_reconcile(a: Archive) -> DataFrame:
    """Sessions whose counter differs from their rows, with the right number."""
    return counted_turns(a).filter("claimed <> held").select("id", "claimed", "held")


def turn_drift(a: Archive, on_disk: DataFrame) -> DataFrame:
    """Drifted sessions by cause, with claimed and held turns; on_disk has (path, disk_mtime).

    A transcript that is gone cannot be read again; one that has not changed
    since it was read gives the same rows again; any other will be repaired by
    the next sync.
    """
    parsed = a.source_files.select(F.col("path").alias("source_file"), "source", "mtime")
    d = counted_turns(a).filter("claimed <> held").join(parsed, ["source_file", "source"], "left")
    d = d.join(on_disk.select(F.col("path").alias("source_file"), "disk_mtime"), "source_file", "left")
    cause = (
        F.when(F.col("disk_mtime").isNull(), "transcript gone")
        .when(F.col("mtime").isNotNull() & (F.col("disk_mtime") <= F.col("mtime")), "unstorable")
        .otherwise("unparsed")
    )
    return d.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("claimed").alias("claimed"), F.sum("held").alias("held"))


def cache_coverage(a: Archive) -> DataFrame:
    """How many sessions carry cache counters at all."""
    used = (zero("cache_read_tokens") > 0) | (zero("cache_write_tokens") > 0)
    spent = (zero("input_tokens") > 0) | (zero("output_tokens") > 0)
    return a.sessions.agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(used).alias("with_cache"), F.count_if(spent & ~used).alias("spent_without_cache"),
        F.coalesce(F.sum("cache_read_tokens"), F.lit(0)).alias("cache_read_tokens"), F.coalesce(F.sum("cache_write_tokens"), F.lit(0)).alias("cache_write_tokens"),
    )


def raw_json_integrity(turns: DataFrame, newest: int = 100_000) -> DataFrame:
    """Sessions with unreadable raw JSON among the newest turns; 0 means all turns."""
    window = turns if newest <= 0 else turns.orderBy(F.desc_nulls_last("timestamp"), "session_id", "id").limit(newest)
    bad = F.try_parse_json("raw_json").isNull() & F.col("raw_json").isNotNull()
    return window.groupBy("session_id").agg(F.count(F.lit(1)).alias("checked"), F.count_if(bad).alias("invalid")).filter("invalid > 0")


def timestamp_layout(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: filled rows, rows off the canonical layout, and the least such text."""
    off = {c: F.col(c).isNotNull() & ~F.rlike(c, F.lit(pt.CANONICAL)) for c in columns}
    parts = [
        F.struct(F.lit(c).alias("name"), F.count(c).alias("filled"), F.count_if(off[c]).alias("off_layout"), F.min(F.when(off[c], F.col(c))).alias("sample"))
        for c in columns
    ]
    return rows.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def sessions_without_source(a: Archive, on_disk: DataFrame) -> DataFrame:
    """Transcripts that are gone, with the number of their sessions."""
    by_file = a.sessions.groupBy("source_file").agg(F.count(F.lit(1)).alias("sessions"))
    return by_file.join(on_disk.select(F.col("path").alias("source_file")), "source_file", "left_anti")


def orphan_calls(a: Archive) -> DataFrame:
    """Calls whose turn is not in the archive."""
    keys = a.turns.select("session_id", F.col("id").alias("turn_id"))
    return a.tool_uses.join(keys, ["session_id", "turn_id"], "left_anti")


def needs_sync(on_disk: DataFrame, known: DataFrame) -> DataFrame:
    """Files never read, read at an unknown time, or changed since; both have (path, ...)."""
    rows = on_disk.join(known.select("path", "mtime"), "path", "left")
    return rows.filter(F.col("mtime").isNull() | (F.col("disk_mtime") > F.col("mtime"))).drop("mtime")


def strayed_agents(sessions: DataFrame) -> DataFrame:
    """Ids of subagents' sessions that lie in another project than the session that started them.

    A parent is named by its id, or by an id whose last part it is; where both
    are sessions, the whole id counts. Without its parent a session has not strayed.
    """
    named = F.col("parent_session_id")
    either = F.array_distinct(F.array(named, F.element_at(F.split(named, ":"), -1)))
    agents = sessions.filter(named.isNotNull()).select("id", "project_id", named.alias("_whole"), F.explode(either).alias("_parent"))
    parents = sessions.select(F.col("id").alias("_parent"), F.struct(F.col("project_id").alias("p")).alias("_theirs"))
    met = agents.join(parents, "_parent").groupBy("id").agg(
        F.first("project_id").alias("_own"), F.max_by("_theirs", F.col("_parent") == F.col("_whole")).alias("_theirs")
    )
    return met.filter(~F.col("_own").eqNullSafe(F.col("_theirs.p"))).select("id")


def reparse_selection(a: Archive) -> DataFrame:
    """Transcripts to read again although they have not changed: (path, source, session_id, short, strayed).

    Short are sessions whose counter differs from their turns, strayed are
    subagents that lie in another project than their parent. A transcript is
    met by path and source, since two sources may hold the same path.
    """
    strayed = strayed_agents(a.sessions).withColumn("strayed", F.lit(True))
    rows = counted_turns(a).select("id", (F.col("claimed") != F.col("held")).alias("short"), F.col("source_file").alias("path"), "source")
    rows = rows.join(strayed, "id", "left").withColumn("strayed", F.coalesce("strayed", F.lit(False))).filter("short or strayed")
    return rows.join(a.source_files.select("path", "source"), ["path", "source"]).select("path", "source", F.col("id").alias("session_id"), "short", "strayed")


def rewritten_sessions(stored: DataFrame, incoming_turns: DataFrame) -> DataFrame:
    """Sessions whose stored last turn (id, last_entry_uuid) is missing from a new reading that has the session."""
    fresh = incoming_turns.select(F.col("session_id").alias("id")).distinct()
    tail = stored.filter("last_entry_uuid is not null").join(fresh, "id", "left_semi")
    ids = incoming_turns.select(F.col("session_id").alias("id"), F.col("id").alias("last_entry_uuid"))
    return tail.join(ids, ["id", "last_entry_uuid"], "left_anti")
