"""Usage aggregates over sessions, turns and calls; null counters count as zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnlake.sources.archive import Archive

COUNTERS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def all_tokens() -> Column:
    return sum((zero(c) for c in COUNTERS[1:]), zero(COUNTERS[0]))


def session_export(a: Archive) -> DataFrame:
    """One row per session in the fixed column order of the analytics table."""
    paths = a.projects.select(F.col("id").alias("project_id"), F.col("path").alias("project_path"))
    return a.sessions.join(paths, "project_id", "left").select(
        "id", zero("project_id").alias("project_id"), F.coalesce("project_path", F.lit("")).alias("project_path"),
        "started_at", "ended_at", F.coalesce("model", F.lit("")).alias("model"), zero("turn_count").cast("int").alias("turn_count"),
        zero("input_tokens").alias("input_tokens"), zero("output_tokens").alias("output_tokens"),
        zero("cache_read_tokens").alias("cache_read_tokens"), all_tokens().alias("total_tokens"), "source",
        F.coalesce("parent_session_id", F.lit("")).alias("parent_session_id"), zero("cache_write_tokens").alias("cache_write_tokens"),
    )


EXPORT_COLUMNS = (
    "id", "project_id", "project_path", "started_at", "ended_at", "model", "turn_count", "input_tokens", "output_tokens",
    "cache_read_tokens", "total_tokens", "source", "parent_session_id", "cache_write_tokens",
)


def missing_columns(export: DataFrame | None) -> list[str]:
    """Expected columns that a stored export lacks; all of them if there is none."""
    have = set(export.columns) if export is not None else set()
    return [c for c in EXPORT_COLUMNS if c not in have]


def tokens_by_day(export: DataFrame, since: str, days: int) -> DataFrame:
    day = F.date_format("started_at", "yyyy-MM-dd")
    return (
        export.filter(F.col("started_at") > F.lit(since).cast("timestamp"))
        .groupBy(day.alias("day"))
        .agg(
            F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
            F.sum("total_tokens").alias("total_tokens"), F.count(F.lit(1)).alias("sessions"),
        )
        .orderBy(F.desc("day"))
        .limit(days)
    )


def top_projects(export: DataFrame, limit: int) -> DataFrame:
    return (
        export.groupBy("project_path")
        .agg(F.count(F.lit(1)).alias("sessions"), F.sum("total_tokens").alias("total_tokens"), F.max("started_at").alias("last_active"))
        .orderBy(F.desc("total_tokens"), "project_path")
        .limit(limit)
    )


def tokens_by_model(export: DataFrame) -> DataFrame:
    return (
        export.filter("model <> ''").groupBy("model")
        .agg(F.count(F.lit(1)).alias("sessions"), F.sum("total_tokens").alias("total_tokens"))
    )


def tokens_by_source(export: DataFrame) -> DataFrame:
    return export.groupBy(F.coalesce("source", F.lit("claude-code")).alias("source")).agg(F.sum("total_tokens").alias("total_tokens"))


def sessions_by_source(export: DataFrame) -> DataFrame:
    return export.groupBy(F.coalesce("source", F.lit("claude-code")).alias("source")).agg(F.count(F.lit(1)).alias("sessions"))


def agent_role_stats(export: DataFrame) -> DataFrame:
    role = F.when(F.col("parent_session_id") != "", "subagent").otherwise("top-level")
    return (
        export.groupBy(role.alias("role"))
        .agg(F.count(F.lit(1)).alias("sessions"), F.sum("turn_count").alias("turns"), F.sum("total_tokens").alias("total_tokens"))
        .withColumn("avg_turns", F.coalesce(F.try_divide("turns", "sessions"), F.lit(0.0)))
        .withColumn("avg_tokens", F.coalesce(F.try_divide("total_tokens", "sessions"), F.lit(0.0)))
    )


def role_share(export: DataFrame) -> DataFrame:
    """Each role's share of all tokens in percent, and its bar against the largest role."""
    whole = Window.partitionBy()  # over the two roles
    stats = agent_role_stats(export)
    return stats.select(
        "role", "total_tokens",
        F.round(F.coalesce(F.try_divide(100 * F.col("total_tokens"), F.sum("total_tokens").over(whole)), F.lit(0.0)), 4).alias("share"),
        F.round(F.coalesce(F.try_divide("total_tokens", F.max("total_tokens").over(whole)), F.lit(0.0)), 4).alias("bar"),
    )


def archive_summary(export: DataFrame) -> DataFrame:
    return export.agg(
        F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.min("started_at").alias("first_session"), F.max("started_at").alias("last_session"), F.countDistinct("model").alias("models"),
    )


def session_stats(a: Archive) -> DataFrame:
    """Sessions, turns and tokens of the archive; two one-row totals side by side."""
    sessions = a.sessions.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum(all_tokens()), F.lit(0)).alias("total_tokens"))
    turns = a.turns.agg(F.count(F.lit(1)).alias("turns"))
    return sessions.join(F.broadcast(turns), F.lit(True))


def io_tokens_by_model(a: Archive) -> DataFrame:
    """Input and output only; a session with either unknown is left out."""
    total = F.col("input_tokens") + F.col("output_tokens")
    return a.sessions.filter("model is not null and model <> ''").groupBy("model").agg(F.coalesce(F.sum(total), F.lit(0)).alias("tokens"))


def project_totals(a: Archive) -> DataFrame:
    """Sessions and tokens of every project, zero for those without sessions."""
    sums = a.sessions.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.sum(all_tokens()).alias("t"), F.min("started_at").alias("f"), F.max("ended_at").alias("l"))
    return a.projects.join(sums, F.col("id") == F.col("project_id"), "left").select(
        "id", "path", "display_name", "source", F.coalesce("n", F.lit(0)).alias("session_count"), F.coalesce("t", F.lit(0)).alias("total_tokens"),
        F.col("f").alias("first_seen_at"), F.col("l").alias("last_activity_at"),
    )


def project_stats(a: Archive) -> DataFrame:
    return project_totals(a).agg(F.count(F.lit(1)).alias("projects"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"))


def activity_range(a: Archive) -> DataFrame:
    return project_totals(a).agg(F.min("first_seen_at").alias("first_seen"), F.max("last_activity_at").alias("last_activity"))


def tool_usage(a: Archive, limit: int = 20) -> DataFrame:
    return a.tool_uses.groupBy("tool_name").agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), "tool_name").limit(limit)


def subagent_counts(a: Archive) -> DataFrame:
    kids = a.sessions.filter("parent_session_id is not null").groupBy(F.col("parent_session_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return a.sessions.select("id").join(kids, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("subagent_count"))


def turn_counts_by_type(a: Archive) -> DataFrame:
    return a.turns.groupBy("session_id", "type").agg(F.count(F.lit(1)).alias("turns"))


def session_summary(a: Archive) -> DataFrame:
    """Per session with turns: counts by type, calls, failed calls, first and last user message."""
    user = F.col("type") == "user"
    turns = a.turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(user).alias("user_turns"), F.count_if(F.col("type") == "assistant").alias("assistant_turns"),
        F.min_by(F.when(user, F.col("content")), F.when(user, F.col("ordinal"))).alias("first_user"),
        F.max_by(F.when(user, F.col("content")), F.when(user, F.col("ordinal"))).alias("last_user"),
    )
    calls = a.tool_uses.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("f"))
    return turns.join(calls, "session_id", "left").select(
        *turns.columns, F.coalesce("n", F.lit(0)).alias("calls"), F.coalesce("f", F.lit(0)).alias("failed_calls")
    )


def top_tools_per_session(a: Archive, limit: int = 10) -> DataFrame:
    by = Window.partitionBy("session_id").orderBy(F.desc("uses"), "tool_name")
    counts = a.tool_uses.groupBy("session_id", "tool_name").agg(F.count(F.lit(1)).alias("uses"))
    return counts.withColumn("rank", F.row_number().over(by).cast("long")).filter(F.col("rank") <= limit)


def session_token_totals(a: Archive) -> DataFrame:
    return a.sessions.select("id", all_tokens().alias("total_tokens"))


def session_bounds(a: Archive) -> DataFrame:
    """First and last readable time, and the first turn by ordinal."""
    return a.turns.groupBy("session_id").agg(
        F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), F.min_by("type", "ordinal").alias("first_type")
    )


def ordered_concat(a: Archive) -> DataFrame:
    """User texts of each session, joined by newlines in their order."""
    texts = F.array_sort(F.collect_list(F.struct("ordinal", "content")))
    rows = a.turns.filter("type = 'user'").groupBy("session_id").agg(texts.alias("_t"))
    return rows.select("session_id", F.array_join(F.transform("_t", lambda x: x["content"]), "\n").alias("text"))


def call_flags(a: Archive) -> DataFrame:
    """Whether any call of a session failed, and whether any is known to have succeeded."""
    return a.tool_uses.groupBy("session_id").agg(
        F.coalesce(F.bool_or("is_error"), F.lit(False)).alias("any_error"), F.coalesce(F.bool_or(~F.col("is_error")), F.lit(False)).alias("any_success")
    )


def last_synced(a: Archive) -> DataFrame:
    return a.source_files.groupBy("source").agg(F.min("mtime").alias("oldest"), F.max("mtime").alias("newest"), F.count_if(F.col("mtime").isNull()).alias("unknown"))
