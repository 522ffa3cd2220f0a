"""Repairs from the lines that the archive itself keeps.

Stored lines go through the same readers as files do. A line that cannot be read
makes its session a failure; a stub has lost its counters and shows as a
difference, with the number of stubs beside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.functions import blocks as bl
from turnlake.operators.analytics import zero
from turnlake.operators.writes import apply_backfill, backfill_outcomes
from turnlake.sources import sessions as ss
from turnlake.sources import transcripts as tr
from turnlake.sources.archive import Archive

#: Readers of single stored lines, by kind; kinds without counters on their lines are not among them.
LINES = {"claude-code": tr.claude_turns, "nanoclaw": tr.nanoclaw_turns, "codex": tr.codex_turns, "pi": tr.pi_turns}


def stored_lines(a: Archive, sessions: DataFrame) -> DataFrame:
    """(path, line_no, line) of the kept lines of sessions (id), a session in the place of its file."""
    mine = a.turns.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return mine.select(F.col("session_id").alias("path"), F.col("ordinal").cast("long").alias("line_no"), F.col("raw_json").alias("line"))


def stored_totals(a: Archive, sessions: DataFrame, kind: str) -> DataFrame:
    """(session_id, four counters, failed_lines, stub_lines) of sessions of a kind, from their kept lines; sessions without lines are left out."""
    lines = stored_lines(a, sessions)
    unreadable, stub = F.try_parse_json("line").isNull(), F.coalesce(bl.is_stub(F.col("line")), F.lit(False))
    told = lines.groupBy("path").agg(F.count_if(unreadable).alias("failed_lines"), F.count_if(stub).alias("stub_lines"))
    turns = ss.shaped(LINES[kind](lines.filter(~unreadable & ~stub)), ss.TURN)
    sums = turns.groupBy("path").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ss.COUNTERS])
    return told.join(sums, "path", "left").select(F.col("path").alias("session_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ss.COUNTERS], "failed_lines", "stub_lines")


def backfill(a: Archive, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Outcomes of all sessions without cache counters, and the sessions with those counters that their lines prove.

    kinds names the kind of each configured source; sources of other kinds are
    not supported. Run again, it finds nothing more to write.
    """
    open_ = a.sessions.filter((zero("cache_read_tokens") == 0) & (zero("cache_write_tokens") == 0))
    supported = {name: kind for name, kind in kinds.items() if kind in LINES}
    parts = [stored_totals(a, open_.filter(F.col("source").isin(*[n for n, k in supported.items() if k == kind])), kind) for kind in sorted(set(supported.values()))]
    outcomes = backfill_outcomes(a, reduce(DataFrame.unionByName, parts), tuple(supported))
    return outcomes, apply_backfill(a.sessions, outcomes)
