"""Project paths, session ids and written times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(path: Column) -> Column:
    """The project that a worktree belongs to."""
    return F.regexp_replace(path, r"^(.+?)/\.claude/worktrees/+[^/].*$", "$1")


def decoded(folder: Column) -> Column:
    """A project folder's name as the path it most likely stands for."""
    plain = F.translate(folder, "-", "/")
    return F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def parent_session(session: Column) -> Column:
    """The session that a composite subagent id names; null for others."""
    return F.nullif(F.regexp_extract(session, r"^([^:]+:[^:]+(?::[^:]+)*):[^:]+$", 1), F.lit(""))


def subagent_id(source: Column, path: Column) -> Column:
    """source:parent:agent for a file below ``<parent>/subagents``; null for others."""
    parent = F.regexp_extract(path, r"([^/]+)/subagents/agent-[^/]*\.jsonl$", 1)
    agent = F.regexp_extract(path, r"/subagents/agent-([^/]*)\.jsonl$", 1)
    return F.when(parent != "", F.concat_ws(":", source, parent, agent))


#: The written forms of a time, tried in order.
LAYOUTS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS] Z 'UTC'",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]",
    "yyyy-MM-dd",
)
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{9}Z$"


def parsed_time(text: Column) -> Column:
    """An instant from any known form; a monotonic suffix is cut; null if unreadable."""
    plain = F.regexp_replace(text, r" m=[+-].*$", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(form)) for form in LAYOUTS])


def rendered_time(time: Column) -> Column:
    """UTC with nine fraction digits, which sorts like time."""
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000Z"))


def project_label(path: Column, shown: int = 3) -> Column:
    """The last parts of a path, with ``~`` for what a home folder hides."""
    home = F.regexp_replace(path, r"^/(?:home|Users)/[^/]+", "~")
    parts = F.filter(F.split(home, "/"), lambda p: p != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - shown + 1, F.lit(1)), shown), "/")
