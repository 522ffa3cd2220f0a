"""The search line: free text with ``name:value`` filters."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone, tzinfo

_FILTER = re.compile(r'(\w+):("[^"]*"|[^\s]+)')
#: The written forms of a date.
LAYOUTS = ("%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%b %d, %Y", "%B %d, %Y")


@dataclass
class Query:
    text: str = ""
    project: str = ""
    model: str = ""
    tool: str = ""
    file: str = ""
    source: str = ""
    before: datetime | None = None
    after: datetime | None = None
    has_error: bool = False
    has_subagent: bool = False
    has_tool_error: bool = False

    @property
    def has_filters(self) -> bool:
        return any(v for k, v in vars(self).items() if k != "text")

    @property
    def is_empty(self) -> bool:
        return not self.text and not self.has_filters


def parse_date(value: str, zone: tzinfo = timezone.utc, now: datetime | None = None) -> datetime | None:
    """Midnight of a written or named day in the caller's zone; None if unreadable."""
    for layout in LAYOUTS:
        try:
            return datetime.strptime(value, layout).replace(tzinfo=zone)
        except ValueError:
            continue
    today = (now or datetime.now(zone)).astimezone(zone).replace(hour=0, minute=0, second=0, microsecond=0)
    back = {"today": 0, "yesterday": 1, "week": 7, "thisweek": 7, "month": 30, "thismonth": 30}
    days = back.get(value.lower())
    return None if days is None else today - timedelta(days=days)


def parse(line: str, zone: tzinfo = timezone.utc, now: datetime | None = None) -> Query:
    """Known filters set fields, the last of a name wins; every ``name:value`` leaves the free text."""
    query = Query()
    for name, value in _FILTER.findall(line):
        name, value = name.lower(), value.replace('"', "")
        if name in ("project", "model", "tool", "file", "source"):
            setattr(query, name, value)
        elif name in ("before", "after"):
            setattr(query, name, parse_date(value, zone, now))
        elif name == "has":
            wanted = value.lower()
            query.has_error |= wanted == "error"
            query.has_subagent |= wanted in ("subagent", "agent")
            query.has_tool_error |= wanted in ("toolerror", "tool-error", "tool_error")
    query.text = _FILTER.sub("", line).strip()
    return query
