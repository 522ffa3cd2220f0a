"""What a user calls: an archive with its queries as methods that give DataFrames."""

from __future__ import annotations

from datetime import timezone, tzinfo

from pyspark.sql import DataFrame, SparkSession

from turnlake.functions.query_string import parse
from turnlake.operators import analytics, export, integrity, listing, search, writes
from turnlake.operators.text_index import TextIndex
from turnlake.sources import archive as tables

#: Default and largest page of each listing.
PAGES = {"search": (10, 50), "turns": (20, 50), "sessions": (20, 100), "projects": (50, 100)}


def page_size(kind: str, wanted: int | None) -> int:
    usual, most = PAGES[kind]
    return min(wanted, most) if wanted and wanted > 0 else usual


class Lake:
    """An archive opened from Parquet, or from tables at hand."""

    def __init__(self, archive: tables.Archive, zone: tzinfo = timezone.utc, index: TextIndex | None = None, folder: str | None = None, version: int = tables.VERSION):
        self.archive, self.zone, self.index, self.folder, self.version = archive, zone, index, folder, version

    @classmethod
    def open(cls, spark: SparkSession, folder: str, zone: tzinfo = timezone.utc) -> Lake:
        """A saved archive, with its text index if it has one; one newer than this code is refused."""
        folder = folder.rstrip("/")
        version = tables.readable_version(spark, folder)
        index = TextIndex(spark, f"{folder}/text_index")
        return cls(tables.from_parquet(spark, folder), zone, index if index.exists else None, folder, version or 1)

    def save(self, folder: str, index: bool = False) -> None:
        """Write all tables, turns by month; with ``index`` the text index of what was written too."""
        tables.to_parquet(self.archive, folder)
        if index:
            spark = self.archive.spark
            TextIndex(spark, f"{folder}/text_index").rebuild(tables.from_parquet(spark, folder))

    def search(self, line: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        return search.page(self.archive, parse(line, self.zone), page_size("search", limit), max(0, offset), self.index)

    def search_with_calls(self, line: str, limit: int | None = None) -> DataFrame:
        return search.attributed(self.archive, parse(line, self.zone), page_size("search", limit), self.index)

    def ranked(self, text: str, limit: int | None = None) -> DataFrame:
        wanted = page_size("search", limit)
        return self.index.ranked(text, wanted) if self.index else search.ranked(self.archive, text, wanted)

    def turns(self, session: str, kind: str | None = None, after: int | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        return listing.turn_page(self.archive, session, kind, after, page_size("turns", limit), offset)

    def session(self, session: str) -> DataFrame:
        return listing.session_by_id(self.archive, session)

    def sessions(self, scope: str = "top", project_id: int | None = None, parent: str = "", limit: int | None = None, offset: int = 0) -> DataFrame:
        return listing.list_sessions(self.archive, scope, project_id, parent, page_size("sessions", limit), offset)

    def projects(self, order: str = "activity", limit: int | None = None, offset: int = 0) -> DataFrame:
        return listing.list_projects(self.archive, order, page_size("projects", limit), offset)

    def summary(self) -> DataFrame:
        return analytics.session_summary(self.archive)

    def stats(self) -> dict[str, DataFrame]:
        """The figures of an overview, each a small frame of its own."""
        a = self.archive
        return {
            "sessions": analytics.session_stats(a), "projects": analytics.project_stats(a), "range": analytics.activity_range(a),
            "models": analytics.io_tokens_by_model(a), "tools": analytics.tool_usage(a), "cache": integrity.cache_coverage(a),
            "counters": integrity.turn_count_reconcile(a), "synced": analytics.last_synced(a),
        }

    def analytics(self, since: str = "1970-01-01", days: int = 30, limit: int = 10) -> dict[str, DataFrame]:
        e = analytics.session_export(self.archive)
        return {
            "by_day": analytics.tokens_by_day(e, since, days), "projects": analytics.top_projects(e, limit), "models": analytics.tokens_by_model(e),
            "sources": analytics.tokens_by_source(e), "sessions": analytics.sessions_by_source(e), "roles": analytics.agent_role_stats(e), "summary": analytics.archive_summary(e),
        }

    def markdown(self, session: str | None = None) -> DataFrame:
        a = self.archive
        if session is not None:
            a = a._replace(turns=a.turns.filter(a.turns.session_id == session), sessions=a.sessions.filter(a.sessions.id == session))
        return export.markdown(a)

    def merged(self, incoming: Lake) -> Lake:
        if self.folder is not None and self.folder == incoming.folder:
            raise ValueError("an archive cannot be merged with itself")
        writes.check_mergeable(self.archive, incoming.archive, tables.VERSION, incoming.version)
        return Lake(writes.merge(self.archive, incoming.archive), self.zone)
