"""Incremental ingestion of transcript folders.

Structured Streaming's file source takes every path once, so a transcript that
grew is not seen again by it. ``SyncedArchive.sync`` compares modification times
with the stored ones instead, reads new and changed files alike, and writes the
sessions that they touch; run it on a schedule. ``stream_new`` is for folders
whose files are written once.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from turnlake.functions import paths as pt
from turnlake.functions.periods import month_of
from turnlake.operators.integrity import needs_sync, reparse_selection
from turnlake.operators.text_index import TextIndex
from turnlake.operators.writes import own_number, session_upsert
from turnlake.sources import sessions as ss
from turnlake.sources import transcripts as tr
from turnlake.sources.archive import Archive
from turnlake.sources.generations import Generations, keys

_SESSIONS = (
    "id string, project_id long, started_at timestamp, ended_at timestamp, model string, source string, turn_count long, input_tokens long, output_tokens long, "
    "cache_read_tokens long, cache_write_tokens long, parent_session_id string, source_file string, has_error boolean, has_subagent boolean, last_entry_uuid string, "
    "git_branch string, project_path string, agent_type string, agent_description string, agent_call_id string, spawn_depth int"
)
_FILES = "path string, source string, mtime timestamp, session_id string"


def _project_of(kind: str, root: str) -> Column:
    """The project of a file that names no folder."""
    if kind in ("jeff", "hex"):
        return F.lit(f"{kind}:{root.rstrip('/')}")
    if kind == "nanoclaw":
        return F.concat(F.lit("nanoclaw/"), F.regexp_extract("below", r"^/([^/]+)/", 1))
    return F.regexp_replace(F.regexp_extract("below", r"^/projects/([^/]+)/", 1), "^-", "/")


class SyncedArchive:
    """An archive that is kept up with transcript folders.

    Sessions, turns, calls and the files' times change together, by whole
    sessions (see ``Generations``). Sessions whose files are gone stay. The text
    index below the folder, if there is one, follows.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._tables = Generations(spark, f"{self.folder}/synced")

    @property
    def exists(self) -> bool:
        return bool(self._tables.numbers)

    def _files(self) -> DataFrame:
        return self._tables.live("source_files", "path", "file") if self.exists else self.spark.createDataFrame([], _FILES)

    def _sessions(self) -> DataFrame:
        return self._tables.live("sessions", "id", schema=_SESSIONS).drop("generation") if self.exists else self.spark.createDataFrame([], _SESSIONS)

    def archive(self) -> Archive:
        """The archive as of the last finished run. Projects follow from their sessions, so their counters always agree."""
        sessions = self._sessions()
        total = reduce(Column.__add__, [F.coalesce(c, F.lit(0)) for c in ss.COUNTERS])
        projects = sessions.groupBy(F.col("project_path").alias("path")).agg(
            F.first("project_id").alias("id"), F.max_by("source", F.struct("ended_at", "id")).alias("source"), F.min("started_at").alias("first_seen_at"),
            F.max("ended_at").alias("last_activity_at"), F.count(F.lit(1)).alias("session_count"), F.sum(total).alias("total_tokens"),
        ).withColumn("display_name", F.element_at(F.split("path", "/"), -1))
        return Archive(projects.select("id", "path", "display_name", *[c for c in projects.columns if c not in ("id", "path", "display_name")]),
                       sessions, self._tables.live("turns").drop("generation"), self._tables.live("tool_uses").drop("generation"), self._files())

    def listed(self, sources: list[dict]) -> DataFrame:
        """(path, file, mtime, source, kind, project_path) of all transcripts of the sources of known type; none is opened."""
        known = [s for s in sources if s["type"] in ss.KINDS]
        if not known:
            raise ValueError("no source has a known type")
        parts = [
            tr.listed(self.spark, s["path"], s["type"]).select(
                "path", "file", "mtime", F.lit(s["name"]).alias("source"), F.lit(s["type"]).alias("kind"), _project_of(s["type"], s["path"]).alias("project_path")
            )
            for s in known
        ]
        # one file that two sources list is the first one's
        first = Window.partitionBy("path").orderBy("_order")
        rows = reduce(DataFrame.unionByName, [p.withColumn("_order", F.lit(k)) for k, p in enumerate(parts)])
        return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_order")

    def _agents(self, sources: list[dict], files: DataFrame) -> DataFrame:
        """(path, agent_type, ...) of the agents' files that have a description beside them."""
        roots = sorted({s["path"] for s in sources if s["type"] in ("claude-code", "nanoclaw")})
        beside = [tr.listed_sidecars(self.spark, r) for r in roots]
        metas: list[str] = []
        if beside:
            rows = reduce(DataFrame.unionByName, beside).dropDuplicates(["path"]).join(files.select("path"), "path", "left_semi")
            metas = [r.meta for r in rows.select("meta").toLocalIterator()]
        return tr.described(tr.contents(self.spark, metas)).select(
            "path", F.nullif("agentType", F.lit("")).alias("agent_type"), F.col("description").alias("agent_description"),
            F.col("toolUseId").alias("agent_call_id"), F.col("spawnDepth").alias("spawn_depth"),
        )

    def _parents_folders(self, orphans: DataFrame, listing: DataFrame) -> DataFrame:
        """(_file, _c): the folder that the first lines of a parent's transcript name, for agents whose parent is no session."""
        rows = listing.filter("kind = 'claude-code'").join(orphans.select(F.col("_file").alias("path")), "path", "left_semi")
        found = tr.contents(self.spark, [r.file for r in rows.select("file").toLocalIterator()])
        return tr.parent_folder(tr.lines(found)).select(F.col("path").alias("_file"), pt.canonical(F.col("cwd")).alias("_c"))

    def sync(self, sources: list[dict], everything: bool = False, mend: bool = False) -> int:
        """Read new and changed transcripts; the number of sessions written.

        With ``everything``, all are read again; with ``mend``, also those that
        ``reparse_selection`` names, as far as they are still there.
        """
        listing = self.listed(sources)
        changed = listing
        if self.exists and not everything:
            stale = needs_sync(listing.select("path", F.col("mtime").alias("disk_mtime")), self._files().select("path", "mtime"))
            paths = stale.select("path")
            if mend:
                paths = paths.unionByName(reparse_selection(self.archive()).join(listing.select("path", "source"), ["path", "source"], "left_semi").select("path"))
            changed = listing.join(paths, "path", "left_semi")
        # paths only, as Spark's own listing of the folders holds them on the driver as well
        names: dict[str, list[str]] = {}
        for r in changed.select("kind", "file").toLocalIterator():
            names.setdefault(r.kind, []).append(r.file)
        if not names:
            return 0
        parsed = [ss.parse(tr.contents(self.spark, paths), kind) for kind, paths in sorted(names.items())]
        # every table below reads them; a lost executor's part is parsed again
        turns, calls, sessions = (reduce(DataFrame.unionByName, part).persist(StorageLevel.DISK_ONLY) for part in zip(*parsed, strict=True))
        kept = (turns, calls, sessions)

        # of files with one session, the last written one speaks for it
        sessions = sessions.join(changed.select("path", "mtime", "source", F.col("project_path").alias("_home")), "path")
        last = Window.partitionBy("id").orderBy(F.desc("mtime"), F.desc("path"))
        sessions = sessions.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
        stored = self._sessions()
        # an agent's project is its parent's, from this run or from the archive
        parents = sessions.select(F.col("id").alias("_parent"), F.coalesce("cwd", "_home").alias("_a"))
        before = stored.select(F.col("id").alias("_parent"), F.col("project_path").alias("_b"))
        home = F.coalesce("_a", "_b", "_c", F.nullif("cwd", F.lit("")), "_home")
        sessions = sessions.withColumn("_parent", F.element_at(F.split("parent_session_id", ":"), -1)).withColumn("_file", tr.parent_path(F.col("path")))
        sessions = sessions.join(parents, "_parent", "left").join(before, "_parent", "left")
        # else the one that its parent's transcript names, which may have no turn yet
        orphans = sessions.filter("_file is not null and _a is null and _b is null").select("_file").distinct()
        sessions = sessions.join(self._parents_folders(orphans, listing), "_file", "left").join(self._agents(sources, changed), "path", "left")
        fresh = sessions.withColumn("project_path", home).withColumn("project_id", own_number("project_path")).withColumn("source_file", F.col("path"))
        chosen = fresh.select("id", "path")
        columns = stored.columns
        old = stored.join(chosen.select("id"), "id", "left_semi")
        written = session_upsert(old, fresh.select(*columns))
        # what a session's folder or branch became holds, as its project does
        moved = fresh.select("id", F.col("project_path").alias("_p"), F.col("project_id").alias("_i"), F.col("git_branch").alias("_g"))
        written = written.join(moved, "id").select(
            *[{"project_path": F.col("_p"), "project_id": F.col("_i"), "git_branch": F.coalesce("_g", "git_branch")}.get(c, F.col(c)).alias(c) for c in columns]
        )
        pick = chosen.select("path", F.col("id").alias("session_id"))
        turns = turns.join(pick, ["path", "session_id"], "left_semi").withColumn("month", month_of(F.col("timestamp")))
        doubled = Window.partitionBy("session_id", "id").orderBy("ordinal")
        turns = turns.withColumn("_n", F.row_number().over(doubled)).filter("_n = 1").drop("_n")
        calls = calls.join(pick, ["path", "session_id"], "left_semi").withColumn("id", own_number("session_id", "turn_id", "turn_ordinal"))

        own = sessions.select("path", F.col("id").alias("session_id"))
        files = changed.select("path", "source", "mtime").join(own, "path", "left")
        # a session that moved leaves its former file, unless that is still there
        former = old.select(F.col("source_file").alias("path")).join(listing.select("path"), "path", "left_anti")
        touched = keys(chosen, "id").unionByName(keys(files, "path", "file")).unionByName(keys(former, "path", "file"))
        self._tables.write(
            {
                "sessions": (written, []), "turns": (turns.sortWithinPartitions("session_id", "ordinal"), ["month"]),
                "tool_uses": (calls.sortWithinPartitions("session_id", "turn_id"), []), "source_files": (files, []),
            },
            touched, whole=not self.exists,
        )
        for rows in kept:
            rows.unpersist()
        index = TextIndex(self.spark, f"{self.folder}/text_index")
        done = self._tables.live("sessions", "id").filter(F.col("generation") == max(self._tables.numbers)).select(F.col("id").alias("session_id"))
        if index.exists:
            index.replace(self.archive(), done)
        return done.count()

    def build_index(self) -> TextIndex:
        return TextIndex(self.spark, f"{self.folder}/text_index").rebuild(self.archive())


def stream_new(spark: SparkSession, root: str, kind: str, out: str, checkpoint: str) -> StreamingQuery:
    """All transcripts not seen before, parsed and appended as Parquet; ends when there are no more."""
    pattern = "*.json" if kind == "hex" else "*.jsonl"
    found = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rows = found.select(F.col("_metadata.file_path").alias("path"), "value")
    below = F.concat(F.lit("/"), F.regexp_replace("path", f"^.*?{root.strip('/')}/", ""))
    rows = rows.filter(tr.belongs(kind, below))

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again writes the same folder again
        ss.parse(batch, kind).turns.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
