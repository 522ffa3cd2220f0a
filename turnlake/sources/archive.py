"""The archive's tables, and views that lend their shape to the test tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from turnlake.functions.periods import in_parts, month_of


class Archive(NamedTuple):
    projects: DataFrame
    sessions: DataFrame
    turns: DataFrame
    tool_uses: DataFrame
    source_files: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.sessions.sparkSession


#: Fixed start of the fixture's turns; turn k of conversation c is c hours and k minutes later.
BASE = "2024-01-01 00:00:00"


#: Order of the rows inside the files of a stored table.
ORDER = {"sessions": ["id"], "turns": ["session_id", "ordinal"], "tool_uses": ["session_id", "turn_id"]}


#: Bytes of content in a file of turns, on average.
TURN_BYTES = 32 << 20

#: Layout of a stored archive; 1 had no months and no version.
VERSION = 2


def stored_version(spark: SparkSession, folder: str) -> int | None:
    """The version of a stored archive; 1 where it names none, None where there is no archive."""
    try:
        return spark.read.parquet(f"{folder}/version").first().version
    except AnalysisException:
        pass
    try:
        spark.read.parquet(f"{folder}/sessions")
    except AnalysisException:
        return None
    return 1


def readable_version(spark: SparkSession, folder: str) -> int | None:
    """The stored version; an archive newer than this code is refused."""
    version = stored_version(spark, folder)
    if version is not None and version > VERSION:
        raise ValueError(f"the archive at {folder} is of version {version}, {VERSION} is known")
    return version


def from_parquet(spark: SparkSession, folder: str) -> Archive:
    """A stored archive: one Parquet table per name."""
    return Archive(*(spark.read.parquet(f"{folder}/{name}") for name in Archive._fields))


def to_parquet(a: Archive, folder: str) -> None:
    """Write all tables; turns are partitioned by month, so that dates prune files."""
    readable_version(a.spark, folder)
    for name, rows in zip(a._fields, a, strict=True):
        by = []
        if name == "turns":
            rows, by = rows.withColumn("month", month_of(F.col("timestamp"))), ["month"]
            sizes = rows.groupBy("month").agg(F.sum(F.octet_length("content").cast("long")).alias("size"))
            rows = in_parts(rows, sizes, TURN_BYTES, ["session_id"]).repartition("month", "_part").drop("_part")
        rows = rows.sortWithinPartitions(*by, *ORDER[name]) if name in ORDER else rows
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{name}")
    a.spark.createDataFrame([(VERSION,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/version")


def from_tables(spark: SparkSession, sf_dir: str) -> Archive:
    """Customers as projects, orders as sessions, conversations as turns, events as tool calls."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key, cast = F.col("o_orderkey"), lambda c: c.cast("string")
    projects = read("customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("/"), "c_mktsegment", F.lit("/"), "c_name").alias("path"),
        F.col("c_name").alias("display_name"),
        F.col("c_mktsegment").alias("source"),
    )
    lines = read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("q"), F.sum("l_linenumber").cast("long").alias("ln")
    )
    n = F.coalesce("n", F.lit(0))
    sessions = read("orders").join(lines, "o_orderkey", "left").select(
        cast(key).alias("id"),
        F.col("o_custkey").alias("project_id"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        (F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=n)).alias("ended_at"),
        F.col("o_orderpriority").alias("model"),
        F.col("o_orderstatus").alias("source"),
        n.cast("long").alias("turn_count"),
        F.col("q").alias("input_tokens"),
        F.col("ln").alias("output_tokens"),
        F.when(key % 3 == 0, F.lit(0)).otherwise(F.col("q")).alias("cache_read_tokens"),
        F.when(key % 3 == 0, F.lit(0)).when(key % 7 == 0, F.lit(None)).otherwise(F.col("ln")).cast("long").alias("cache_write_tokens"),
        F.when(key % 10 == 0, cast(key - 1)).alias("parent_session_id"),
        F.concat(F.lit("/files/"), cast(key), F.lit(".jsonl")).alias("source_file"),
        (key % 4 == 0).alias("has_error"),
        (key % 10 == 9).alias("has_subagent"),
        F.concat(F.lit("t"), cast(n - 1)).alias("last_entry_uuid"),
    )
    turns = read("conversations").select(
        cast(F.col("conv_id")).alias("session_id"),
        F.concat(F.lit("t"), cast(F.col("turn"))).alias("id"),
        F.col("turn").alias("ordinal"),
        F.col("role").alias("type"),
        (F.lit(BASE).cast("timestamp") + F.make_interval(hours=F.col("conv_id").cast("int"), mins=F.col("turn").cast("int"))).alias("timestamp"),
        F.col("text").alias("content"),
    )
    event = F.col("event_id")
    tool_uses = read("events").select(
        event.alias("id"),
        cast(F.col("user_id")).alias("session_id"),
        F.concat(F.lit("t"), cast(event % 6)).alias("turn_id"),
        F.col("event_type").alias("tool_name"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("props").alias("input_json"),
        F.when(event % 11 != 0, F.col("event_type") == "error").alias("is_error"),
        F.concat(F.lit("/src/"), "event_type", F.lit("/"), cast(event % 50), F.lit(".py")).alias("file_path"),
        event.alias("turn_ordinal"),
        F.when(event % 7 == 0, F.lit("deploy failed")).otherwise(F.lit("ok")).alias("result_content"),
    )
    files = sessions.select(
        F.col("source_file").alias("path"), "source",
        F.when(F.col("id").cast("long") % 5 != 0, F.col("ended_at")).alias("mtime"),
    )
    return Archive(projects, sessions, turns, tool_uses, files)


#: The same views for the checking engine.
VIEWS_SQL = r"""WITH projects AS (SELECT c_custkey AS id, '/' || c_mktsegment || '/' || c_name AS path, c_name AS display_name,
    c_mktsegment AS source FROM customer),
order_lines AS (SELECT l_orderkey AS k, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q,
    CAST(sum(l_linenumber) AS BIGINT) AS ln FROM lineitem GROUP BY 1),
sessions AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey AS project_id, CAST(o_orderdate AS TIMESTAMP) AS started_at,
    CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(coalesce(n, 0) AS INTEGER)) AS ended_at, o_orderpriority AS model, o_orderstatus AS source,
    CAST(coalesce(n, 0) AS BIGINT) AS turn_count, q AS input_tokens, ln AS output_tokens,
    CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE q END AS cache_read_tokens,
    CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 7 = 0 THEN NULL ELSE ln END AS cache_write_tokens,
    CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_orderkey - 1 AS VARCHAR) END AS parent_session_id,
    '/files/' || o_orderkey || '.jsonl' AS source_file, o_orderkey % 4 = 0 AS has_error, o_orderkey % 10 = 9 AS has_subagent,
    't' || (coalesce(n, 0) - 1) AS last_entry_uuid
    FROM orders LEFT JOIN order_lines ON o_orderkey = k),
turns AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, 't' || turn AS id, turn AS ordinal, role AS type,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS timestamp, text AS content FROM conversations),
tool_uses AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS session_id, 't' || (event_id % 6) AS turn_id,
    event_type AS tool_name, CAST(ts AS TIMESTAMP) AS timestamp, props AS input_json,
    CASE WHEN event_id % 11 <> 0 THEN event_type = 'error' END AS is_error,
    '/src/' || event_type || '/' || (event_id % 50) || '.py' AS file_path, event_id AS turn_ordinal,
    CASE WHEN event_id % 7 = 0 THEN 'deploy failed' ELSE 'ok' END AS result_content FROM events),
source_files AS (SELECT source_file AS path, source, CASE WHEN CAST(id AS BIGINT) % 5 <> 0 THEN ended_at END AS mtime FROM sessions)
"""
