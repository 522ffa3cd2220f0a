"""Search over turns: filters, text match, ranking, attribution and paging.

Filters on calls are semi joins, so that no filter multiplies turns. Text is
matched inside the scan; only hits move. A page is limited before anything is
looked up for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnlake.functions import fulltext as ft
from turnlake.functions.periods import month_filter
from turnlake.functions.query_string import Query
from turnlake.operators.text_index import TextIndex
from turnlake.sources.archive import Archive

KEYS = ["session_id", "id"]


def base(a: Archive) -> DataFrame:
    """Turns with their sessions, and with projects where there are any."""
    s = a.sessions.select(
        F.col("id").alias("session_id"), F.col("project_id"), F.col("model").alias("_model"), "has_error", "has_subagent", "source"
    )
    p = a.projects.select(F.col("id").alias("project_id"), F.col("path").alias("_path"), F.col("display_name").alias("_label"))
    return (
        a.turns.select(*KEYS, "ordinal", "type", "timestamp", "content").join(s, "session_id")
        .join(p, "project_id", "left")
        .select(
            "session_id", "id", "ordinal", "type", "timestamp", "content",
            F.coalesce("_path", F.lit("")).alias("project_path"), F.coalesce("_label", F.lit("")).alias("project_name"),
            F.coalesce("_model", F.lit("")).alias("model"), "has_error", "has_subagent", "source",
        )
    )


def payload_tokens() -> Column:
    """Tokens of a call's input and result; the element between them is no token, so that nothing reaches from one into the other."""
    return F.concat(ft.tokens(F.col("input_json")), F.array(F.lit(ft.BORDER)), ft.tokens(F.col("result_content")))


def calls_matching(a: Archive, text: str) -> DataFrame:
    """Keys of turns that own a call whose input and result match together."""
    match = ft.compile_text(text)
    return a.tool_uses.filter(match(payload_tokens())).select("session_id", F.col("turn_id").alias("id")).distinct()


def text_hits(a: Archive, text: str) -> DataFrame:
    """Keys of turns whose content matches, or that own a call whose input and result match together."""
    match = ft.compile_text(text)
    if match is None:
        return a.turns.select(*KEYS).limit(0)
    own = a.turns.filter(match(ft.tokens(F.col("content")))).select(*KEYS)
    return own.union(calls_matching(a, text)).distinct()


def with_text(a: Archive, turns: DataFrame, q: Query, index: TextIndex | None) -> DataFrame:
    """Those of the turns that a text matches: by the index, or by reading content and calls once each."""
    match = ft.compile_text(q.text)
    if match is None:
        return turns.limit(0)
    if index is not None:
        return turns.join(index.hits(q.text, q), KEYS, "left_semi")
    called = calls_matching(a, q.text).withColumn("_called", F.lit(True))
    return turns.join(called, KEYS, "left").filter(F.coalesce("_called", F.lit(False)) | match(ft.tokens(F.col("content")))).drop("_called")


def _contains(column: str, value: str):
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(value.lower()))


def matching(a: Archive, q: Query, index: TextIndex | None = None) -> DataFrame:
    """All turns that a query selects, in no order.

    Dates and the filters on sessions come first, so that text is only matched
    where they leave turns. Dates prune the months of stored turns.
    """
    turns, sessions = a.turns, a.sessions
    if "month" in turns.columns and (months := month_filter(q.after, q.before)) is not None:
        turns = turns.filter(months)
    if q.before:
        turns = turns.filter(F.col("timestamp") < F.lit(q.before))
    if q.after:
        turns = turns.filter(F.col("timestamp") > F.lit(q.after))
    if q.model:
        sessions = sessions.filter(_contains("model", q.model))
    if q.source:
        sessions = sessions.filter(F.col("source") == q.source)
    if q.has_error:
        sessions = sessions.filter("has_error")
    if q.has_subagent:
        sessions = sessions.filter("has_subagent")
    if q.tool or q.file:
        calls = a.tool_uses
        if q.tool:
            calls = calls.filter(F.lower("tool_name") == q.tool.lower())
        if q.file:
            calls = calls.filter(_contains("file_path", q.file))
        sessions = sessions.join(calls.select(F.col("session_id").alias("id")), "id", "left_semi")
    if q.model or q.source or q.has_error or q.has_subagent or q.tool or q.file:
        turns = turns.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    if q.text:
        turns = with_text(a, turns, q, index)
    if q.has_tool_error:
        # the pair is a turn's identity: one uuid can occur in two sessions
        failed = a.tool_uses.filter("is_error").select("session_id", F.col("turn_id").alias("id"))
        turns = turns.join(failed, KEYS, "left_semi")
    rows = base(a._replace(turns=turns))
    if q.project:
        rows = rows.filter(_contains("project_path", q.project) | _contains("project_name", q.project))
    return rows


def newest_first(rows: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """The newest rows, ties by id and session; unreadable times come last."""
    ordered = rows.orderBy(F.desc_nulls_last("timestamp"), "id", "session_id")
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def search(a: Archive, q: Query, limit: int = 20, index: TextIndex | None = None) -> DataFrame:
    return newest_first(matching(a, q, index), limit)


def page(a: Archive, q: Query, limit: int, offset: int, index: TextIndex | None = None) -> DataFrame:
    """A page with ``has_more`` and ``next_offset`` on every row; one row more is read."""
    rows = newest_first(matching(a, q, index), limit + 1, offset)
    by = Window.orderBy(F.desc_nulls_last("timestamp"), "id", "session_id")  # of limit + 1 rows
    numbered = rows.withColumn("_n", F.row_number().over(by)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy()))
    more = F.col("_all") > limit
    return (
        numbered.filter(F.col("_n") <= limit)
        .withColumn("has_more", more)
        .withColumn("next_offset", F.when(more, F.lit(offset + limit)))
        .drop("_n", "_all")
    )


def attributed(a: Archive, q: Query, limit: int = 20, index: TextIndex | None = None) -> DataFrame:
    """A page with the first matching call of each turn whose own content lacks the text, and the best snippet of either.

    Only the calls of the page's turns are read again.
    """
    rows = search(a, q, limit, index)
    match = ft.compile_text(q.text)
    if match is None:
        return rows.withColumn("matched_tool", F.lit(None).cast("string")).withColumn("snippet", ft.snippet(F.col("content"), q.text))
    calls = a.tool_uses.select("session_id", F.col("turn_id").alias("id"), "tool_name", "turn_ordinal", "input_json", "result_content")
    first = (
        rows.select(*KEYS).join(calls, KEYS).filter(match(payload_tokens())).groupBy(*KEYS)
        .agg(F.min_by(F.struct("tool_name", "input_json", "result_content"), "turn_ordinal").alias("_call"))
    )
    own = F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lit(q.text.lower()))
    best = ft.best_snippet([F.col("_call.input_json"), F.col("_call.result_content")], ft.terms_of(q.text))
    return rows.join(first, KEYS, "left").select(
        *rows.columns,
        F.when(~own, F.col("_call.tool_name")).alias("matched_tool"),
        F.when(own | F.col("_call").isNull(), ft.snippet(F.col("content"), q.text)).otherwise(best).alias("snippet"),
    )


def ranked(a: Archive, text: str, limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Turns whose content matches, by Okapi BM25.

    Corpus statistics are one pass of partial aggregates (two numbers and one
    per query term); nothing of the corpus is shuffled.
    """
    match, terms = ft.compile_text(text), ft.terms_of(text)
    docs = a.turns.select(*KEYS, ft.tokens(F.col("content")).alias("_t"))
    if match is None or not terms:
        return docs.select(*KEYS, F.lit(0.0).alias("score")).limit(0)
    counts = {t: F.size("_t") - F.size(F.array_remove("_t", t)) for t in terms}
    stats = docs.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.size("_t")).alias("length"),
        *[F.count_if(F.array_contains("_t", t)).alias(f"df{k}") for k, t in enumerate(terms)],
    ).first()
    score = F.lit(0.0)
    for k, t in enumerate(terms):
        idf = math.log(1 + (stats["n"] - stats[f"df{k}"] + 0.5) / (stats[f"df{k}"] + 0.5))
        tf = counts[t].cast("double")
        score = score + F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size("_t") / F.lit(stats["length"] or 1.0)))
    return docs.filter(match(F.col("_t"))).select(*KEYS, score.alias("score")).orderBy(F.desc("score"), "session_id", "id").limit(limit)


def date_bounds(a: Archive) -> DataFrame:
    """First and last day of the archive's turns."""
    day = F.date_format("timestamp", "yyyy-MM-dd")
    return a.turns.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def token_index(a: Archive) -> DataFrame:
    """Tokens of every turn, the index that integrity checks compare with the turns."""
    return a.turns.select(*KEYS, ft.tokens(F.col("content")).alias("tokens"))


def index_integrity(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows, indexed rows, rows missing from the index and index entries without a row."""
    left = rows.select(*KEYS).withColumn("_row", F.lit(1))
    right = index.select(*KEYS).withColumn("_entry", F.lit(1))
    return left.join(right, KEYS, "full").agg(
        F.count("_row").alias("n_rows"), F.count("_entry").alias("n_indexed"),
        F.count_if(F.col("_entry").isNull()).alias("n_missing"), F.count_if(F.col("_row").isNull()).alias("n_orphans"),
    )


def index_strict(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Keys whose indexed tokens differ from the text's, with what is wrong."""
    want = rows.select(*KEYS, ft.tokens(F.col("content")).alias("_want"))
    return (
        want.join(index.select(*KEYS, F.col("tokens").alias("_have")), KEYS, "full")
        .filter(~F.col("_want").eqNullSafe(F.col("_have")))
        .select(
            *KEYS,
            F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "orphan").otherwise("different").alias("fault"),
        )
    )


def project_matches(a: Archive, text: str) -> DataFrame:
    """Projects a written name can mean: an exact path alone, else substrings of path or label."""
    exact = a.projects.filter(F.col("path") == text)
    loose = a.projects.filter(_contains("path", text) | _contains("display_name", text))
    found = exact.withColumn("_p", F.lit(0)).unionByName(loose.withColumn("_p", F.lit(1)))
    best = found.withColumn("_b", F.min("_p").over(Window.partitionBy()))  # of the few that match
    return best.filter("_p = _b").drop("_p", "_b").orderBy("path")


def tool_names_like(a: Archive, text: str, limit: int = 10) -> DataFrame:
    return a.tool_uses.filter(_contains("tool_name", text)).select("tool_name").distinct().orderBy("tool_name").limit(limit)
