"""Query strings, periods, text queries and written forms."""

from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnlake.functions import blocks as bl
from turnlake.functions import fulltext as ft
from turnlake.functions import paths as pt
from turnlake.functions.periods import month_filter, month_of
from turnlake.functions.query_string import parse, parse_date
from turnlake.operators.export import compact_path, duration, fenced


def test_filters_leave_the_text():
    q = parse('fix Project:"my app" tool:Bash tool:Read has:toolerror see http://x.y now')
    assert (q.text, q.project, q.tool, q.has_tool_error) == ("fix     see  now", "my app", "Read", True)
    assert not q.is_empty and q.has_filters
    assert parse("").is_empty
    assert not parse("has:nothing").has_filters


@pytest.mark.parametrize("text", ["2026-10-01", "2026/10/01", "10/01/2026", "Oct 1, 2026", "October 1, 2026"])
def test_written_dates(text):
    assert parse_date(text) == datetime(2026, 10, 1, tzinfo=timezone.utc)


def test_named_dates_and_zones():
    zone = timezone(timedelta(hours=5, minutes=30))
    now = datetime(2026, 10, 5, 22, tzinfo=timezone.utc)
    assert parse_date("today", zone, now) == datetime(2026, 10, 6, tzinfo=zone)
    assert parse_date("thisweek", zone, now) == datetime(2026, 9, 29, tzinfo=zone)
    assert parse_date("someday") is None


@settings(deadline=None, max_examples=20)
@given(st.lists(st.one_of(st.none(), st.datetimes(datetime(2019, 11, 1), datetime(2021, 2, 1))), min_size=1, max_size=6), st.datetimes(datetime(2019, 11, 1), datetime(2021, 2, 1)), st.datetimes(datetime(2019, 11, 1), datetime(2021, 2, 1)))
def test_month_filter_keeps_every_candidate(spark, times, after, before):
    after, before = after.replace(tzinfo=timezone.utc), before.replace(tzinfo=timezone.utc)
    rows = spark.createDataFrame([(k, t and t.replace(tzinfo=timezone.utc)) for k, t in enumerate(times)], "k int, t timestamp")
    kept = {r.k for r in rows.withColumn("month", month_of(F.col("t"))).filter(month_filter(after, before)).collect()}
    assert {k for k, t in enumerate(times) if t is None or after < t.replace(tzinfo=timezone.utc) < before} <= kept
    assert month_filter(None, None) is None


@pytest.mark.parametrize(
    ("query", "hits"),
    [
        ("alpha", {1, 2, 4}), ("alpha beta", {1, 2}), ('"alpha beta"', {1}), ("alpha NOT beta", {4}), ("gamma OR delta", {3, 4}),
        ("(gamma OR delta) alpha", {4}), ("re-run", {3}), ("ÉTÉ", {5}), ("...", set()), ("NOT alpha", {3, 5}), ("(alpha", {1, 2, 4}),
    ],
)
def test_text_queries(spark, query, hits):
    rows = [(1, "Alpha, beta!"), (2, "beta alpha"), (3, "re-run gamma"), (4, "alpha delta"), (5, "l'été"), (6, None)]
    match = ft.compile_text(query)
    if match is None:
        assert not hits
        return
    found = spark.createDataFrame(rows, "id int, t string").filter(match(ft.tokens(F.col("t")))).collect()
    assert {r.id for r in found} - {6} == hits


def test_times(spark):
    rows = ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05.123456789+02:00", "2026-01-02 03:04:05 +0000 UTC m=+1.5", "2026-01-02", "soon", None]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(pt.rendered_time(pt.parsed_time(F.col("t"))).alias("t")).collect()
    assert [r.t for r in got] == [
        "2026-01-02T03:04:05.000000000Z", "2026-01-02T01:04:05.123456000Z", "2026-01-02T03:04:05.000000000Z", "2026-01-02T00:00:00.000000000Z", None, None,
    ]


def test_blocks_and_policy(spark):
    rows = [
        ("Bash", "plain"), ("Bash", '[{"type":"text","text":"a"},{"type":"text","text":"b"}]'), ("Bash", '[{"type":"image"}]'),
        ("Read", "secret file"), ("Bash", "x" * (128 * 1024 + 1)), ("Bash", ""), ("Bash", None), ("Bash", "[not json"),
    ]
    got = spark.createDataFrame(rows, "tool string, c string").select(bl.result_policy(F.col("tool"), F.col("c")).alias("p")).collect()
    assert [(r.p.content, r.p.reason) if r.p else None for r in got] == [
        ("plain", None), ("a\nb", None), (None, "image"), (None, "bulk_read"), (None, "oversize"), None, None, ("[not json", None),
    ]


def test_display_forms(spark):
    rows = spark.createDataFrame([(59, "a"), (3600, "b ``` c"), (3723, "x `````")], "s long, t string")
    got = rows.select(duration(F.col("s")).alias("d"), fenced(F.col("t")).alias("f")).collect()
    assert [r.d for r in got] == ["59s", "1h0m0s", "1h2m3s"]
    assert [r.f.split("\n")[0] for r in got] == ["```", "````", "``````"]
    assert compact_path("/home/u/projects/deep/down/file", 20) == "~/p/deep/down/file"


def test_accents_fold_as_decomposition_does(spark):
    words = ["Čeština", "Łódź", "ŐSZ", "Việt", "été", "İstanbul", "straße", ""]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(F.explode(ft.tokens(F.col("w")))).collect()
    assert [r[0] for r in got] == ["cestina", "łodz", "osz", "viet", "ete", "istanbul", "straße"]
    letters = [c for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if c.isalpha()]
    rows = spark.createDataFrame([(c,) for c in letters], "w string").select("w", ft.folded(F.col("w")).alias("f")).collect()
    for r in rows:
        assert ft._fold(r.w) == r.f
        plain = duckdb.execute("SELECT lower(strip_accents(?))", [r.w]).fetchone()[0]
        assert r.f == plain or not (r.f.isascii() or plain.isascii())
