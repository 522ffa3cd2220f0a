"""The user's view, over the small tables."""

import pytest
from pyspark.sql import functions as F

from turnlake.api import Lake, page_size
from turnlake.operators.writes import check_mergeable, turn_replace
from turnlake.sources.archive import from_tables


@pytest.fixture(scope="module")
def lake(spark, data, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lake"))
    Lake(from_tables(spark, data)).save(folder)
    return Lake.open(spark, folder)


def test_pages():
    assert [page_size("search", n) for n in (None, 0, 7, 900)] == [10, 10, 7, 50]


def test_methods_give_rows(lake):
    assert 0 < lake.search("the", 5).count() <= 5
    assert lake.search_with_calls("deploy", 3).count() <= 3
    assert lake.ranked("the").columns == ["session_id", "id", "score"]
    assert lake.turns("1").count() > 0 and lake.session("1").count() == 1
    assert lake.sessions().count() == 20 and lake.projects().count() == 50
    assert lake.markdown("1").count() == 1
    assert all(f.count() >= 0 for f in {**lake.stats(), **lake.analytics()}.values())


def test_merging_with_itself_changes_nothing(lake):
    merged = lake.merged(Lake(lake.archive)).archive
    for name, rows in zip(lake.archive._fields, lake.archive, strict=True):
        assert getattr(merged, name).count() == rows.count(), name


def test_unfit_archives_are_refused(lake):
    bare = lake.archive._replace(turns=lake.archive.turns.drop("id"))
    with pytest.raises(ValueError, match="turns"):
        check_mergeable(lake.archive, bare)
    with pytest.raises(ValueError, match="version"):
        check_mergeable(lake.archive, lake.archive, incoming_version=99)
    check_mergeable(lake.archive, lake.archive, incoming_version=99, force=True)


def test_an_ordinal_twice_is_an_error(lake):
    turns = lake.archive.turns
    with pytest.raises(Exception, match="ordinal twice"):
        turn_replace(turns, turns.unionByName(turns.limit(3))).collect()


def test_merge_with_colliding_project_ids(spark, data):
    from pyspark.sql import functions as F

    from turnlake.operators import search
    from turnlake.operators.writes import merge
    from turnlake.sources.archive import Archive, from_tables

    a = from_tables(spark, data)
    other = lambda frame, column: frame.withColumn(column, F.concat(F.col(column).cast("string"), F.lit("-b")))
    b = Archive(other(a.projects, "path"), other(a.sessions, "id"), other(a.turns, "session_id"), other(a.tool_uses, "session_id"), a.source_files)
    m = merge(a, b)
    assert m.projects.count() == m.projects.select("id").distinct().count() == 2 * a.projects.count()
    assert search.base(m).count() == m.turns.count() == 2 * a.turns.count()
    known = {r.id for r in a.turns.collect()}
    assert m.sessions.count() == 2 * a.sessions.count() and m.tool_uses.count() == 2 * sum(r.turn_id in known for r in a.tool_uses.collect())
    path = m.sessions.join(m.projects.select(F.col("id").alias("project_id"), "path"), "project_id")
    assert path.filter(F.col("id").endswith("-b") != F.col("path").endswith("-b")).isEmpty()


def test_phrases_do_not_reach_from_input_into_result(spark, data):
    from pyspark.sql import functions as F

    from turnlake.operators import search
    from turnlake.sources.archive import from_tables

    a = from_tables(spark, data)
    calls = a.tool_uses.limit(1).withColumn("input_json", F.lit("zeta alpha")).withColumn("result_content", F.lit("beta omega"))
    a = a._replace(tool_uses=calls) if hasattr(a, "_replace") else type(a)(a.projects, a.sessions, a.turns, calls, a.source_files)
    hits = [search.text_hits(a, q).count() for q in ('"alpha beta"', '"zeta alpha"', '"beta omega"', "alpha beta")]
    assert hits == [0, 1, 1, 1]


def test_merged_calls(spark):
    from turnlake.operators.writes import merge
    from turnlake.sources.archive import Archive

    frame = spark.createDataFrame
    sessions = lambda *rows: frame(rows, "id string, project_id long, ended_at string, source_file string, last_entry_uuid string").withColumn("ended_at", F.col("ended_at").cast("timestamp"))
    turns = lambda *rows: frame(rows, "session_id string, id string, ordinal long, content string")
    call = "id long, session_id string, turn_id string, turn_ordinal long, tool_use_id string, tool_name string, input_json string, result_length long"
    files = lambda *rows: frame(rows, "path string, source string")
    projects = frame([(1, "/p")], "id long, path string")
    a = Archive(projects, sessions(("s1", 1, "2026-01-01", "/f1", "t1")), turns(("s1", "t1", 0, "old"), ("s1", "gone", 1, "x")),
                frame([(1, "s1", "t1", 0, "k1", "Bash", "{}", 1), (2, "s9", "gone", 0, "k2", "Bash", "{}", 1), (3, "s9", None, 0, None, "Bash", None, None)], call), files(("/f1", "x")))
    incoming = [
        (1, "s1", "t1", 0, "k1", "Bash", "{}", 1), (2, "s1", "t1", 0, "k5", "Read", "{}", 1), (3, "s1", "t1", 0, "k1", "Bash", "{}", 1),  # zeros, and one twice
        (4, "s2", "t3", 0, None, "Bash", None, None), (5, "s2", "t3", 0, None, "Bash", None, None), (6, "s1", "t3", 7, "k6", "Bash", "{}", 1),  # filed under another session
        (7, "s1", "nowhere", 0, "k7", "Bash", "{}", 1), (8, "s3", "t1", 0, "k8", "Bash", "{}", 1),  # no turn; a session that is not taken
    ]
    b = Archive(frame([(1, "/q"), (2, "/p")], "id long, path string"), sessions(("s1", 2, "2026-02-01", "/f2", None), ("s2", 1, "2026-01-01", "/f3", None)), turns(("s1", "t1", 0, "new"), ("s2", "t3", 0, "y"), ("s2", "t4", 1, "z")),
                frame(incoming, call), files(("/f2", "x"), ("/f3", "x"), ("/other", "x")))
    m = merge(a, b)
    got = sorted((r.session_id, r.turn_id or "", r.turn_ordinal, r.tool_use_id or "", r.tool_name) for r in m.tool_uses.collect())
    assert got == [("s1", "t1", 0, "k1", "Bash"), ("s1", "t1", 1, "k5", "Read"), ("s2", "t3", 0, "", "Bash"), ("s2", "t3", 7, "k6", "Bash"), ("s9", "", 0, "", "Bash")]
    assert m.tool_uses.select("id").distinct().count() == m.tool_uses.count()
    assert {r.id: r.last_entry_uuid for r in m.sessions.collect()} == {"s1": "t1", "s2": "t4"}
    assert {r.path for r in m.source_files.collect()} == {"/f1", "/f2", "/f3"}
    paths = {r.id: r.path for r in m.sessions.select("id", "project_id").join(m.projects.withColumnRenamed("id", "project_id"), "project_id").collect()}
    assert paths == {"s1": "/p", "s2": "/q"}
    bare = b._replace(tool_uses=b.tool_uses.drop("turn_ordinal", "input_json"), turns=b.turns.drop("ordinal").withColumn("timestamp", F.lit("2026-01-01").cast("timestamp")))
    n = merge(a, bare)
    assert sorted((r.session_id, r.id, r.ordinal) for r in n.turns.collect()) == [("s1", "t1", 0), ("s2", "t3", 0), ("s2", "t4", 1)]
    # without what tells calls apart all come, with positions in their order
    assert sorted((r.session_id, r.turn_ordinal) for r in n.tool_uses.filter("turn_id is not null").collect()) == [("s1", 0), ("s1", 1), ("s1", 2), ("s2", 0), ("s2", 1), ("s2", 2)]


def test_versions_of_folders(spark, lake, tmp_path):
    from turnlake.sources import archive

    folder = str(tmp_path / "new")
    lake.save(folder)
    again = Lake.open(spark, folder)
    assert again.version == archive.VERSION
    with pytest.raises(ValueError, match="itself"):
        again.merged(Lake.open(spark, folder + "/"))
    spark.createDataFrame([(archive.VERSION + 1,)], "version int").write.mode("overwrite").parquet(f"{folder}/version")
    with pytest.raises(ValueError, match="version"):
        Lake.open(spark, folder)
    with pytest.raises(ValueError, match="version"):
        lake.save(folder)
