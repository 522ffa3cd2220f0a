"""The stored text index against reading all texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from turnlake.api import Lake
from turnlake.functions import fulltext as ft
from turnlake.functions.query_string import parse
from turnlake.operators import search
from turnlake.operators.text_index import TextIndex
from turnlake.sources.archive import Archive, from_parquet, to_parquet

WORDS = ["alpha", "beta", "gamma", "delta", "re-run", "Été", "x1"]


def archive(spark, seed=1, sessions=12, rows=6):
    rng = random.Random(seed)
    text = lambda n: None if rng.random() < 0.05 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, n)))
    turns, calls = [], []
    for s in range(sessions):
        for k in range(rows):
            time = None if rng.random() < 0.2 else f"2025-{rng.randint(1, 4):02d}-{rng.randint(1, 28):02d} 10:00:00"
            turns.append((f"s{s}", f"t{k}", k, "user", time, text(12)))
            calls += [(f"s{s}", f"t{k}", n, "Bash", text(5), text(5), False, "/f") for n in range(rng.randint(0, 2))]
    calls += [("s0", "no turn", 0, "Bash", "alpha", "beta", False, "/f")]
    t = spark.createDataFrame(turns, "session_id string, id string, ordinal long, type string, timestamp string, content string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    c = spark.createDataFrame(calls, "session_id string, turn_id string, turn_ordinal long, tool_name string, input_json string, result_content string, is_error boolean, file_path string")
    p = spark.createDataFrame([(1, "/p", "p", "x")], "id int, path string, display_name string, source string")
    s = spark.createDataFrame([(f"s{k}", 1, "m", k % 2 == 0, False, "x") for k in range(sessions)], "id string, project_id int, model string, has_error boolean, has_subagent boolean, source string")
    return Archive(p, s, t, c, spark.createDataFrame([], "path string, source string, mtime timestamp"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("indexed"))
    to_parquet(archive(spark), folder)
    a = from_parquet(spark, folder)
    return folder, a, TextIndex(spark, f"{folder}/text_index").rebuild(a, buckets=4)


def keys(frame):
    return sorted((r.session_id, r.id) for r in frame.select("session_id", "id").collect())


@pytest.mark.parametrize(
    "text",
    ["alpha", "alpha beta", '"alpha beta"', "alpha OR x1", "alpha NOT beta", "NOT alpha", "re-run", "(gamma OR delta) NEAR(alpha beta, 2)", "NEAR(alpha été)", "ete", "nothing", "NOT nothing"],
)
def test_index_answers_as_the_texts_do(stored, text):
    _, a, index = stored
    # calls without a turn are no documents of the index
    assert keys(index.hits(text)) == keys(search.text_hits(a._replace(tool_uses=a.tool_uses.filter("turn_id <> 'no turn'")), text))


@pytest.mark.parametrize("line", ["alpha", "alpha after:2025-02-01", "beta before:2025-03-10 has:error", "NOT alpha after:2025-02-10 before:2025-03-20", "tool:bash x1 after:2024-01-01"])
def test_search_by_index(stored, line):
    _, a, index = stored
    assert keys(search.matching(a, parse(line), index)) == keys(search.matching(a, parse(line)))


def near_brute(tokens, phrases, gap):
    starts = [[k for k in range(len(tokens)) if tokens[k : k + len(p)] == p] for p in phrases]
    for last in (x for s in starts for x in s):
        if all(any(last - len(p) - gap <= x <= last for x in s) for p, s in zip(phrases, starts, strict=True)):
            return True
    return False


def test_near(spark):
    rng = random.Random(8)
    rows = [(k, [rng.choice("abcd") for _ in range(rng.randint(0, 14))]) for k in range(150)]
    frame = spark.createDataFrame(rows, "k int, t array<string>")
    for line, phrases, gap in (("NEAR(a b, 1)", [["a"], ["b"]], 1), ('NEAR("a b" c d,0)', [["a", "b"], ["c"], ["d"]], 0), ("NEAR(a d)", [["a"], ["d"]], 10), ("NEAR(b b, 2)", [["b"], ["b"]], 2)):
        got = {r.k for r in frame.filter(ft.compile_text(line)(F.col("t"))).collect()}
        assert got == {k for k, t in rows if near_brute(t, phrases, gap)}, line


def test_dates_prune_partitions(stored):
    _, a, index = stored
    q = parse("alpha after:2025-02-01 before:2025-02-20")
    plan = search.matching(a, q, index)._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert any("month" in f and "bucket" in f for f in found), found  # postings
    assert any("month" in f and "bucket" not in f for f in found), found  # turns
    # a turn without a time stays where it can be found, in the month of no time
    undated = a.turns.filter("timestamp is null and content is not null")
    assert undated.count() and undated.filter("month <> 0").isEmpty()
    assert set(keys(undated)) <= set(keys(search.matching(a, parse("NOT nothing"), index)))


def test_replaced_sessions(spark, stored, tmp_path):
    folder, a, _ = stored
    index = TextIndex(spark, str(tmp_path / "index")).rebuild(a, buckets=4)
    turns = a.turns.filter("session_id <> 's1'").withColumn("content", F.when(F.col("session_id") == "s2", "fresh words").otherwise(F.col("content")))
    calls = a.tool_uses.filter("session_id <> 's1'")
    more = a.turns.filter("session_id = 's3'").withColumn("session_id", F.lit("new"))
    b = a._replace(turns=turns.unionByName(more), tool_uses=calls)
    assert index.strict(b).filter("session_id in ('s1', 's2', 'new')").count() > 0
    touched = spark.createDataFrame([("s1",), ("s2",), ("new",)], "session_id string")
    index.replace(b, touched)
    again = TextIndex(spark, str(tmp_path / "index"))
    assert len(again.generations) == 2 and again.strict(b).isEmpty()
    assert all(r.n_missing == r.n_orphans == 0 for r in again.integrity(b).collect())
    assert [k for k in keys(again.hits("alpha")) if k[0] == "s1"] == [] and len(keys(again.hits("fresh"))) == a.turns.filter("session_id = 's2'").count()
    # a lost run leaves a folder that nobody lists: nothing changes, and the next run takes its place
    b.turns.limit(1).write.parquet(str(tmp_path / "index" / "documents" / "generation=3"))
    assert TextIndex(spark, str(tmp_path / "index")).generations == [1, 2]
    again.replace(a, touched)
    assert again.generations == [1, 2, 3] and again.strict(a.__class__(*a)._replace(turns=a.turns)).isEmpty()
    assert index.rebuild(a).generations == [4] and index.strict(a).isEmpty()


def test_lake_with_index(spark, stored, tmp_path):
    _, a, _ = stored
    folder = str(tmp_path / "lake")
    Lake(a).save(folder, index=True)
    lake, plain = Lake.open(spark, folder), Lake(a)
    assert lake.index is not None
    assert lake.search("alpha", 50).collect() == plain.search("alpha", 50).collect()
    assert [(r.id, r.matched_tool, r.snippet) for r in lake.search_with_calls("x1", 30).collect()] == [(r.id, r.matched_tool, r.snippet) for r in plain.search_with_calls("x1", 30).collect()]
    assert [(r.session_id, r.id, round(r.score, 6)) for r in lake.ranked("alpha beta", 40).collect()] == [(r.session_id, r.id, round(r.score, 6)) for r in plain.ranked("alpha beta", 40).collect()]


def test_best_snippet(spark):
    rows = [("one two three", "beta"), ("a " * 30 + "beta x alpha y " + "z " * 40, None), ("no match", None), ("É́té Beta!", "alpha beta")]
    frame = spark.createDataFrame(rows, "a string, b string")
    got = [r.s for r in frame.select(ft.best_snippet([F.col("a"), F.col("b")], ["alpha", "beta"], 6).alias("s")).collect()]
    assert got == ["beta", "…a beta x alpha y z…", None, "alpha beta"]


def test_files_follow_the_tokens(spark, stored, tmp_path):
    _, a, _ = stored
    TextIndex(spark, str(tmp_path / "few")).rebuild(a)
    months = a.turns.select("month").distinct().count()
    assert len(list((tmp_path / "few").glob("postings/*/*/*/*.parquet"))) == months
    to_parquet(a._replace(turns=a.turns.drop("month")), str(tmp_path / "archive"))
    assert len(list((tmp_path / "archive").glob("turns/*/*.parquet"))) == months


def test_repeated_documents_share_postings(spark, stored, tmp_path):
    _, a, _ = stored
    twice = a._replace(turns=a.turns.unionByName(a.turns.filter("session_id = 's2'").withColumn("content", F.lit("alpha other alpha"))))
    index = TextIndex(spark, str(tmp_path / "index")).rebuild(twice)
    want = {}
    for r in twice.turns.select("session_id", "id", ft.tokens(F.col("content")).alias("t")).collect():
        for k, w in enumerate(r.t):
            want.setdefault((r.session_id, r.id, w), []).append(k)
    found = index._tables.live("postings").filter("kind = 'content'").collect()
    assert sorted((r.session_id, r.id, r.word, r.positions) for r in found) == sorted((*k, sorted(v)) for k, v in want.items())
    assert index.strict(twice).isEmpty() and not index.strict(a).isEmpty()
