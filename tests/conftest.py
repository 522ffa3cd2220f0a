"""One local session for all tests; other settings than the tests' own stay as Spark has them."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return str(DATA)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in sorted(DATA.glob("*.parquet")):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(value):
    """A value as both engines should give it."""
    import datetime

    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.fixture(scope="session")
def compare(spark, data, duck):
    def run(build, sql):
        frame = build(spark, data)
        names = sorted(frame.columns)
        mine = sorted((tuple(plain(r[c]) for c in names) for r in frame.collect()), key=repr)
        found = duck.sql(sql)
        assert sorted(found.columns) == names
        at = [found.columns.index(c) for c in names]
        theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
        assert mine == theirs

    return run
