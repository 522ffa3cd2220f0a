"""Tables that change by whole keys, with one switch for all of them.

Below a folder, every run writes its rows of each table into ``<table>/generation=n``
and the keys it speaks for into ``touched/generation=n``. It counts from the moment
its row is in ``generations``, written last and as one file, so that a lost run
changes nothing and the next one takes its place. Of a key, only the rows of the
newest generation that touched it are read: a key that was touched and has no rows
is gone. There is one writer at a time; readers keep what was there when they opened.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


class Generations:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.refresh()

    def refresh(self) -> None:
        try:
            rows = self.spark.read.parquet(f"{self.folder}/generations").orderBy("generation").collect()  # one row a run
        except AnalysisException:
            rows = []
        start = max((r.generation for r in rows if r.whole), default=0)
        self.numbers = [r.generation for r in rows if r.generation >= start]
        self.note = rows[-1].note if rows else None
        self._last = rows[-1].generation if rows else 0

    def _stored(self, name: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/generation={g}" for g in self.numbers])

    def live(self, name: str, key: str = "session_id", scope: str = "session", schema: str | None = None) -> DataFrame:
        """Rows of a table that belong to the newest generation of their key; columns of the schema that a generation lacks are null."""
        rows = self._stored(name, schema)
        if len(self.numbers) == 1:
            return rows
        newest = self._stored("touched").filter(F.col("scope") == scope).groupBy(F.col("key").alias(key)).agg(F.max("generation").alias("generation"))
        return rows.join(newest, [key, "generation"], "left_semi")

    def write(
        self, tables: dict[str, tuple[DataFrame | Callable[[dict[str, DataFrame]], DataFrame], list[str]]], touched: DataFrame,
        whole: bool = False, note: str | Callable[[], str] | None = None,
    ) -> None:
        """One generation: (rows, partition columns) of each table, and (scope, key) of all that it speaks for.

        Rows can be a function of the tables of this generation that were written before them, by name; a note
        that is a function is asked last.
        """
        self.refresh()  # another handle may have written
        generation, done = self._last + 1, {}
        for name, (rows, by) in {**tables, "touched": (touched.select("scope", "key").distinct(), [])}.items():
            rows = rows(done) if callable(rows) else rows
            rows.write.mode("overwrite").partitionBy(*by).parquet(place := f"{self.folder}/{name}/generation={generation}")
            done[name] = self.spark.read.schema(rows.schema).parquet(place)
        note = note() if callable(note) else note
        listed = self.spark.createDataFrame([(generation, whole, note or self.note)], "generation int, whole boolean, note string")
        listed.coalesce(1).write.mode("append").parquet(f"{self.folder}/generations")
        self.refresh()


def keys(rows: DataFrame, column: str = "session_id", scope: str = "session") -> DataFrame:
    """(scope, key) of a column, for ``Generations.write``."""
    return rows.select(F.lit(scope).alias("scope"), F.col(column).cast("string").alias("key"))
