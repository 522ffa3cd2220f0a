"""Calendar months as partitions of turns and of what is indexed for them.

A row's month is a number, yyyymm in UTC, and NO_MONTH where its time cannot be
read. A range of instants becomes a range of months; rows without a month stay
candidates, and the exact comparison decides them.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_MONTH = 0


def month_of(time: Column) -> Column:
    """The month of an instant, in UTC whatever the session's zone is."""
    utc = F.to_utc_timestamp(time, F.current_timezone())
    return F.coalesce(F.year(utc) * 100 + F.month(utc), F.lit(NO_MONTH)).cast("int")


def month_number(bound: datetime) -> int:
    utc = bound.astimezone(timezone.utc) if bound.tzinfo else bound
    return utc.year * 100 + utc.month


def month_filter(after: datetime | None, before: datetime | None, column: str = "month") -> Column | None:
    """A filter on the partition column that keeps all rows of (after, before); None where neither bound is given."""
    inside = None
    for bound, keep in ((after, F.col(column).__ge__), (before, F.col(column).__le__)):
        if bound is not None:
            kept = keep(month_number(bound))
            inside = kept if inside is None else inside & kept
    return None if inside is None else (F.col(column) == NO_MONTH) | inside


def in_parts(rows: DataFrame, sizes: DataFrame, most: int, by: list[str], column: str = "_part") -> DataFrame:
    """The rows with a part of their month, by a hash of some columns: as many parts as the month's size is times ``most``.

    ``sizes`` has (month, size), one row a month; so files grow in number with what they hold.
    """
    parts = sizes.select("month", F.greatest(F.ceil(F.col("size") / most), F.lit(1)).alias("_parts"))
    met = rows.join(F.broadcast(parts), "month", "left")
    return met.withColumn(column, F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1)))).drop("_parts")
