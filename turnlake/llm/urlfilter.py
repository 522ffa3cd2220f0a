"""URL filter by host-suffix and path-prefix rules (DataFrame operations only).

Every URL is expanded into (host suffix, path prefix) expressions. Expressions
meet the rules in an equi-join on a short prefix of their SHA-256 digest, full
digests confirm the match, and the longest rule decides.

Defined results: a null URL, or one without ``://``, has an empty host and an
empty path; it matches no rule and gets the default verdict. Repeated rows are
judged each on its own. An empty table gives an empty result. Columns other
than the id and the URL are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = "host string, path string, action string"
#: Rules are broadcast up to this many; beyond it the join is left to shuffle.
BROADCAST_RULES = 200_000
#: Hexadecimal digits of the digest that the join compares.
SHORT_DIGITS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (host, path with its leading slash, allow or block)."""
    return spark.createDataFrame(rules, RULE_SCHEMA)


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column, most: int | None = None) -> Column:
    """The host and every parent domain of it; with ``most``, only those of so many labels at most."""
    labels = F.split(host, r"\.", -1)
    first = F.lit(1) if most is None else F.greatest(F.size(labels) - F.lit(most - 1), F.lit(1))
    return F.transform(
        F.sequence(first, F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """id, host, path, rule (null where none fits) and verdict of each row.

    The expansion uses the distinct path lengths of the rules only; there are
    never more of them than the longest rule path has characters. Of a host, only
    suffixes with as many labels as some rule's host can match and are made, so
    that a host of any length costs no more than that. Distinct (host, path)
    pairs are judged once, so that a hot URL costs one row.
    """
    rule = rules.select(
        F.concat("host", "path").alias("rule"),
        F.col("action").alias("rule_action"),
        F.length("path").alias("path_length"),
        F.size(F.split("host", r"\.", -1)).alias("labels"),
        F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("rule_digest"),
    )
    rule = rule.groupBy("rule", "rule_digest").agg(
        F.max("rule_action").alias("rule_action"), F.max("path_length").alias("path_length"), F.max("labels").alias("labels")
    )  # of equal rules a block wins
    rule = rule.withColumn("short", F.substring("rule_digest", 1, SHORT_DIGITS))
    lengths, known, most = rule.agg(
        F.sort_array(F.collect_set("path_length")), F.count(F.lit(1)), F.coalesce(F.max("labels"), F.lit(1))
    ).first()
    rule = rule.drop("labels", "path_length")
    if known <= BROADCAST_RULES:
        rule = F.broadcast(rule)

    split = pages.select(
        F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    )
    size = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    expressions = (
        split.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(host_suffixes(F.col("host"), most)).alias("suffix"))
        .select(
            "host", "path", "suffix",
            F.explode(F.filter(size, lambda n: n <= F.length("path"))).alias("cut"),
        )
        .select(
            "host", "path",
            F.sha2(F.concat_ws("\n", "suffix", F.expr("substring(path, 1, cut)")), 256).alias("digest"),
        )
        .withColumn("short", F.substring("digest", 1, SHORT_DIGITS))
    )
    best = (
        expressions.join(rule, "short")
        .filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule_action", "rule")).alias("best"))
    )
    return split.join(best, ["host", "path"], "left").select(
        id_col, "host", "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.rule_action"), F.lit(default)).alias("verdict"),
    )
