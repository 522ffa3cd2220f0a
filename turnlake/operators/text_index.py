"""A stored inverted index over turns and their calls.

On disk, below one folder:

* ``postings``: a row for each word of a document, with its positions; partitioned
  by generation, month and bucket, the bucket being a hash of the word. Buckets and
  files are as many as the tokens of a month call for.
* ``documents``: a row for each document with its number of tokens; partitioned by
  generation and month.
* ``touched`` and ``generations``: see ``turnlake.sources.generations``.

A document is the content of a turn, or a call with its input and result; the
call's month is its turn's. Positions of a result begin at RESULT, so that no
phrase and no NEAR reaches from the input into it. Replacing sessions writes these
sessions and nothing else; ``rebuild`` writes everything anew as one generation.

A search reads the buckets of its words, in the months of its dates. It meets
postings by document only if it has several words. Queries that also match
documents without any of their words (``NOT a``) start from ``documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions import fulltext as ft
from turnlake.functions.periods import in_parts, month_filter, month_of
from turnlake.functions.query_string import Query
from turnlake.sources.archive import Archive
from turnlake.sources.generations import Generations, keys

CONTENT, CALL = "content", "call"
#: The first position of a result's tokens.
RESULT = 1 << 30
#: Most buckets, and tokens of a month for each on average where there are fewer.
BUCKETS, BUCKET_TOKENS = 64, 1 << 21
#: Tokens of a part of a month's bucket, so that no frequent word is one task's.
PART_TOKENS = 1 << 19
KEYS = ["session_id", "id"]
_DOC = ["kind", "session_id", "id", "call"]


def documents_of(a: Archive) -> DataFrame:
    """(kind, session_id, id, call, month, t0, t1): tokens of every turn, and of every call whose turn there is."""
    none = F.array().cast("array<string>")
    turns = a.turns.select("session_id", "id", month_of(F.col("timestamp")).alias("month"), "content")
    own = turns.select(F.lit(CONTENT).alias("kind"), *KEYS, F.lit(None).cast("long").alias("call"), "month", ft.tokens(F.col("content")).alias("t0"), none.alias("t1"))
    calls = a.tool_uses.select("session_id", F.col("turn_id").alias("id"), F.col("turn_ordinal").cast("long").alias("call"), "input_json", "result_content")
    calls = calls.join(turns.select(*KEYS, "month"), KEYS)
    return own.unionByName(
        calls.select(F.lit(CALL).alias("kind"), *KEYS, "call", "month", ft.tokens(F.col("input_json")).alias("t0"), ft.tokens(F.col("result_content")).alias("t1"))
    )


def _occurrences(first: Column, second: Column) -> Column:
    """(word, positions) of each distinct word of a document, from its tokens in order of words."""
    at = lambda c, start: F.transform(c, lambda w, k: F.struct(w.alias("word"), (k + start).cast("int").alias("at")))
    bound = lambda c, use: F.get(F.transform(F.array(c), use), F.lit(0))  # noqa: E731  evaluated once

    def grouped(tokens: Column) -> Column:
        new = F.transform(tokens, lambda t, k: F.struct(t["word"].alias("word"), k.alias("k"), (~t["word"].eqNullSafe(F.get(tokens, k - 1)["word"])).alias("new")))
        heads = F.filter(new, lambda h: h["new"])
        length = lambda hs, h, j: F.coalesce(F.get(hs, j + 1)["k"], F.size(tokens)) - h["k"]
        places = lambda hs, h, j: F.transform(F.slice(tokens, h["k"] + 1, length(hs, h, j)), lambda t: t["at"])
        return bound(heads, lambda hs: F.transform(hs, lambda h, j: F.struct(h["word"].alias("word"), places(hs, h, j).alias("positions"))))

    return bound(F.sort_array(F.concat(at(first, 0), at(second, RESULT))), grouped)


def repeats(documents: DataFrame) -> bool:
    """Whether a document occurs more than once."""
    return not documents.groupBy(*_DOC).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def postings_of(documents: DataFrame, buckets: int, merged: bool, sizes: DataFrame | None = None) -> DataFrame:
    """A row for each word of each document; documents that repeat are ``merged``.

    With ``sizes`` (tokens of a bucket by month), rows are laid out by month and
    bucket in one shuffle, each bucket in parts by turn; a word of a document
    stays in one part.
    """
    dealt = ["month", "bucket"] if sizes is None else ["month", "bucket", "_part"]
    documents = documents if sizes is None else in_parts(documents, sizes, PART_TOKENS, KEYS)
    words = documents.withColumn("e", F.explode(_occurrences(F.col("t0"), F.col("t1")))).select("e.*", *_DOC, *[c for c in dealt if c != "bucket"])
    words = words.withColumn("bucket", bucket_of(F.col("word"), buckets))
    words = words if sizes is None else words.repartition(*dealt)
    if merged:
        words = words.groupBy("word", *_DOC, *dealt).agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return words.select("word", *_DOC, "positions", "month", "bucket")


def bucket_of(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


class TextIndex:
    """An index below a folder; generations are read when it is opened or changed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._tables = spark, Generations(spark, folder)

    @property
    def exists(self) -> bool:
        return bool(self.generations)

    @property
    def generations(self) -> list[int]:
        return self._tables.numbers

    @property
    def buckets(self) -> int:
        return int(self._tables.note or BUCKETS)

    def _write(self, a: Archive, sessions: DataFrame, whole: bool, buckets: int | None) -> TextIndex:
        documents = documents_of(a)
        counted = documents.select(*_DOC, "month", (F.size("t0") + F.size("t1")).alias("n_tokens"))
        chosen = buckets

        def postings(written: dict[str, DataFrame]) -> DataFrame:
            nonlocal chosen
            months = written["documents"].groupBy("month").agg(F.sum(F.col("n_tokens").cast("long")).alias("tokens"))
            if chosen is None:
                mean = months.agg(F.avg("tokens")).first()[0] or 0
                chosen = max(1, min(BUCKETS, math.ceil(mean / BUCKET_TOKENS)))
            sizes = months.select("month", (F.col("tokens") / chosen).alias("size"))
            # rows in order, so that a word is found by the files' statistics
            return postings_of(documents, chosen, repeats(written["documents"]), sizes).sortWithinPartitions("month", "bucket", "word")

        tables = {"documents": (counted, ["month"]), "postings": (postings, ["month", "bucket"])}
        self._tables.write(tables, keys(sessions), whole, lambda: str(chosen))
        return self

    def rebuild(self, a: Archive, buckets: int | None = None) -> TextIndex:
        """The index as a function of the archive alone, as one generation; its buckets follow from its tokens unless they are given."""
        return self._write(a, a.turns.select("session_id"), True, buckets)

    def replace(self, a: Archive, sessions: DataFrame) -> TextIndex:
        """Index the given sessions as the archive has them now; those it has no more leave the index."""
        touched = sessions.select("session_id").distinct()
        mine = a._replace(turns=a.turns.join(touched, "session_id", "left_semi"), tool_uses=a.tool_uses.join(touched, "session_id", "left_semi"))
        return self._write(mine, touched, False, self.buckets)

    # -- searching

    def _postings(self, words: list[str], q: Query | None) -> DataFrame:
        rows = self._tables.live("postings")
        wanted = self.spark.range(1).select(*[bucket_of(F.lit(w), self.buckets).alias(f"b{k}") for k, w in enumerate(words)]).first()
        rows = rows.filter(F.col("bucket").isin(*set(wanted)) & F.col("word").isin(*words))
        months = month_filter(q.after, q.before) if q else None
        return rows if months is None else rows.filter(months)

    def matches(self, text: str, q: Query | None = None) -> DataFrame:
        """(kind, session_id, id, call) of every document that a text query matches, in the months of q's dates."""
        tree = ft.parse_text(text)
        if tree is None:
            return self._tables.live("documents").select(*_DOC).limit(0)
        words = ft.words_of(tree)
        rows = self._postings(words, q)
        if isinstance(tree, ft.Phrase) and len(words) == 1:
            return rows.select(*_DOC)
        places = {w: f"p{k}" for k, w in enumerate(words)}
        found = rows.groupBy(*_DOC).agg(*[F.first(F.when(F.col("word") == w, F.col("positions")), ignorenulls=True).alias(c) for w, c in places.items()])
        if bool(ft.evaluated(tree, lambda leaf: _Plain(False))):  # matches documents without any of the words
            months = month_filter(q.after, q.before) if q else None
            every = self._tables.live("documents")
            every = every if months is None else every.filter(months)
            same = [F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}")) for c in _DOC]
            found = every.alias("e").join(found.alias("f"), same, "left").select(*[f"e.{c}" for c in _DOC], *places.values())
        empty = F.array().cast("array<int>")
        at = lambda word: F.coalesce(F.col(places[word]), empty)

        def leaf(node: ft.Phrase | ft.Near) -> Column:
            return ft.near_matches(node, at) if isinstance(node, ft.Near) else F.size(ft.phrase_starts(node, at)) > 0

        return found.filter(ft.evaluated(tree, leaf)).select(*_DOC)

    def hits(self, text: str, q: Query | None = None) -> DataFrame:
        """Keys of turns whose content matches, or that own a call that does."""
        return self.matches(text, q).select(*KEYS).distinct()

    def ranked(self, text: str, limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """Turns whose content matches, by Okapi BM25, from postings and stored lengths."""
        words = ft.terms_of(text)
        contents = self._tables.live("documents").filter(F.col("kind") == CONTENT)
        if not words:
            return contents.select(*KEYS, F.lit(0.0).alias("score")).limit(0)
        n, length = contents.agg(F.count(F.lit(1)), F.avg("n_tokens")).first()
        own = self._postings(words, None).filter(F.col("kind") == CONTENT).select("word", *KEYS, F.size("positions").alias("tf"))
        in_docs = {r.word: r.n for r in own.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a query word
        weight = F.lit(0.0)
        for w in words:
            df = in_docs.get(w, 0)
            weight = F.when(F.col("word") == w, math.log(1 + (n - df + 0.5) / (df + 0.5))).otherwise(weight)
        hit = self.matches(text).filter(F.col("kind") == CONTENT).select(*KEYS)
        tf = F.col("tf").cast("double")
        scored = own.join(hit, KEYS, "left_semi").join(contents.select(*KEYS, "n_tokens"), KEYS).groupBy(*KEYS).agg(
            F.sum(weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n_tokens") / F.lit(length or 1.0)))).alias("score")
        )
        return scored.orderBy(F.desc("score"), "session_id", "id").limit(limit)

    # -- checking

    def integrity(self, a: Archive) -> DataFrame:
        """(kind, n_rows, n_indexed, n_missing, n_orphans): documents of the archive and of the index."""
        left = documents_of(a).select(*_DOC).withColumn("_row", F.lit(1))
        right = self._tables.live("documents").select(*_DOC).withColumn("_entry", F.lit(1))
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in _DOC]
        both = left.alias("l").join(right.alias("r"), same, "full")
        return both.groupBy(F.coalesce("l.kind", "r.kind").alias("kind")).agg(
            F.count("_row").alias("n_rows"), F.count("_entry").alias("n_indexed"),
            F.count_if(F.col("_entry").isNull()).alias("n_missing"), F.count_if(F.col("_row").isNull()).alias("n_orphans"),
        )

    def strict(self, a: Archive) -> DataFrame:
        """(word, kind, session_id, id, call, month, fault): postings that differ from those the archive gives.

        Documents without words have no postings; ``integrity`` counts them.
        """
        line = [*_DOC, "word", "month"]
        documents = documents_of(a)
        want = postings_of(documents, self.buckets, repeats(documents)).select(*line, F.col("positions").alias("_want"))
        have = self._tables.live("postings").select(*line, F.col("positions").alias("_have"))
        same = [F.col(f"w.{c}").eqNullSafe(F.col(f"h.{c}")) for c in line]
        both = want.alias("w").join(have.alias("h"), same, "full").filter(~F.col("_want").eqNullSafe(F.col("_have")))
        fault = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "orphan").otherwise("different")
        return both.select(*[F.coalesce(f"w.{c}", f"h.{c}").alias(c) for c in line], fault.alias("fault"))


class _Plain:
    """A truth value for ``evaluated`` outside of expressions."""

    def __init__(self, value: bool):
        self.value = value

    def __bool__(self) -> bool:
        return self.value

    def __and__(self, other: _Plain) -> _Plain:
        return _Plain(self.value and other.value)

    def __or__(self, other: _Plain) -> _Plain:
        return _Plain(self.value or other.value)

    def __invert__(self) -> _Plain:
        return _Plain(not self.value)
