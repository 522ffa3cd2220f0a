"""Benchmark decontamination over a distributed positional inverted index.

DataFrame operations only. ``term_counts`` gives corpus frequencies of the test
terms, ``build_index`` stores postings (term, document, position), and
``phrase_matches`` intersects the offset-adjusted lists of each window's rarest
terms; survivors are compared word by word with the document.
``proximity_matches`` uses the same postings for terms within a span.

Words are maximal runs of ASCII letters and digits and of all characters beyond
ASCII, with A-Z lower-cased. A window is ``size`` consecutive words of a test
item; a shorter item is one window, an item without words has none.

Defined results: null and empty texts have no words and no hits; items with a
null id still mark words but are not listed. Rows are told apart by (id, text),
so repeated rows each get the same result. An empty document table gives an
empty result, an empty benchmark leaves every document clean. Only the named
id and text columns are read; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnlake.llm.shared import stored

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Term and list tables of at most so many rows are broadcast (16 to 100 bytes
#: a row); larger ones are joined by shuffle.
BROADCAST_ROWS = 250_000
#: Keys of each term where terms are joined by shuffle.
SALT = 32


def word_array(text: Column) -> Column:
    """Words in their own case; separators only differ from words by class."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), "")


def _exact(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _term(word: Column) -> Column:
    """Index key. ``lower`` also folds letters beyond ASCII, so that a list can
    hold more than the exact words; survivors are compared exactly."""
    return F.xxhash64(F.lower(word))


def _few(frame: DataFrame) -> bool:
    """Whether a stored table's row count permits a broadcast."""
    return frame.count() <= BROADCAST_ROWS


def _bounded(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if _few(frame) else frame


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows under a key of two hashes, which is known for null ids and texts too."""
    own, text = F.col(id_col), F.col(text_col)
    return docs.select(own.alias("_own"), F.xxhash64(own).alias("_id"), F.xxhash64(text).alias("_sum"), text.alias("_text"))


def _positions(docs: DataFrame) -> DataFrame:
    return docs.select("_id", "_sum", F.posexplode(word_array(F.col("_text"))).alias("pos", "word")).select(
        "_id", "_sum", "pos", _term(F.col("word")).alias("term")
    )


def windows_of(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, words, item): one row for each item and distinct window in it."""
    parts = items.select(F.col(id_col).alias("item"), word_array(_exact(F.col(text_col))).alias("all")).filter(
        F.size("all") > 0
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))
    return (
        parts.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, size))).alias("words"))
        .select("item", "words", F.md5(F.array_join("words", " ")).alias("window"))
        .distinct()
    )


def term_counts(docs: DataFrame, terms: DataFrame, few: bool = True) -> DataFrame:
    """Occurrences in all documents of each given term that occurs.

    Few terms are broadcast, so that only they are counted; for many, all words
    are counted first, within their tasks, and meet the terms as sums.
    """
    if few:
        return _positions(docs).join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return _positions(docs).groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms, "term")


def build_index(docs: DataFrame, terms: DataFrame, few: bool = True) -> DataFrame:
    """Postings (term, _id, _sum, pos) of the given terms, stored where every executor reads them.

    Few terms are broadcast. Many are joined by shuffle under ``SALT`` keys
    each, so that a frequent word's occurrences are dealt to as many tasks.
    """
    if few:
        found = _positions(docs).join(F.broadcast(terms), "term")
    else:
        salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        found = _positions(docs).withColumn("salt", F.pmod("pos", F.lit(SALT)).cast("int")).join(salted, ["term", "salt"])
    return stored(found.select("term", "_id", "_sum", "pos"))


def rarest_lists(windows: DataFrame, counts: DataFrame, lists: int) -> DataFrame:
    """(term, window, key, length, back, bit, full): the lists to intersect for each window.

    The rarest terms come first. A window with a term that no document has is
    dropped. ``back`` is the term's offset in the window, ``key`` a number for
    it, ``full`` the bits of all its lists.
    """
    terms = windows.select("window", "words").distinct().select(
        "window", F.size("words").alias("length"), F.posexplode("words").alias("back", "word")
    ).withColumn("term", _term(F.col("word")))
    by_window = Window.partitionBy("window")
    ranked = (
        terms.join(counts, "term")
        .withColumn("known", F.count(F.lit(1)).over(by_window))
        .filter("known = length")
        .withColumn("rank", F.row_number().over(by_window.orderBy("n", "back")) - 1)
        .filter(F.col("rank") < lists)
    )
    one = F.lit(1)
    return ranked.select(
        "term", "window", F.xxhash64("window").alias("key"), "length", "back",
        F.call_function("shiftleft", one, F.col("rank")).alias("bit"),
        (F.call_function("shiftleft", one, F.least("length", F.lit(lists))) - 1).alias("full"),
    )


def phrase_matches(docs: DataFrame, windows: DataFrame, lists: int = 2) -> DataFrame:
    """(_id, _sum, found): per document with a match, its exact (start, length, window)."""
    vocabulary = stored(windows.select(F.explode("words").alias("word")).select(_term(F.col("word")).alias("term")).distinct())
    counts = stored(term_counts(docs, vocabulary, _few(vocabulary)))
    chosen = stored(rarest_lists(windows, counts, lists))
    listed = stored(chosen.select("term").distinct())
    index = build_index(docs, listed, _few(listed))
    spots = index.join(_bounded(chosen.select("term", "key", "back", "bit", "full")), "term").select(
        "_id", "_sum", "key", (F.col("pos") - F.col("back")).alias("start"), "bit", "full"
    )
    survivors = (
        spots.filter("start >= 0")
        .groupBy("_id", "_sum", "key", "start")
        .agg(F.bit_or("bit").alias("bits"), F.max("full").alias("full"))
        .filter("bits = full")
        .join(_bounded(chosen.select("key", "window", "length").distinct()), "key")
        .groupBy("_id", "_sum")
        .agg(F.collect_list(F.struct("start", "length", "window")).alias("found"))
    )
    survivors = stored(survivors)
    # words of the survivors only are shuffled; split before the join, once for all matches of a text
    near = docs.join(_bounded(survivors.select("_id", "_sum")), ["_id", "_sum"], "left_semi")
    exact = (
        near.select("_id", "_sum", word_array(_exact(F.col("_text"))).alias("all"))
        .join(survivors, ["_id", "_sum"])
        .select(
            "_id", "_sum",
            F.filter(
                "found",
                lambda f: F.md5(F.array_join(F.slice("all", f["start"] + 1, f["length"]), " ")) == f["window"],
            ).alias("found"),
        )
        .filter(F.size("found") > 0)
        .dropDuplicates(["_id", "_sum"])
    )
    return exact


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    lists: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """id, n_words, n_hit, items (array of strings, sorted) and contaminated, a row for each document."""
    docs = _documents(documents, id_col, text_col)
    windows = stored(windows_of(benchmark, size, item_col, item_text_col))
    matches = stored(phrase_matches(docs, windows, lists))
    spots = F.flatten(F.transform("found", lambda f: F.sequence(f["start"], f["start"] + f["length"] - 1)))
    hit = matches.select("_id", "_sum", F.size(F.array_distinct(spots)).alias("n_hit"))
    items = (
        matches.select("_id", "_sum", F.explode(F.array_distinct(F.transform("found", lambda f: f["window"]))).alias("window"))
        .join(windows.filter("item is not null").select("window", F.col("item").cast("string").alias("item")), "window")
        .groupBy("_id", "_sum")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    found = hit.join(items, ["_id", "_sum"], "left")
    counted = docs.select("_own", "_id", "_sum", F.size(word_array(F.col("_text"))).cast("long").alias("n_words"))
    joined = counted.join(found, ["_id", "_sum"], "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return joined.select(
        F.col("_own").alias(id_col), "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


def proximity_matches(
    documents: DataFrame, phrases: DataFrame, span: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, phrase, start): documents in which all words of a phrase lie within ``span`` words.

    ``phrases`` has (phrase, words). ``start`` is the least position of a word
    of the phrase from which on the span holds them all, in any order. Words
    are compared by the index key, that is, regardless of case.
    """
    docs = _documents(documents, id_col, text_col)
    words = phrases.select("phrase", F.explode(F.array_distinct("words")).alias("word"))
    terms = words.select("phrase", _term(F.col("word")).alias("term")).distinct()
    need = terms.groupBy("phrase").agg(F.count(F.lit(1)).alias("need"))
    listed = stored(terms.select("term").distinct())
    index = build_index(docs, listed, _few(listed))
    spots = index.join(_bounded(stored(terms.join(need, "phrase"))), "term").distinct()
    by = Window.partitionBy("phrase", "_id", "_sum").orderBy("pos").rangeBetween(0, span - 1)
    found = (
        spots.withColumn("seen", F.size(F.collect_set("term").over(by)))
        .filter("seen = need")
        .groupBy("_id", "_sum", "phrase")
        .agg(F.min("pos").alias("start"))
    )
    named = docs.select("_own", "_id", "_sum")
    return named.join(found, ["_id", "_sum"]).select(F.col("_own").alias(id_col), "phrase", "start")
