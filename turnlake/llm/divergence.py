"""Divergence of a language's sources by their terms, with equal count columns merged.

A term is a run of ASCII letters and non-ASCII characters, A-Z lower-cased. A
language keeps the V terms found in at least ``min_docs`` of its documents. In a
group of documents with N occurrences of kept terms, a term with c of them has
p = 1 + floor(10^9 (c + 5) / (N + 5 V)). Terms of a language with the same sparse
vector of counts by source are one column with a multiplicity: every pair of
sources is compared once for each distinct column.

Tasks count their own texts first, in Arrow batches, and send one row for each
term and group; everything else moves counts. Columns are dealt to tasks by
language, tile of ``TILE`` sources and slices of about ``SLICE`` columns, so no
task holds a language; a task returns one row for each pair of its tile. One
row holds a term's counts by source, so sources of a language are meant to be
far fewer than its documents, as the result (all ordered pairs) has to be too.

Defined results: null text, lang and source read as ''. Texts of any length are
counted whole, in slices that end between terms. Repeated rows count as often as
they occur; ids are not read. A language without kept terms gives pairs of value
0; an empty table gives an empty result. Only the named columns are read. All
arithmetic is on integers: exact up to 9 * 10^15 occurrences in a group.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.shared import stored

SCALE, PRIOR = 1_000_000_000, 5
#: Sources of one task's rows, and columns dealt to it on average.
TILE, SLICE = 512, 2_000
#: Groups up to which tables of groups are broadcast.
FEW_GROUPS = 10_000
#: Entries that a task counts before it sends them, and bytes of text split at once.
FLUSH, PIECE = 1_000_000, 1 << 20

_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: bytes) -> Counter:
    """Occurrences of each term of a text, the terms as UTF-8."""
    if len(text) <= PIECE:
        return Counter(_TERM.findall(text.lower()))
    found, at = Counter(), 0
    while at < len(text):
        gap = _GAP.search(text, min(at + PIECE, len(text)))
        to = gap.start() if gap else len(text)
        found.update(_TERM.findall(text[at:to].lower()))
        at = to
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's texts; a group without terms gives a null term."""
    counts: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for group, have in counts.items():
            names = list(have) or [None]
            for a in range(0, len(names), 50_000):
                part = names[a : a + 50_000]
                n = [have.get(t, 0) for t in part]
                d = [docs[group].get(t, 0) for t in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group[0]] * len(part)), pa.array([group[1]] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())],
                    schema=_COUNTED,
                )

    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        for text, *group in zip(texts, *(c.to_pylist() for c in batch.columns[1:]), strict=True):
            own = counts.setdefault(tuple(group), Counter())
            in_docs = docs.setdefault(tuple(group), Counter())
            found, before = terms(text.as_py()), len(own)
            own.update(found)
            in_docs.update(found.keys())
            size += len(own) - before
            if size >= FLUSH:
                yield from flush()
                counts, docs, size = {}, {}, 0
    yield from flush()


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)); null where nothing is kept."""
    over = (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", over, F.nullif(total + PRIOR * kept, F.lit(0)).cast("decimal(20,0)")) + 1


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same on arrays, three digits at a time so that nothing overflows."""
    rest, out = count + PRIOR, np.zeros(np.broadcast_shapes(count.shape, total.shape), np.int64)
    for _ in range(4):
        digits = rest // total
        out = out * 1000 + digits
        rest = (rest - digits * total) * 1000
    return out + 1


def kept_terms(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lang, term, column) with column the counts by source, sorted; and (lang, source) of every group."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counted = texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    by_source = stored(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    groups = by_source.select("lang", "source").distinct()
    columns = (
        by_source.filter("term is not null")
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("column"))
        .filter(F.col("docs") >= min_docs)
        .select("lang", "term", "column")
    )
    return stored(columns), groups


def _pair_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of a slice of distinct columns for each pair (source of the tile, other source)."""
    names = right.column("source").combine_chunks()
    order = np.argsort(names.to_numpy(zero_copy_only=False), kind="stable")
    names = names.take(pa.array(order))
    total = right.column("whole").to_numpy()[order]
    tiles = right.column("own").to_numpy()[order]
    out = {"lang": [], "source": [], "item": [], "value": []}
    if left.num_rows and len(names):
        lang, tile = left.column("lang")[0].as_py(), left.column("tile")[0].as_py()
        mine = np.flatnonzero(tiles == tile)
        sums = np.zeros((len(mine), len(names)), np.int64)
        step = max(1, (1 << 21) // len(names))
        for a in range(0, left.num_rows, step):
            part = left.slice(a, step)
            lists = part.column("column").combine_chunks()
            entry = lists.flatten()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at = pc.index_in(entry.field("source"), value_set=names).to_numpy()
            count = np.zeros((len(lists), len(names)), np.int64)
            count[row, at] = entry.field("n").to_numpy()
            p = _shares(count, total[None, :])
            times = part.column("terms").to_numpy()
            for k, own in enumerate(mine):
                sums[k] += times @ np.abs(p - p[:, own : own + 1])
        for k, own in enumerate(mine):
            out["lang"] += [lang] * len(names)
            out["source"] += [names[int(own)].as_py()] * len(names)
            out["item"] += names.to_pylist()
            out["value"] += sums[k].tolist()
    return pa.table(out, schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: for every ordered pair of sources of a language, the summed
    differences of p over all kept terms. Part ``term``: the ``top`` terms of
    each group whose p lies furthest above the language's. Ranks go from the
    greatest value on, ties by item.
    """
    columns, groups = kept_terms(docs, min_docs)
    kept = columns.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    entries = columns.select("lang", "term", F.aggregate("column", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("in_lang"), F.explode("column").alias("e")).select(
        "lang", "term", "in_lang", F.col("e.source").alias("source"), F.col("e.n").alias("n")
    )
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stored(
        groups.join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))
    )  # one row for each group
    few = groups.count() <= FEW_GROUPS

    def small(frame: DataFrame) -> DataFrame:
        """A table with at most one row for each group."""
        return F.broadcast(frame) if few else frame

    # every pair once for each distinct column
    tiled = groups.withColumn("tile", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / TILE).cast("int"))
    distinct = stored(columns.groupBy("lang", "column").agg(F.count(F.lit(1)).alias("terms")))
    dealt = distinct.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    tiles = tiled.filter("kept > 0").select("lang", "tile").distinct().join(dealt, "lang")
    left = distinct.join(small(tiles), "lang").withColumn("slice", F.pmod(F.xxhash64("column"), F.col("slices")).cast("int"))
    right = (
        tiled.withColumn("whole", F.col("total") + PRIOR * F.col("kept")).select("lang", "source", "whole", F.col("tile").alias("own"))
        .join(tiles, "lang")
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select(F.col("lang").alias("of_lang"), F.col("tile").alias("of_tile"), F.col("slice").alias("of_slice"), "source", "whole", "own")
    )
    sums = (
        left.select("lang", "tile", "slice", "column", "terms").groupBy("lang", "tile", "slice")
        .cogroup(right.groupBy("of_lang", "of_tile", "of_slice"))
        .applyInArrow(_pair_sums, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
    )
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").filter("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("long"))
    down = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(down).alias("rank"))

    # original terms, by group
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    shares = entries.join(small(groups), ["lang", "source"]).join(small(of_lang), "lang")
    value = share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("in_lang"), F.col("lang_total"), F.col("kept"))
    above = shares.select("lang", "source", F.col("term").alias("item"), value.alias("value")).filter("value > 0")
    best = above.withColumn("rank", F.row_number().over(down)).filter(F.col("rank") <= top)
    return pairs.unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
