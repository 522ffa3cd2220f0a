"""Toxicity scores by FTRL-proximal logistic regression over hashed features.

Features are a text's distinct words, word pairs and skip-grams (pairs with one
word between), with A-Z lower-cased and without punctuation, hashed into ``2**BITS`` coordinates. The
L1 term leaves few weights, which are broadcast; scoring hashes whole texts and
looks up those weights only.

Learning uses a bounded sample of labelled rows: the ``max_rows`` with the least
hashes of their ids, without those whose texts would make it more than ``MAX_BYTES``
together; a text that does not fit is left out, those after it are not. So the
sample is the same on every run and the driver gets six times those bytes at most. Of several texts with one id the one of the least hash is learned from, and
of several labels the highest. Scoring uses the text alone, however long.

Defined results: null and empty texts have no features and get the score of the
bias. Rows whose label is null are not learned from; without any learned row
all scores are 0.5, hence predicted 1 by the rule of 0.5 and more, but
``keep_clean`` keeps all rows. Repeated rows get the same score. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm import text as tx

BITS = 20
#: Most labelled rows that are learned from, and most bytes of their texts.
MAX_ROWS, MAX_BYTES = 6000, 32 << 20


class Rates(NamedTuple):
    """Settings of the FTRL-proximal updates, chosen on a fifth of the ids that may be learned from."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 30.0
    l2: float = 0.01
    passes: int = 4
    toxic_weight: float = 3.0  # of a row labelled 1; missing one costs more than a false alarm


class Model(NamedTuple):
    index: np.ndarray  # sorted coordinates with weights
    weight: np.ndarray
    bias: float


def _features(chunk: tx.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text, coordinate) of every feature occurrence in a chunk."""
    w = tx.words(chunk, fold=True, between=tx.MARKS)
    docs, hashes = [w.doc], [w.hash]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        if len(w.doc) > gap:
            same = w.doc[:-gap] == w.doc[gap:]
            pair = tx.mix(w.hash[:-gap] * np.uint64(tx.GRAM_BASE) + w.hash[gap:] + np.uint64(salt))
            docs.append(w.doc[:-gap][same])
            hashes.append(pair[same])
    at = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate(docs), at


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in tx.chunks(batch.column(1)):
            docs, at = _features(chunk)
            n = len(chunk.offsets) - 1
            key = np.unique(docs << BITS | at)
            parts = np.split((key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(1, n)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, n), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["label", "features"],
            )


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The coordinates of each row, in place; no value is null."""
    rows = []
    for chunk in column.chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] // 4
        data = np.frombuffer(chunk.buffers()[2], np.int32, int(ends[-1])) if ends[-1] else np.zeros(0, np.int32)
        rows += [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return rows


def _fit(labels: np.ndarray, rows: list[np.ndarray], rates: Rates) -> Model:
    """FTRL-proximal over the rows in the given order, several passes."""
    index = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.int32))
    size = len(index)
    ends = np.cumsum([len(row) + 1 for row in rows], dtype=np.int64)
    # all rows in one array, which the driver gets rid of at once
    places = np.full(int(ends[-1]) if len(rows) else 0, size, np.int32)  # the last of each row is the bias
    local = np.split(places, ends[:-1]) if rows else []
    for at, row in zip(local, rows, strict=True):
        at[:-1] = np.searchsorted(index, row)
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, rates.l1)
    l1[size] = 0

    def weights(at):
        zi, ni = z[at], n[at]
        w = (np.sign(zi) * l1[at] - zi) / ((rates.beta + np.sqrt(ni)) / rates.alpha + rates.l2)
        return np.where(np.abs(zi) <= l1[at], 0.0, w)

    for _ in range(rates.passes):
        for y, at in zip(labels, local, strict=True):
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - y) * (rates.toxic_weight if y else 1.0)
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / rates.alpha * w
    w = weights(np.arange(size + 1))
    kept = w[:size] != 0
    return Model(index[kept].astype(np.int64), w[:size][kept], float(w[size]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    held_out: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = MAX_ROWS,
    rates: Rates = Rates(),
) -> Model:
    """Fit on labelled documents; with ``held_out`` every fifth id by CRC-32 takes no part."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).filter(
        "label is not null and _id is not null"
    )
    if held_out:
        known = known.filter(F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0)
    known = known.groupBy("_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    hashed = F.xxhash64("_text")
    sizes = texts.filter("_id is not null").groupBy("_id").agg(
        F.min(F.struct(hashed.alias("pick"), F.coalesce(F.octet_length("_text"), F.lit(0)).alias("bytes"))).alias("one")
    )
    near = known.join(sizes.select("_id", "one.*"), "_id").withColumn("order", F.xxhash64("_id"))
    first = near.orderBy("order", "_id").limit(max_rows).select("_id", "pick", "label", "bytes")
    fitting, total = [], 0
    for row in first.collect():  # at most max_rows of four numbers
        if total + row.bytes <= MAX_BYTES:  # a text that does not fit is left out, not those after it
            fitting.append(row)
            total += row.bytes
    chosen = docs.sparkSession.createDataFrame(fitting, first.schema)
    picked = texts.withColumn("pick", hashed).join(F.broadcast(chosen.select("_id", "pick", "label")), ["_id", "pick"])  # bounded by max_rows
    sample = picked.select("label", "_text", "_id").dropDuplicates(["_id"]).mapInArrow(_feature_rows, "label int, features binary")
    table = sample.toArrow()
    labels_of = table.column("label").to_numpy().astype(float)
    rows = _views(table.column("features"))
    # the same on every run: by the first features, then by all of them
    order = sorted(range(len(rows)), key=lambda k: (rows[k][:32].tobytes(), xxhash.xxh3_128_digest(rows[k]), labels_of[k]))
    order = np.random.default_rng(7).permutation(np.array(order, int)) if order else []
    return _fit(labels_of[order] if len(order) else labels_of, [rows[k] for k in order], rates)


def _weights(model: Model) -> np.ndarray:
    table = np.zeros(1 << BITS)
    table[model.index] = model.weight
    return table


def _chunk_scores(chunk: tx.Chunk, table: np.ndarray, bias: float) -> np.ndarray:
    """Probability of the label 1 of each text of a chunk."""
    docs_at, at = _features(chunk)
    hit = table[at] != 0
    key = np.unique(docs_at[hit] << BITS | at[hit])
    total = bias + np.bincount(key >> BITS, table[key & ((1 << BITS) - 1)], minlength=len(chunk.offsets) - 1)
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): probability of the label 1 for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _weights(shared.value)
        for batch in batches:
            for chunk in tx.chunks(batch.column(1)):
                scores = _chunk_scores(chunk, table, shared.value.bias)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, len(scores)), pa.array(scores, pa.float64())], names=["_id", "score"]
                )

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = picked.schema["_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold; nothing is shuffled.

    A model without weights rejects nothing.
    """
    if not len(model.index):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _weights(shared.value)
        for batch in batches:
            for chunk in tx.chunks(batch.column(place)):
                clean = _chunk_scores(chunk, table, shared.value.bias) < threshold
                yield batch.slice(chunk.first, len(clean)).filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def toxic_ids(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every document by a model learned from the labels."""
    scored = score(docs, train(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
