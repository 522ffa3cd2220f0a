"""Substring deduplication with difference-cover anchors.

A window is ``WINDOW`` consecutive words. Anchors are hashes of ``ANCHOR`` words
at the positions that are 0, 1 or 3 modulo 7 in their document; as every residue
is a difference of two of these, two equal windows, wherever they start, hold
equal anchors at one offset. So only windows around an anchor that another
document shares are looked at; they are compared by 96-bit hashes, and a window
that starts in a document with a smaller id too covers its words.

Tasks combine their own keys first and send one entry for each key and batch of
texts, packed into rows by key range. A passage in any number of documents is so
one entry a batch; what the batch alone can decide, it decides. Only keys and
ids move, besides one exchange of the texts by id.

Defined results: null and empty texts have no words; texts shorter than a window
keep all words. A document with a null id keeps all words and takes words from
none. Rows with equal ids do not take words from each other. An empty table
gives an empty result. Only the named columns are read; ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm import text as tx

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
#: An anchor lies within the window from each of PERIOD offsets on.
ANCHOR = WINDOW - PERIOD + 1
#: Keys that a task gathers before it sends them.
FLUSH = 2_000_000
_U = np.uint64
_LOW = _U((1 << 48) - 1)

_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())])
_SENT_DDL = "bucket int, kind int, keys binary, ids binary"
_KNOWN, _MANY, _ONE = 0, 1, 2  # decided by the batch; stands for several; to be decided


def _anchors(w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of every anchor of the texts that have a window."""
    keep = tx.gram_inside(w, ANCHOR)
    at = np.arange(len(keep))
    place = (at - w.first[w.doc[: len(keep)]]) % PERIOD
    long_enough = (np.diff(w.first) >= WINDOW)[w.doc[: len(keep)]]
    keep &= long_enough & np.isin(place, COVER)
    return at[keep], tx.gram_hash(w.hash, ANCHOR)[keep]


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal keys, and the run of every entry."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _send(kind: int, key: np.ndarray, ids: np.ndarray, buckets: int, extra: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Entries sorted by key, as one packed row for each bucket."""
    if not len(key):
        return
    bucket = tx.bucket_of(key, buckets)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(key)]))
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        packed = tx.planes(key[a:b]) + (tx.planes(extra[a:b]) if extra is not None else b"")
        rows.append((int(bucket[a]), kind, packed, tx.planes(ids[a:b])))
    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)


def _anchor_entries(buckets: int):
    def flush(keys: list, ids: list) -> Iterator[pa.RecordBatch]:
        key, doc = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[fresh], doc[fresh]
        start, run = _runs(key)
        many = (np.diff(np.append(start, len(key))) > 1)
        yield from _send(_ONE, key[start][~many], doc[start][~many], buckets)
        yield from _send(_MANY, key[start][many], doc[start][many], buckets)
        yield from _send(_KNOWN, key[many[run]], doc[many[run]], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, size = [], [], 0
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in tx.chunks(batch.column(1)):
                w = tx.words(chunk)
                at, key = _anchors(w)
                keys.append(key)
                ids.append(own[chunk.first + w.doc[at]])
                size += len(key)
                if size >= FLUSH:
                    yield from flush(keys, ids)
                    keys, ids, size = [], [], 0
        if size:
            yield from flush(keys, ids)

    return run


def _window_entries(buckets: int):
    def flush(keys: list, others: list, ids: list) -> Iterator[pa.RecordBatch]:
        key, other, doc = np.concatenate(keys), np.concatenate(others), np.concatenate(ids)
        order = np.lexsort((doc, other, key))
        key, other, doc = key[order], other[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1])
        least = doc[new][np.cumsum(new) - 1]
        yield from _send(_ONE, key[new], doc[new], buckets, other[new])
        later = doc > least
        yield from _send(_KNOWN, key[later], doc[later], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, others, ids, size = [], [], [], 0
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            own = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            shared = batch.column(2)
            for chunk in tx.chunks(batch.column(1)):
                n = len(chunk.offsets) - 1
                wanted = np.unique(_keys_of(shared.slice(chunk.first, n))[1])
                if not len(wanted):
                    continue
                w = tx.words(chunk)
                at, key = _anchors(w)
                marks = np.zeros(len(w.doc) + PERIOD + 1, np.int64)
                marks[at[_member(key, wanted)] + 1] = 1
                np.cumsum(marks, out=marks)
                inside = tx.gram_inside(w, WINDOW)
                start = np.flatnonzero(inside & (marks[PERIOD : PERIOD + len(inside)] > marks[: len(inside)]))
                start = start[known[chunk.first + w.doc[start]]]
                keys.append(tx.gram_hash(w.hash, WINDOW)[start])
                others.append((tx.gram_hash(w.hash, WINDOW, tx.GRAM_BASE_2)[start] >> _U(32)).astype(np.uint32))
                ids.append(own[chunk.first + w.doc[start]])
                size += len(start)
                if size >= FLUSH:
                    yield from flush(keys, others, ids)
                    keys, others, ids, size = [], [], [], 0
        if size:
            yield from flush(keys, others, ids)

    return run


def _member(key: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array."""
    if not len(among):
        return np.zeros(len(key), bool)
    at = np.searchsorted(among, key)
    at[at == len(among)] = 0
    return among[at] == key


def _keys_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of a column of lists of keys."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
    return np.repeat(np.arange(len(lists)), sizes), flat


def _answers(decide):
    """Reducer over rows sorted by bucket: (id, key) of what is shared or covered."""
    out = pa.schema([("_id", pa.int64()), ("key", pa.int64())])

    def emit(ids: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at : at + 100_000]), pa.array(key[at : at + 100_000].view(np.int64))], schema=out
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for b, kind, keys, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    if held:
                        yield from emit(*decide(held))
                    bucket, held = b, []
                if kind == _KNOWN:
                    yield from emit(tx.from_planes(ids), tx.from_planes(keys, np.uint64))
                else:
                    held.append((kind, keys, tx.from_planes(ids)))
        if held:
            yield from emit(*decide(held))

    return run


def _shared_anchors(held: list) -> tuple[np.ndarray, np.ndarray]:
    kind = np.concatenate([np.full(len(ids), k) for k, _, ids in held])
    key = np.concatenate([tx.from_planes(keys, np.uint64) for _, keys, _ in held])
    ids = np.concatenate([x for _, _, x in held])
    order = np.argsort(key, kind="stable")
    key, ids, kind = key[order], ids[order], kind[order]
    start, run = _runs(key)
    several = np.minimum.reduceat(ids, start) < np.maximum.reduceat(ids, start)
    several |= np.minimum.reduceat(kind, start) == _MANY
    told = several[run] & (kind == _ONE)
    return ids[told], key[told]


def _covered_windows(held: list) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([tx.from_planes(keys[: 8 * len(ids)], np.uint64) for _, keys, ids in held])
    other = np.concatenate([tx.from_planes(keys[8 * len(ids) :], np.uint32) for _, keys, ids in held])
    ids = np.concatenate([x for _, _, x in held])
    order = np.lexsort((ids, other, key))
    key, other, ids = key[order], other[order], ids[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1])
    told = ids > ids[new][np.cumsum(new) - 1]
    return ids[told], key[told]


def _kept_rows(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tx.chunks(batch.column(1)):
                n = len(chunk.offsets) - 1
                w = tx.words(chunk)
                removed = np.zeros(len(w.doc), bool)
                row, key = _keys_of(batch.column(2).slice(chunk.first, n))
                if len(key):
                    inside = np.flatnonzero(tx.gram_inside(w, WINDOW))
                    own = tx.gram_hash(w.hash, WINDOW)[inside] ^ tx.mix(w.doc[inside].astype(np.uint64) + _U(1))
                    start = inside[_member(own, np.sort(key ^ tx.mix(row.astype(np.uint64) + _U(1))))]
                    steps = np.zeros(len(w.doc) + 1, np.int64)
                    np.add.at(steps, start, 1)
                    np.add.at(steps, start + WINDOW, -1)
                    removed = np.cumsum(steps[:-1]) > 0
                total = np.concatenate(([0], np.cumsum(removed)))
                gone = total[w.first[1:]] - total[w.first[:-1]]
                data, kept = chunk.data.tobytes(), []
                for k in range(n):
                    own_words = data[chunk.offsets[k] : chunk.offsets[k + 1]].split()
                    if gone[k]:
                        own_words = compress(own_words, (~removed[w.first[k] : w.first[k + 1]]).tolist())
                    kept.append(b" ".join(own_words))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, n),
                        pa.array(np.diff(w.first), pa.int64()),
                        pa.array(gone, pa.int64()),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=["_id", "n_words", "n_removed", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed and the kept text of each document.

    A word goes if a window over it also starts in a document with a smaller
    id; windows are judged on the input. Kept words are joined by one space.
    """
    spark = docs.sparkSession
    buckets, parts = tx.bucket_count(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def answered(sent: DataFrame, decide) -> DataFrame:
        dealt = sent.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "kind")
        return (
            dealt.mapInArrow(_answers(decide), "_id long, key long")
            .groupBy("_id")
            .agg(F.collect_list("key").alias("keys"))  # of one document
        )

    anchors = texts.filter("_id is not null").mapInArrow(_anchor_entries(buckets), _SENT_DDL)
    near = texts.join(answered(anchors, _shared_anchors), "_id", "left").select("_id", "_text", "keys")
    # no filter here: both joins then read the same exchange of the texts
    windows = near.mapInArrow(_window_entries(buckets), _SENT_DDL)
    covered = texts.join(answered(windows, _covered_windows), "_id", "left").select("_id", "_text", "keys")
    return covered.mapInArrow(_kept_rows(pa.int64()), "_id long, n_words long, n_removed long, kept string").withColumnRenamed(
        "_id", id_col
    )
