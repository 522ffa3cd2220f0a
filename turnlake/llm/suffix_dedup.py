"""Byte-exact removal of repeated passages by suffix sorting.

A string of ``WINDOW`` bytes that starts at two places or more is repeated, and
every byte that a repeated string covers goes. Suffixes are sorted where equal
ones must meet: a window belongs to its anchor, the least of the hashes of its
``ANCHOR``-byte strings (the leftmost of equals), so equal windows have equal
anchors at one offset. Anchors that occur once rule their windows out. For the
others, the bytes around the anchor move to the task of the anchor's hash range,
and the task sorts the suffixes of all its segments, ``WINDOW`` bytes deep:
multikey quicksort on characters of 8 bytes to the depth ``SHALLOW``, then blind
tries for the groups that still agree, all groups of a round at once in numpy.

Tasks merge equal segments of their own texts first, so a passage in any number
of copies is one segment a batch. An anchor found more than ``HOT`` times has no
task of its own: its windows go by 128-bit digests of all their bytes, one entry
for each window and batch. What a batch alone can decide, it decides.

Defined results: null and empty texts have no bytes; texts under ``WINDOW`` bytes
lose none. Rows with equal or null ids are documents of their own, so a repeated
row loses whatever its twin has. Long texts are read in slices; their answers are
merged intervals. An empty table gives an empty result. Only the named columns
are read; ids are integers. Kept bytes need not be valid UTF-8 and stay binary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm import text as tx

WINDOW, ANCHOR, SHALLOW = 200, 64, 16
#: Anchors in a window.
SPAN = WINDOW - ANCHOR + 1
#: Occurrences from which on an anchor's windows are dealt one by one.
HOT = 1 << 16
#: Bytes hashed at once, anchors and segments that a task gathers before it sends them.
SLICE, FLUSH_KEYS, FLUSH_SEGMENTS = tx.CHUNK_BYTES, 1_000_000, 100_000
#: An answer is a start and a number of windows in one integer.
_RUN_BITS = 20
_U = np.uint64
_PLACE = _U((1 << 21) - 1)

_ASKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("sums", pa.binary()), ("times", pa.binary())])
_ASKED_DDL = "bucket int, kind int, keys binary, ids binary, sums binary, times binary"
_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("texts", pa.large_binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("sums", pa.binary()), ("starts", pa.binary())])
_SENT_DDL = "bucket int, kind int, texts binary, sizes binary, ids binary, sums binary, starts binary"
#: Found once by the batch, several times; the same for single windows; rows that the batch decided.
_ONE, _MANY, _ONE_WINDOW, _MANY_WINDOW, _KNOWN = range(5)


class Runs(NamedTuple):
    """Windows of a slice that share an anchor: first window, their number, anchor's key, text."""

    start: np.ndarray
    n: np.ndarray
    key: np.ndarray
    doc: np.ndarray


def _powers(base: int) -> np.ndarray:
    step = np.full(SLICE + WINDOW, base, _U)
    step[0] = 1
    return np.multiply.accumulate(step)


_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if not _tables:
        _tables["up"] = _powers(tx.BYTE_BASE)
        _tables["down"] = _powers(pow(tx.BYTE_BASE, -1, 1 << 64))
        _tables["value"] = tx.mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return _tables[name]


def anchor_runs(data: np.ndarray, offsets: np.ndarray) -> Runs:
    """The runs of a slice of whole texts, or of one part of a long text."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return Runs(none, none, none.astype(_U), none)
    total = np.zeros(n + 1, _U)
    np.cumsum(_table("value")[data] * _table("up")[:n], out=total[1:])
    grams = (total[ANCHOR:] - total[:-ANCHOR]) * _table("down")[: n - ANCHOR + 1]
    # the place in the low bits makes the leftmost of equal hashes the least
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=_U)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    window = np.flatnonzero(np.arange(len(least)) + WINDOW <= ends)
    if not len(window):
        return Runs(none, none, none.astype(_U), none)
    anchor = (least[window] & _PLACE).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (np.diff(window) != 1) | (np.diff(anchor) != 0)
    at = np.flatnonzero(new)
    start = window[at]
    key = tx.mix(grams[anchor[at]]) & ~_U(1)
    return Runs(start, np.diff(np.append(at, len(window))), key, np.searchsorted(offsets, start, side="right") - 1)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of the slice in its text, bytes, offsets): whole texts, long ones in parts that overlap."""
    for chunk in tx.chunks(texts):
        if len(chunk.data) <= SLICE:
            yield chunk.first, 0, chunk.data, chunk.offsets
            continue
        for at in range(0, len(chunk.data) - WINDOW + 1, SLICE):
            part = chunk.data[at : at + SLICE + WINDOW - 1]
            yield chunk.first, at, part, np.array([0, len(part)])


# -- which anchors occur more than once


def _asked(kind: int, key: np.ndarray, ids: np.ndarray, sums: np.ndarray, times: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries sorted by key, as one packed row for each bucket."""
    if not len(key):
        return
    bucket = tx.bucket_of(key, buckets)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(key)]))
    rows = [(int(bucket[a]), kind, *(tx.planes(v[a:b]) for v in (key, ids, sums, times))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ASKED, strict=True)], schema=_ASKED)


def _anchor_entries(buckets: int):
    def flush(keys: list, ids: list, sums: list) -> Iterator[pa.RecordBatch]:
        key, own, crc = np.concatenate(keys), np.concatenate(ids), np.concatenate(sums)
        order = np.lexsort((crc, own, key))
        key, own, crc = key[order], own[order], crc[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        times = np.diff(np.append(start, len(key)))
        many = times > 1
        none = np.zeros(0, np.int64)
        yield from _asked(_ONE, key[start][~many], own[start][~many], crc[start][~many], none.astype(np.uint32), buckets)
        yield from _asked(_MANY, key[start][many], none, none.astype(np.uint32), times[many].astype(np.uint32), buckets)
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1]) | (crc[1:] != crc[:-1])
        told = np.repeat(many, times) & fresh
        yield from _asked(_KNOWN, key[told], own[told], crc[told], none.astype(np.uint32), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, sums, size = [], [], [], 0
        for batch in batches:
            own, crc = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)
            for first, _, data, offsets in _slices(batch.column(2)):
                runs = anchor_runs(data, offsets)
                keys.append(runs.key)
                ids.append(own[first + runs.doc])
                sums.append(crc[first + runs.doc])
                size += len(runs.key)
                if size >= FLUSH_KEYS:
                    yield from flush(keys, ids, sums)
                    keys, ids, sums, size = [], [], [], 0
        if size:
            yield from flush(keys, ids, sums)

    return run


_FOUND = pa.schema([("_id", pa.int64()), ("_sum", pa.int64()), ("key", pa.int64())])


def _found(ids: np.ndarray, sums: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(ids), 100_000):
        part = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(sums[part].astype(np.int64)), pa.array(key[part].view(np.int64))], schema=_FOUND)


def _buckets(batches: Iterator[pa.RecordBatch], begin: Callable, known: Callable) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and kind: all undecided entries of a bucket to ``begin``, then each decided row to ``known``."""
    bucket, held, table = None, [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != bucket:
                if held:
                    _, found = begin(held)
                    yield from found
                bucket, held, table = row[0], [], None
            if row[1] != _KNOWN:
                held.append(row)
                continue
            if held:
                table, found = begin(held)
                yield from found
                held = []
            yield from known(table, row)
    if held:
        _, found = begin(held)
        yield from found


def _shared_anchors(hot: int):
    """(id, sum, key) of each anchor that occurs again; the key's lowest bit says whether it is a hot one."""

    def begin(held: list) -> tuple[tuple, Iterator[pa.RecordBatch]]:
        one = [r for r in held if r[1] == _ONE]
        many = [r for r in held if r[1] == _MANY]
        join = lambda rows, at, kind: np.concatenate([np.zeros(0, kind), *(tx.from_planes(r[at], kind) for r in rows)])
        single = join(one, 2, _U)
        keys, at = np.unique(np.concatenate((single, join(many, 2, _U))), return_inverse=True)
        times = np.bincount(at, weights=np.concatenate((np.ones(len(single)), join(many, 5, np.uint32))), minlength=len(keys))
        flags = (times > hot).astype(_U)
        told = times[at[: len(single)]] > 1
        mark = single | flags[at[: len(single)]]
        return (keys, flags), _found(join(one, 3, np.int64)[told], join(one, 4, np.uint32)[told], mark[told])

    def known(table: tuple, row: tuple) -> Iterator[pa.RecordBatch]:
        key = tx.from_planes(row[2], _U)
        yield from _found(tx.from_planes(row[3]), tx.from_planes(row[4], np.uint32), key | table[1][np.searchsorted(table[0], key)])

    return lambda batches: _buckets(batches, begin, known)


# -- segments around shared anchors


def _segment_entries(buckets: int):
    def pack(entries: list[tuple], kind: int) -> Iterator[pa.RecordBatch]:
        """entries: (bucket, bytes or None, windows, id, sum, start)."""
        entries.sort(key=lambda e: e[0])
        bucket = np.array([e[0] for e in entries], np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(entries)]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = entries[a:b]
            column = lambda k, t: tx.planes(np.array([e[k] for e in part], t))  # noqa: E731, B023
            texts = b"" if kind == _KNOWN else b"".join(e[1] for e in part)
            row = (part[0][0], kind, texts, column(2, np.uint32), column(3, np.int64), column(4, np.uint32), column(5, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _SENT, strict=True)], schema=_SENT)

    def flush(seen: dict[bytes, list], windows: dict[bytes, list], known: list[tuple]) -> Iterator[pa.RecordBatch]:
        for have, one, many in ((seen, _ONE, _MANY), (windows, _ONE_WINDOW, _MANY_WINDOW)):
            parts: tuple[list, list] = ([], [])
            for text, (bucket, n, own, crc, at, more) in have.items():
                parts[more].append((bucket, text, n, own, crc, at))
                if more:
                    known.append((bucket, None, n, own, crc, at))
            for kind, entries in ((one, parts[0]), (many, parts[1])):
                if entries:
                    yield from pack(entries, kind)
        if known:
            yield from pack(known, _KNOWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, windows, known = {}, {}, []

        def meet(have: dict[bytes, list], text: bytes, *entry: int) -> None:
            before = have.get(text)
            if before is None:
                have[text] = [*entry, False]
            else:
                before[-1] = True
                known.append((entry[0], None, *entry[1:]))

        for batch in batches:
            own, crc = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for first, place, data, offsets in _slices(batch.column(2)):
                marks = np.unique(_flat(batch.column(3).slice(first, len(offsets) - 1))[1])
                if not len(marks):
                    continue
                shared, hot = marks & ~_U(1), (marks & _U(1)).astype(bool)
                runs = anchor_runs(data, offsets)
                at = np.minimum(np.searchsorted(shared, runs.key), len(shared) - 1)
                mine = np.flatnonzero(shared[at] == runs.key)
                raw = data.tobytes()
                row = first + runs.doc[mine]
                begin = runs.start[mine]
                fields = (tx.bucket_of(runs.key[mine], buckets), begin, runs.n[mine], own[row], crc[row], begin - offsets[runs.doc[mine]] + place, hot[at[mine]])
                for bucket, a, n, i, c, start, split in zip(*(f.tolist() for f in fields), strict=True):
                    if not split:
                        meet(seen, raw[a : a + n + WINDOW - 1], bucket, n, i, c, start)
                        continue
                    for k in range(n):
                        digest = xxhash.xxh3_128_digest(raw[a + k : a + k + WINDOW])
                        meet(windows, digest, int.from_bytes(digest[:4], "big") * buckets >> 32, 1, i, c, start + k)
                if len(seen) + len(windows) + len(known) >= FLUSH_SEGMENTS:
                    yield from flush(seen, windows, known)
                    seen, windows, known = {}, {}, []
        yield from flush(seen, windows, known)

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a column of lists; null is an empty list."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return np.repeat(np.arange(len(lists)), sizes), flat.view(_U)


# -- suffix sorting


def _characters(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as integers in the order of the bytes."""
    return np.ndarray((len(data) - 7,), ">u8", np.ascontiguousarray(data).data, strides=(1,))


def _split(order: np.ndarray, group: np.ndarray, slots: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts the suffixes in ``slots`` by key inside their groups; each run of equal keys becomes a group.

    Returns the keys in the new order, the first index of each run and its size.
    """
    if len(slots) and group[slots[0]] == group[slots[-1]]:
        by = np.argsort(key, kind="stable")
    else:
        by = np.lexsort((key, group[slots]))
    order[slots], key = order[slots[by]], key[by]
    own = group[slots]
    new = np.ones(len(slots), bool)
    new[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(slots)))
    group[slots] = np.repeat(slots[first], size)
    return key, first, size


def sorted_suffixes(data: np.ndarray, places: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Indices of ``places`` in the order of the ``depth`` bytes from each on, and the group of each in that order.

    Members of a group agree in all ``depth`` bytes; a group's number is its first slot.
    """
    n = len(places)
    order, group, slots = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    if not n:
        return order, group
    characters = _characters(data)

    # shallow: multikey quicksort, a character of all open groups at a time
    for at in range(0, SHALLOW, 8):
        _, _, size = _split(order, group, slots, characters[places[order[slots]] + at].astype(_U))
        slots = slots[np.repeat(size > 1, size)]
        if not len(slots):
            return order, group

    # deep: blind tries, the path of each group's first suffix at a time
    agreed = np.full(len(slots), SHALLOW)
    ends = _U(1) << (np.arange(1, 8, dtype=_U) * _U(8))
    while len(slots):
        mine = places[order[slots]]
        first = np.flatnonzero(np.concatenate(([True], np.diff(group[slots]) != 0)))
        path = np.repeat(mine[first], np.diff(np.append(first, len(slots))))
        common = np.full(len(slots), depth)
        live, at = np.flatnonzero(mine != path), agreed.copy()
        while len(live):
            off = np.minimum(at[live], depth - 8)
            apart = (characters[mine[live] + off] ^ characters[path[live] + off]).astype(_U)
            parted = np.flatnonzero(apart)
            common[live[parted]] = off[parted] + 7 - np.searchsorted(ends, apart[parted], side="right")
            on = (apart == 0) & (off < depth - 8)
            at[live[on]] = off[on] + 8
            live = live[on]
        # those that leave the path with a lesser byte, the path itself, the others
        leaves = np.flatnonzero(common < depth)
        rank = np.full(len(slots), 256 * depth)
        byte, on_path = data[mine[leaves] + common[leaves]].astype(np.int64), data[path[leaves] + common[leaves]]
        rank[leaves] = np.where(byte < on_path, 256 * common[leaves] + byte, 256 * (2 * depth - common[leaves]) + byte)
        rank, first, size = _split(order, group, slots, rank)
        open_ = (size > 1) & (rank[first] != 256 * depth)
        branch = rank[first] // 256
        branch = np.where(branch > depth, 2 * depth - branch, branch)
        agreed = np.repeat((branch + 1)[open_], size[open_])
        slots = slots[np.repeat(open_, size)]
    return order, group


def repeated_windows(data: np.ndarray, windows: np.ndarray, several: np.ndarray) -> np.ndarray:
    """For each window of each segment in turn: whether it occurs twice, or in a segment that stands for several.

    Segments lie in ``data`` one after another, each with WINDOW - 1 bytes more than it has windows.
    """
    begin = np.concatenate(([0], np.cumsum(windows + WINDOW - 1)))[:-1]
    before = np.concatenate(([0], np.cumsum(windows)))
    places = np.arange(before[-1]) + np.repeat(begin - before[:-1], windows)
    order, group = sorted_suffixes(data, places)
    size = np.bincount(group, minlength=len(group))
    size += np.bincount(group, weights=np.repeat(several, windows)[order], minlength=len(group)).astype(np.int64)
    again = np.zeros(len(places), bool)
    again[order] = size[group] > 1
    return again


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sum, run) of repeated windows; rows come sorted by bucket and kind."""

    def told(own: np.ndarray, crc: np.ndarray, start: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from _found(own, crc, ((start << _RUN_BITS) | n).view(_U))

    def begin(held: list) -> tuple[None, Iterator[pa.RecordBatch]]:
        def answers() -> Iterator[pa.RecordBatch]:
            for one, many in ((_ONE, _MANY), (_ONE_WINDOW, _MANY_WINDOW)):
                rows = [r for r in held if r[1] in (one, many)]
                if not rows:
                    continue
                column = lambda at, kind: np.concatenate([tx.from_planes(r[at], kind) for r in rows])  # noqa: E731, B023
                windows, own, crc, start = column(3, np.uint32).astype(np.int64), column(4, np.int64), column(5, np.uint32), column(6, np.int64)
                several = np.concatenate([np.full(len(r[3]) // 4, r[1] == many) for r in rows])
                data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
                if one == _ONE:
                    again = repeated_windows(data, windows, several)
                else:
                    _, at = np.unique(data.view("V16"), return_inverse=True)
                    again = (np.bincount(at) + np.bincount(at, weights=several))[at] > 1
                segment = np.repeat(np.arange(len(windows)), windows)
                mine = np.flatnonzero(again & ~several[segment])
                if not len(mine):
                    continue
                new = np.flatnonzero(np.concatenate(([True], (np.diff(mine) != 1) | (np.diff(segment[mine]) != 0))))
                seg = segment[mine[new]]
                inside = mine[new] - (np.cumsum(windows) - windows)[seg]
                yield from told(own[seg], crc[seg], start[seg] + inside, np.diff(np.append(new, len(mine))))

        return None, answers()

    def known(_: None, row: tuple) -> Iterator[pa.RecordBatch]:
        yield from told(tx.from_planes(row[4]), tx.from_planes(row[5], np.uint32), tx.from_planes(row[6]), tx.from_planes(row[3], np.uint32).astype(np.int64))

    yield from _buckets(batches, begin, known)


# -- the texts


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        lists = batch.column(2)
        row, run = _flat(lists)
        run = run.view(np.int64)
        cut = np.searchsorted(row, np.arange(len(batch) + 1))
        for k, text in enumerate(batch.column(1).cast(pa.large_binary())):
            data = text.as_py() or b""
            own = np.sort(run[cut[k] : cut[k + 1]])
            if not len(own):
                spans, kept = 0, data
            else:
                start = own >> _RUN_BITS
                end = np.maximum.accumulate(start + (own & ((1 << _RUN_BITS) - 1)) + WINDOW - 1)
                new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
                start, end = start[new].tolist(), end[np.append(new[1:] - 1, len(end) - 1)].tolist()
                spans, kept = len(start), b"".join(data[a:b] for a, b in zip([0, *end], [*start, len(data)], strict=True))
            for name, v in zip(out, (len(data), len(data) - len(kept), spans, kept), strict=True):
                out[name].append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.large_binary())],
            names=["_own", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and the kept bytes of each document; n_spans counts maximal removed runs."""
    spark = docs.sparkSession
    buckets, parts = tx.bucket_count(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.col(id_col).cast("long")
    # a row is told by its id and its text's checksum, without an id by two checksums
    texts = docs.select(F.coalesce(own, F.xxhash64(text)).alias("_id"), F.crc32(text.cast("binary")).alias("_sum"), own.alias("_own"), text.alias("_text"))

    def answered(sent: DataFrame, decide) -> DataFrame:
        dealt = sent.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "kind")
        return dealt.mapInArrow(decide, "_id long, _sum long, key long").groupBy("_id", "_sum").agg(F.collect_list("key").alias("keys"))  # of one document

    anchors = texts.select("_id", "_sum", "_text").mapInArrow(_anchor_entries(buckets), _ASKED_DDL)
    near = texts.join(answered(anchors, _shared_anchors(HOT)), ["_id", "_sum"], "left").select("_id", "_sum", "_text", "keys")
    segments = near.mapInArrow(_segment_entries(2 * buckets), _SENT_DDL)  # texts take more room than keys
    covered = texts.join(answered(segments, _repeats), ["_id", "_sum"], "left").select("_own", "_text", "keys")
    return covered.mapInArrow(_kept_rows, "_own long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("_own", id_col)
