"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit set where more than half of its word shingles'
XXH64 values have it. Distinct fingerprints are ordered by population count and
cut into blocks of one size; pairs of blocks whose counts come within the radius
are compared, each in a task. There, tiles are compared in full with numpy's
exclusive-or and bit counts, unless population counts put them further apart
than the radius: for small radii tiles share the counts of all four quarters of
the bits, whose differences add up. A pair of blocks returns a spanning forest of
its links, never all of them, and the forests' components are joined by star
contraction.

Defined results: null and empty texts have the fingerprint zero and are linked
like any other; a text of fewer words than a shingle is one shingle. Repeated
rows share a fingerprint. An empty table gives an empty result. Only the named
id and text columns are read. Rows with a null id get a fingerprint and no
component.

``copies`` is for dropping: links come from a 64-bit and a 256-bit fingerprint at
radii that reach the wanted similarity, and every document that goes has been
compared exactly, shingle set by shingle set, with one that stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnlake.llm.components import components
from turnlake.llm.shared import stored
from turnlake.llm.text import mix

SEED = 42
#: Fingerprints in a tile, and rows of a tile compared at once.
TILE, STRIP = 4096, 256
#: Most and least fingerprints in a block, the unit that is shipped between tasks, and blocks in between.
BLOCK, LEAST_BLOCK, BLOCKS = 131_072, 4_096, 24
#: Up to this radius tiles follow the counts of the quarters.
QUARTERS = 8

#: Least similarity of shingle sets of copies, and the radii that reach it: at 0.8 two texts differ in 10 of 64
#: and 39 of 256 bits on average (deviations 3 and 6), and in more where they have few shingles.
SIMILARITY, RADIUS, WIDE_RADIUS, WIDE = 0.8, 20, 72, 4
#: Members of a group that are compared in one task, and those that decide first in a larger group; bytes of
#: their shingle sets that meet in a task, and parts in which a large group's first members are looked for.
SMALL, LEADERS, GROUP_BYTES, SALTS = 2048, 1024, 64 << 20, 64
#: Similar pairs of a group that are settled in one task.
PAIRS = 500_000
#: Cells of the histogram of a set's hashes that bounds what two sets can share.
CELLS = 512


def shingle_hashes(text: str | None, shingle: int = 4) -> list[int]:
    """XXH64 of every run of so many words; of all words where there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hash_of = xxhash.xxh64_intdigest
        hashes = [
            hash_of(joined[a:b], SEED)
            for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        ]
    return hashes


def _majority(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(1, "<u8")
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    return int(_majority(np.array(shingle_hashes(text, shingle), np.uint64))[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["_id", "fp"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = picked.schema["_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"_id {kind}, fp long")


def _forest(a: np.ndarray, b: np.ndarray, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (node, its root), over nodes numbered through a then b."""
    label = np.arange(len(a) + len(b))
    for i, j in links:
        while True:
            low = np.minimum(label[i], label[j])
            if (label[i] == low).all() and (label[j] == low).all():
                break
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            while (label[label] != label).any():
                label = label[label]
    node = np.flatnonzero(label != np.arange(len(label)))
    return node, label[node]


def _compared(a: np.ndarray, rows: np.ndarray, b: np.ndarray, columns: np.ndarray, same: bool, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius of a tile of a and a tile of b."""
    for at in range(0, len(rows), STRIP):
        for left in range(0, len(columns), TILE):
            row, column = rows[at : at + STRIP], columns[left : left + TILE]
            i, j = np.nonzero(np.bitwise_count(a[row][:, None] ^ b[column][None]) <= radius)
            i, j = row[i], column[j]
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j + (0 if same else len(a))


def _tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius; a and b are in the order of their population counts."""
    if radius <= QUARTERS:
        quarters = lambda x: np.bitwise_count(x.view(np.uint16)).reshape(-1, 4).astype(np.int16)
        kinds_a, of_a = np.unique(quarters(a), axis=0, return_inverse=True)
        kinds_b, of_b = np.unique(quarters(b), axis=0, return_inverse=True)
        of_a, of_b = of_a.ravel(), of_b.ravel()
        order, most = np.argsort(of_a, kind="stable"), np.arange(len(kinds_b))
        for kind, rows in zip(kinds_a, np.split(order, np.flatnonzero(np.diff(of_a[order])) + 1), strict=True):
            near = np.zeros(len(most), bool)
            near[np.abs(kinds_b - kind).sum(1) <= radius] = True
            yield from _compared(a, rows, b, np.flatnonzero(near[of_b]), same, radius)
        return
    count_a, count_b = np.bitwise_count(a).astype(int), np.bitwise_count(b).astype(int)
    for at in range(0, len(a), STRIP):
        rows = np.arange(at, min(at + STRIP, len(a)))
        first = int(np.searchsorted(count_b, count_a[rows[0]] - radius, "left"))
        last = int(np.searchsorted(count_b, count_a[rows[-1]] + radius, "right"))
        yield from _compared(a, rows, b, np.arange(max(first, at if same else 0), last), same, radius)


def _gathered(links: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same links in fewer and larger parts."""
    held, size = [], 0
    for link in links:
        held.append(link)
        size += len(link[0])
        if size >= 1 << 16:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _also_near(near: Iterator[tuple], wide: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, j in near:
        kept = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1, dtype=np.int64) <= radius
        if kept.any():
            yield i[kept], j[kept]


def _packed(blocks: DataFrame) -> DataFrame:
    """Rows (block, fps, reps, wides) of at most a batch of fingerprints each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rep, wide = batch.column(2).to_numpy(), batch.column(3).to_pylist()
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            parts = [p for p in np.split(order, cuts) if len(p)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(block[p[0]]) for p in parts], pa.int32()),
                    pa.array([fp[p].tobytes() for p in parts], pa.binary()),
                    pa.array([rep[p].tobytes() for p in parts], pa.binary()),
                    pa.array([b"".join(wide[i] for i in p) for p in parts], pa.binary()),
                ],
                names=["block", "fps", "reps", "wides"],
            )

    return blocks.mapInArrow(run, "block int, fps binary, reps binary, wides binary")


def links(distinct: DataFrame, radius: int = 4, wide_radius: int | None = None) -> DataFrame:
    """Forest edges (u, v) of all links between distinct fingerprints (fp, rep); rep is a long.

    With a second radius, a further fingerprint (wide, binary) has to be that near too.

    Blocks follow the population counts: 65 totals give each fingerprint its
    share of the ordered list, and the hash spreads those of one count. The
    pairs of blocks are a table of their own.
    """
    spark = distinct.sparkSession
    ones = F.bit_count("fp").cast("int")
    totals = {r[0]: r[1] for r in distinct.groupBy(ones.alias("ones")).count().collect()}
    total = sum(totals.values())
    if total < 2:
        return spark.createDataFrame([], "u long, v long")
    blocks = -(-total // min(BLOCK, max(LEAST_BLOCK, total // BLOCKS)))
    before, table, spread = 0, [], []
    for count in range(65):
        n = totals.get(count, 0)
        table.append((before, n))
        if n:
            spread.append((count, before * blocks // total, min(blocks - 1, (before + n) * blocks // total)))
        before += n
    starts = F.array(*[F.lit(x).cast("double") for x, _ in table])
    sizes = F.array(*[F.lit(n).cast("double") for _, n in table])
    share = F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    place = F.element_at(starts, ones + 1) + share * F.element_at(sizes, ones + 1)
    block = F.least(F.lit(blocks - 1), F.floor(place * blocks / total).cast("int"))
    wide = F.lit(b"").alias("wide") if wide_radius is None else F.col("wide")
    packed = stored(_packed(distinct.select(block.alias("block"), "fp", F.col("rep").cast("long").alias("rep"), wide)))
    # which blocks hold which counts, and from that the pairs of blocks to compare
    held = spark.createDataFrame(spread, "ones int, low int, high int").select("ones", F.explode(F.sequence("low", "high")).alias("b"))
    reach = F.explode(F.sequence(F.col("ones") - radius, F.col("ones") + radius))
    pairs = held.select(F.col("b").alias("a"), reach.alias("ones")).distinct().join(held, "ones").filter("a <= b").select("a", "b").distinct()
    met = packed.join(pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")), "block")

    def compare(table: pa.Table) -> pa.Table:
        sides: dict[int, list] = {}
        for block, fps, reps, wides in zip(*(table.column(c).to_pylist() for c in ("block", "fps", "reps", "wides")), strict=True):
            fp = np.frombuffer(fps, np.uint64)
            sides.setdefault(block, []).append((fp, np.frombuffer(reps, np.int64), np.frombuffer(wides, np.uint64).reshape(len(fp), -1)))
        ready = []
        for key in sorted(sides):
            fp, rep, wide = (np.concatenate(x) for x in zip(*sides[key], strict=True))
            order = np.lexsort((fp, np.bitwise_count(fp)))
            ready.append((fp[order], rep[order], wide[order]))
        (a, rep_a, wide_a), (b, rep_b, wide_b) = ready[0], ready[-1]
        same = table.column("a")[0] == table.column("b")[0]
        if not same and len(ready) < 2:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        rep = rep_a if same else np.concatenate((rep_a, rep_b))
        near = _tile_links(a, b, same, radius)
        if wide_radius is not None:
            near = _also_near(near, wide_a if same else np.concatenate((wide_a, wide_b)), wide_radius)
        node, root = _forest(a, b[:0] if same else b, _gathered(near))
        return pa.table({"u": rep[node], "v": rep[root]})

    # dealt by number, so that few and small rows are not put together into few tasks; no more parts than pairs, since the driver keeps an account of each
    parts = min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), blocks * (blocks + 1) // 2)
    return met.repartition(parts, "a", "b").groupBy("a", "b").applyInArrow(compare, "u long, v long")


def near_duplicates(
    docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp, component): component is the least id reachable over links, the own one included."""
    marked = stored(fingerprints(docs, shingle, id_col, text_col))
    distinct = stored(marked.filter("_id is not null").groupBy("fp").agg(F.min("_id").alias("rep")))
    found = components(links(distinct, radius))
    classes = distinct.join(found, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "rep").alias("component")
    )
    return marked.join(classes, "fp", "left").select(
        F.col("_id").alias(id_col), "fp", F.when(F.col("_id").isNotNull(), F.col("component")).alias("component")
    )


def _marked(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, wides, keys = [], [], []
            for t in batch.column(1):
                hashes = np.array(shingle_hashes(t.as_py(), shingle), np.uint64)
                fps.append(int(_majority(hashes).view(np.int64)[0]))
                wides.append(b"".join(_majority(mix(hashes ^ mix(np.full(1, k, np.uint64)))).tobytes() for k in range(1, WIDE + 1)))
                keys.append(xxhash.xxh3_128_digest(np.unique(hashes).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps, pa.int64()), pa.array(wides, pa.binary()), pa.array(keys, pa.binary())], names=["_id", "fp", "wide", "key"]
            )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array(shingle_hashes(t.as_py(), shingle), np.uint64)).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["root", "_id", "shingles"])

    return run


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets share so large a part of their union; two empty ones do."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    if not len(a):
        return True
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both >= least * (len(a) + len(b) - both)


def _prefixes(least: float):
    """Of each set the least hashes, so many that two sets so similar have one of them in common.

    Rows (root, hash, u) with the least id of a hash's holders in a batch, and rows (u, v) that link its other holders
    to that one, so that of a hash, however frequent, a row for each batch is dealt out.
    """

    def linked(root: np.ndarray, own: np.ndarray, size: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        root, own = np.repeat(root, size), np.repeat(own, size)
        order = np.lexsort((own, first, root))
        root, own, first = root[order], own[order], first[order]
        new = np.ones(len(own), bool)
        new[1:] = (root[1:] != root[:-1]) | (first[1:] != first[:-1])
        links = np.unique(np.stack((own, own[new][np.cumsum(new) - 1]))[:, ~new], axis=1)
        none = pa.nulls(links.shape[1], pa.int64())
        columns = (pa.array(root[new]), none), (pa.array(first[new]), none), (pa.array(own[new]), pa.array(links[0])), (pa.nulls(new.sum(), pa.int64()), pa.array(links[1]))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["root", "hash", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            firsts, at, size = [], 0, 0
            for k, shingles in enumerate(batch.column(2)):
                whole = np.frombuffer(shingles.as_buffer(), np.int64)  # sorted as unsigned numbers
                firsts.append(whole[: len(whole) - int(np.ceil(least * len(whole) - 1e-6)) + 1])
                size += len(firsts[-1])
                if size >= 1 << 18 or k + 1 == batch.num_rows:
                    yield linked(roots[at : k + 1], ids[at : k + 1], np.array([len(x) for x in firsts]), np.concatenate(firsts))
                    firsts, at, size = [], k + 1, 0

    return run


def _nearer(loose: DataFrame, least: float) -> DataFrame:
    """The groups cut into those whose members hang together by hashes that similar sets must share; members with none are left out.

    Fingerprints of short texts come near each other by chance, and such links make groups that grow faster than the
    input; what shares no hash is not similar, however many links there are.
    """
    hashes = stored(loose.mapInArrow(_prefixes(least), "root long, hash long, u long, v long"))
    heads = hashes.filter("v is null").drop("v")
    holder = heads.groupBy("root", "hash").agg(F.min("u").alias("v"))
    edges = heads.join(holder, ["root", "hash"]).select("u", "v").unionAll(hashes.filter("v is not null").select("u", "v"))
    return components(edges).join(loose.drop("root"), F.col("node") == F.col("_id")).select("root", "_id", "shingles")


def _candidates(sets: list[np.ndarray], least: float):
    """(k, rows): those of the rows, in their order, whose sets may be so similar to set k.

    Two sets share no more hashes than the lesser counts of their cells add up to.
    """
    sizes = np.array([len(s) for s in sets])
    cells = np.array([np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).clip(max=65535) for s in sets], np.uint16).reshape(-1, CELLS)
    full = sizes > 65535  # a cell's count may be cut off

    def of(k: int, rows: np.ndarray) -> np.ndarray:
        rows = rows[(np.minimum(sizes[rows], sizes[k]) >= least * np.maximum(sizes[rows], sizes[k]))]
        most = np.minimum(cells[rows], cells[k]).sum(axis=1, dtype=np.int64)
        return rows[(most * (1 + least) >= least * (sizes[rows] + sizes[k]) - 1e-6) | full[rows] | full[k]]

    return of


def _decide(least: float):
    """Rows that lead stay as they are; every other, by id, is a copy of the first kept row that it is similar to, or is kept itself.

    With leaders, a row without one is not decided and is not compared with the
    others.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, leads = table.column("_id").to_pylist(), table.column("lead").to_pylist()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        near, led = _candidates(sets, least), any(leads)
        kept, n, of = np.zeros(len(ids), np.int64), 0, [None] * len(ids)
        for k in sorted(range(len(ids)), key=lambda k: (not leads[k], ids[k])):
            if not leads[k]:
                of[k] = next((ids[j] for j in near(k, kept[:n]).tolist() if ids[j] != ids[k] and similar(sets[k], sets[j], least)), None)
            if leads[k] or (of[k] is None and not led):
                kept[n] = k
                n += 1
        return table.select(["root", "_id", "shingles", "n", "lead"]).append_column("copy_of", pa.array(of, pa.int64()))

    return run


def _pairs(least: float):
    """(root, u, v): the similar pairs, u the lesser id, of two blocks of a group, or within one."""

    def run(table: pa.Table) -> pa.Table:
        ids, block = table.column("_id").to_numpy(), table.column("block").to_numpy()
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        near, rows, others = _candidates(sets, least), np.flatnonzero(block == a), np.flatnonzero(block == b)
        found = [(k, j) for k in rows.tolist() for j in near(k, others[ids[others] > ids[k]] if a == b else others).tolist() if similar(sets[k], sets[j], least)]
        i, j = ids[np.array(found, np.int64).reshape(-1, 2)].T
        return pa.table({"root": pa.array(np.full(len(i), table.column("root")[0].as_py()), pa.int64()), "u": np.minimum(i, j), "v": np.maximum(i, j)})

    return run


def _settle(table: pa.Table) -> pa.Table:
    """(_id, copy_of) by the pairs of a group: by id, a row goes if its like of a lesser id stays."""
    gone: dict[int, int] = {}
    u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
    order = np.lexsort((u, v))
    for a, b in zip(u[order].tolist(), v[order].tolist(), strict=True):
        if a not in gone and b not in gone:
            gone[b] = a
    return pa.table({"_id": pa.array(gone.keys(), pa.int64()), "copy_of": pa.array(gone.values(), pa.int64())})


def _settled(pairs: DataFrame) -> list[DataFrame]:
    """Frames (_id, copy_of) of the rows that go.

    A group of up to ``PAIRS`` pairs is settled in a task; of more pairs, rows without a lesser like stay, theirs go, and
    what is left is looked at again: for ids in no order, rounds by the logarithm of the members.
    """
    done = []
    while True:
        sizes = stored(pairs.groupBy("root").agg(F.count(F.lit(1)).alias("n")))
        few = pairs.join(sizes.filter(F.col("n") <= PAIRS), "root", "left_semi")
        done.append(few.groupBy("root").applyInArrow(_settle, "_id long, copy_of long"))
        if sizes.filter(F.col("n") > PAIRS).isEmpty():
            return done
        many = pairs.join(sizes.filter(F.col("n") > PAIRS), "root", "left_semi")
        stay = many.select("u").distinct().join(many.select(F.col("v").alias("u")), "u", "left_anti")
        gone = stored(many.join(stay, "u").groupBy(F.col("v").alias("_id")).agg(F.min("u").alias("copy_of")))
        done.append(gone)
        for end in ("u", "v"):
            many = many.join(gone.select(F.col("_id").alias(end)), end, "left_anti")
        pairs = stored(many.select("root", "u", "v"))


def _first(large: DataFrame) -> DataFrame:
    """(root, _id) of the least ids of each group: ``LEADERS`` of them, or as many as fill half of ``GROUP_BYTES``.

    Only ids and sizes are ordered. Each of ``SALTS`` parts of a group leaves out what cannot be among its first,
    so that few rows of a group, however large, meet in the last step.
    """
    rows = large.select("root", "_id", F.octet_length("shingles").cast("long").alias("bytes")).withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
    for keys in (("root", "salt"), ("root",)):
        order = Window.partitionBy(*keys).orderBy("_id")
        rows = rows.withColumn("_r", F.row_number().over(order)).withColumn("_b", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        # the row that fills the bytes stays, so that whatever follows a row left out here is left out below
        rows = rows.filter((F.col("_r") <= LEADERS) & (F.col("_b") - F.col("bytes") <= GROUP_BYTES // 2)).drop("_r", "_b")
    return rows.select("root", "_id")


def copies(
    docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, radius: int = RADIUS, wide_radius: int = WIDE_RADIUS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, copy_of): documents to drop, each with one of a lesser id that stays and is that similar; ids are longs.

    Texts of one shingle set are copies of the least id, which may itself go. Groups of linked texts up to ``SMALL`` members and
    ``GROUP_BYTES`` of shingle sets are decided in a task each. Larger ones are first cut where no hash is shared; in
    those still larger the least ids are decided, all others compared with those that stay, in parts, and what is left
    by pairs of blocks. So steps grow with the logarithm of a group's members at most. A text whose set is larger than
    that alone is compared whole. Rows with a null id are left out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).filter("_id is not null")
    marked = stored(rows.mapInArrow(_marked(shingle), "_id long, fp long, wide binary, key binary"))
    distinct = stored(marked.groupBy("key").agg(F.min(F.struct("_id", "fp", "wide")).alias("m")).select("key", "m.*"))
    same = marked.join(distinct.select("key", F.col("_id").alias("copy_of")), "key").filter("_id <> copy_of").select("_id", "copy_of")
    found = components(links(distinct.select("fp", "wide", F.col("_id").alias("rep")), radius, wide_radius))
    linked = found.join(rows, F.col("node") == F.col("_id")).select("root", "_id", "_text")
    left = stored(linked.mapInArrow(_sets(shingle), "root long, _id long, shingles binary"))
    shape = "root long, _id long, shingles binary, n long, lead boolean, copy_of long"
    # a group's members count as its parts of SMALL members or GROUP_BYTES, whichever are more
    parts = F.greatest(F.count(F.lit(1)) / SMALL, F.sum(F.octet_length("shingles").cast("long")) / GROUP_BYTES)
    count = lambda members, share=1: stored(members.groupBy("root").agg(parts.alias("parts")).select("root", F.ceil(F.col("parts") * share).alias("n")))
    decided = lambda members: members.withColumn("lead", F.lit(False)).groupBy("root").applyInArrow(_decide(similarity), shape)
    gone = lambda judged: judged.filter("copy_of is not null").select("_id", "copy_of")
    sizes = count(left)
    sized = left.join(sizes, "root")
    near = [gone(decided(sized.filter("n = 1")))]
    if not sizes.filter("n > 1").isEmpty():
        left = stored(_nearer(sized.filter("n > 1").drop("n"), similarity))
        sizes = count(left)
        sized = left.join(sizes, "root")
        near.append(gone(decided(sized.filter("n = 1"))))
    if not sizes.filter("n > 1").isEmpty():
        large = sized.filter("n > 1")
        first = stored(_first(large))
        head = stored(decided(large.join(first, ["root", "_id"])))
        lead = head.filter("copy_of is null").drop("copy_of").withColumn("lead", F.lit(True)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
        rest = large.join(first, ["root", "_id"], "left_anti").withColumn("lead", F.lit(False)).withColumn("part", F.pmod(F.xxhash64("_id"), F.col("n") + 1))
        judged = stored(lead.unionByName(rest).groupBy("root", "part").applyInArrow(_decide(similarity), shape).filter("not lead"))
        left = judged.filter("copy_of is null").select("root", "_id", "shingles")
        # two blocks make a part
        blocks = left.join(count(left, 2), "root").withColumn("block", F.pmod(F.xxhash64("_id"), F.col("n")))
        met = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
            "root", "_id", "shingles", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")
        )
        pairs = stored(met.groupBy("root", "a", "b").applyInArrow(_pairs(similarity), "root long, u long, v long"))
        near += [gone(head), gone(judged), *_settled(pairs)]
    return reduce(DataFrame.unionAll, near, same).withColumnRenamed("_id", id_col)
