"""Exact top-k inner-product search with a ball tree for each shard.

Candidates are dealt into cells around pivots, found by k-means on a sample of
``SAMPLE`` vectors at most, and a large cell into shards by hash; every shard
becomes a ball tree (centres, radii, one array of vectors in leaf order). A
query first searches one shard of its most promising cell. Its kth best result
there is shared with all further searches: only cells whose bound q.p + |q| r
reaches it are visited, and nothing is sent to others. Within a tree a node is
kept while its bound reaches the query's current kth result, ties by the least
id below the node, and leaves are opened in the order of their bounds.

Queries are sent to the trees in blocks of ``BLOCK_ROWS`` at most on average, and
a shard is copied for each block that visits it. There are as few blocks as that
size and the cores to keep busy allow, since copies are what fills disks; vectors
move in the narrowest integers that hold them. Where balls prune nothing, every
block visits every shard, as exact search must.

Components x become floor(64 x); scores are integer inner products, ties go to
the smaller id, and a query is never its own candidate.

Defined results: null vectors and vectors with null or non-finite components
take no part, nor do null ids. Vectors of different lengths are never compared.
Rows with one id are candidates each on its own and asked once each. An empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnlake.llm.shared import stored

LEAF = 128
#: Most vectors of a shard and queries of a block, on average (about 4 MB at 64 components of a byte), and queries searched at once.
SHARD_ROWS, BLOCK_ROWS, STRIP = 65_536, 65_536, 4_096
#: Most cells, vectors for each on average where there are fewer cells, and most vectors that place the pivots.
CELLS, CELL_ROWS, SAMPLE = 512, 32_768, 4_096
_EXACT = float(1 << 53)
_NONE, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_UNIT = ["size", "cell", "shard", "block"]
_ASK = "size int, cell int, shard int, block long, _id long, copy long, _vector binary, least long, floor long"
_FOUND = "size int, cell int, shard int, block long, _id long, copy long, _vector binary, ids array<bigint>, scores array<bigint>"


def build_tree(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """Ball tree over integer vectors: nodes in breadth-first order, vectors in leaf order."""
    points = vectors.astype(np.float64)
    order = np.arange(len(ids))
    nodes, at = [(0, len(ids))], 0
    child = []
    while at < len(nodes):
        a, b = nodes[at]
        at += 1
        if b - a <= LEAF:
            child.append(-1)
            continue
        own = points[order[a:b]]
        far = own[((own - own[0]) ** 2).sum(1).argmax()]
        other = own[((own - far) ** 2).sum(1).argmax()]
        side = own @ (other - far)
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(side, half)]
        child.append(len(nodes))
        nodes += [(a, a + half), (a + half, b)]
    span = np.array(nodes)
    centre = np.array([points[order[a:b]].mean(0) for a, b in nodes])
    radius = np.array([np.sqrt(((points[order[a:b]] - c) ** 2).sum(1).max()) for (a, b), c in zip(nodes, centre, strict=True)])
    least = np.array([ids[order[a:b]].min() for a, b in nodes])
    return {"ids": ids[order], "vectors": vectors[order], "span": span, "child": np.array(child), "centre": centre, "radius": radius, "least": least}


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in floating point where that is exact."""
    widest = lambda x: max(float(x.max(initial=0)), -float(x.min(initial=0)))
    most = widest(queries) * widest(vectors) * queries.shape[1]
    if most < _EXACT:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.astype(np.int64).T


class _Best:
    """The k best (score, id) of each query so far; results beyond (floor, least) are not wanted."""

    def __init__(self, n: int, k: int, floor: np.ndarray, least: np.ndarray):
        self.k, self.floor, self.least = k, floor, least
        self.score, self.id = np.full((n, k), _NONE), np.full((n, k), _LAST)

    def open(self, rows: np.ndarray, bound: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether a node of that bound and least id can better a query's results."""
        score, name = self.score[rows, -1], self.id[rows, -1]
        given = (self.floor[rows] > score) | ((self.floor[rows] == score) & (self.least[rows] < name))
        score, name = np.where(given, self.floor[rows], score), np.where(given, self.least[rows], name)
        return (bound > score) | ((bound == score) & (least < name))

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        wanted = score.max(axis=1) >= np.maximum(self.floor[rows], self.score[rows, -1])
        rows, score, own = rows[wanted], score[wanted], own[wanted]
        same = ids[None] == own[:, None]
        score = np.concatenate((self.score[rows], np.where(same, _NONE, score)), axis=1)
        names = np.concatenate((self.id[rows], np.where(same, _LAST, ids[None])), axis=1)
        best = np.lexsort((names, ~score), axis=1)[:, : self.k]  # ~ turns the order of integers round
        self.score[rows], self.id[rows] = np.take_along_axis(score, best, 1), np.take_along_axis(names, best, 1)


def _bounds(queries: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Most that an integer score can be in each ball."""
    q = queries.astype(np.float64)
    bound = q @ centre.T + np.sqrt((q**2).sum(1))[:, None] * radius[None]
    bound += 1e-9 * (1 + np.abs(bound))  # rounding never prunes a match
    return np.floor(np.clip(bound, -(2.0**62), 2.0**62)).astype(np.int64)


def search(tree: dict, qids: np.ndarray, queries: np.ndarray, floor: np.ndarray, least: np.ndarray, k: int) -> _Best:
    """Branch and bound of a block of queries over one tree."""
    best = _Best(len(qids), k, floor, least)
    bound = _bounds(queries, tree["centre"], tree["radius"])
    leaves = np.flatnonzero(tree["child"] < 0)

    def open_leaf(leaf: int, rows: np.ndarray) -> None:
        a, b = tree["span"][leaf]
        best.add(rows, _scores(queries[rows], tree["vectors"][a:b]), tree["ids"][a:b], qids[rows])

    top = leaves[bound[:, leaves].argmax(1)]
    for leaf in np.unique(top):
        open_leaf(leaf, np.flatnonzero(top == leaf))
    alive = {0: np.arange(len(qids))}
    found: list[tuple[int, np.ndarray]] = []
    for node in range(len(tree["child"])):  # parents come before children
        rows = alive.pop(node, None)
        if rows is None:
            continue
        rows = rows[best.open(rows, bound[rows, node], tree["least"][node])]
        if not len(rows):
            continue
        if tree["child"][node] < 0:
            rows = rows[top[rows] != node]
            if len(rows):
                found.append((node, rows))
        else:
            for c in (tree["child"][node], tree["child"][node] + 1):
                alive[c] = rows
    if found:
        node = np.concatenate([np.full(len(r), n) for n, r in found])
        row = np.concatenate([r for _, r in found])
        order = np.lexsort((-bound[row, node], row))
        node, row = node[order], row[order]
        turn = np.arange(len(row)) - np.searchsorted(row, row)  # each query's leaves by falling bound
        for t in range(int(turn.max()) + 1):
            now_node, now_row = node[turn == t], row[turn == t]
            keep = best.open(now_row, bound[now_row, now_node], tree["least"][now_node])
            now_node, now_row = now_node[keep], now_row[keep]
            for leaf in np.unique(now_node):
                open_leaf(leaf, now_row[now_node == leaf])
    return best


class Cells(NamedTuple):
    """The cells of the vectors of one length."""

    pivots: np.ndarray
    number: np.ndarray  # of those that hold vectors
    radius: np.ndarray
    shards: np.ndarray


def place_pivots(sample: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """k-means centres of a sample; any centres give right results, good ones give small balls."""
    points = sample.astype(np.float64)
    chosen = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)]
    for _ in range(rounds):
        near = nearest(points, chosen)
        sums = np.zeros_like(chosen)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(chosen))
        chosen = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], chosen)
    return chosen


def nearest(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return (points @ pivots.T - (pivots**2).sum(1) / 2).argmax(1)


def _widths(vectors: np.ndarray) -> np.ndarray:
    """Bytes of an integer that holds every component, for each vector."""
    most = np.maximum(vectors.max(axis=1, initial=0), -1 - vectors.min(axis=1, initial=0))
    return np.where(most < 1 << 7, 1, np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8)))


def _narrow(vectors: np.ndarray) -> pa.Array:
    """Each vector as the bytes of its narrowest integers."""
    widths, rows = _widths(vectors), [b""] * len(vectors)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        for k, row in zip(at.tolist(), vectors[at].astype(f"<i{width}"), strict=True):
            rows[k] = row.tobytes()
    return pa.array(rows, pa.binary())


def _wide(column: pa.Array, size: int) -> np.ndarray:
    rows, out = column.to_pylist(), np.zeros((len(column), size), np.int64)
    lengths = np.array([len(r) for r in rows])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        out[at] = np.frombuffer(b"".join(rows[k] for k in at.tolist()), f"<i{length // size}").reshape(-1, size)
    return out


def _by_size(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[pa.RecordBatch | pa.Table, int, np.ndarray]]:
    """The rows of each length of vectors, that length, and the vectors."""
    sizes = rows.column("size").to_numpy()
    for size in np.unique(sizes):
        part = rows.take(pa.array(np.flatnonzero(sizes == size)))
        vectors = part.column("_vector")
        vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        if pa.types.is_binary(vectors.type):
            yield part, int(size), _wide(vectors, int(size))
            continue
        yield part, int(size), vectors.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size)


def _assigned(rows: DataFrame, shared) -> DataFrame:
    """Each vector's cell and its distance from the pivot; lengths that the sample lacks have one cell round 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, size, vectors in _by_size(batch):
                pivots = shared.value.get(size, np.zeros((1, size)))
                points = vectors.astype(np.float64)
                cell = nearest(points, pivots)
                far = np.sqrt(((points - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("size"), pa.array(cell, pa.int32()), pa.array(far), part.column("_id"), _narrow(vectors)],
                    names=["size", "cell", "far", "_id", "_vector"],
                )

    return rows.mapInArrow(run, "size int, cell int, far double, _id long, _vector binary")


def _ask_rows(part, size: int, queries: np.ndarray, cell: np.ndarray, shard: np.ndarray, row: np.ndarray, least: np.ndarray, floor: np.ndarray) -> pa.RecordBatch:
    at = pa.array(row)
    columns = [part.column(c).take(at) for c in ("block", "_id", "copy")]
    columns.append((part.column("_vector") if pa.types.is_binary(part.column("_vector").type) else _narrow(queries)).take(at))
    head = [pa.array(np.full(len(row), size), pa.int32()), pa.array(cell, pa.int32()), pa.array(shard, pa.int32())]
    return pa.RecordBatch.from_arrays([*head, *columns, pa.array(least), pa.array(floor)], names=[c.split()[0] for c in _ASK.split(", ")])


def _home(shared):
    """One shard of each query's most promising cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, size, queries in _by_size(batch):
                if size in shared.value:
                    c: Cells = shared.value[size]
                    cell = (queries @ c.pivots.T).argmax(1)
                    shard = part.column("copy").to_numpy() % c.shards[cell]
                    rows = np.arange(len(cell))
                    yield _ask_rows(part, size, queries, c.number[cell], shard, rows, np.full(len(rows), _LAST), np.full(len(rows), _NONE))

    return run


def _others(shared, k: int):
    """All further shards that can better what each query found at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, size, queries in _by_size(batch):
                c: Cells = shared.value[size]
                kth = [(s[k - 1], i[k - 1]) if len(s) >= k else (_NONE, _LAST) for s, i in zip(part.column("scores").to_pylist(), part.column("ids").to_pylist(), strict=True)]
                floor, least = np.array(kth, np.int64).reshape(-1, 2).T
                row, at = np.nonzero(_bounds(queries, c.pivots, c.radius) >= floor[:, None])
                times = c.shards[at]
                row, at = np.repeat(row, times), np.repeat(at, times)
                shard = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                home = (c.number[at] == part.column("cell").to_numpy()[row]) & (shard == part.column("shard").to_numpy()[row])
                row, at, shard = row[~home], at[~home], shard[~home]
                for a in range(0, len(row), 8192):
                    r = row[a : a + 8192]
                    yield _ask_rows(part, size, queries, c.number[at[a : a + 8192]], shard[a : a + 8192], r, least[r], floor[r])

    return run


def _searched(asks: DataFrame, trees: DataFrame, k: int, parts: int) -> DataFrame:
    """The asks with the best (ids, scores) of their shard, a task for each share of (shard, block)."""

    def run(queries: pa.Table, tree: pa.Table) -> pa.Table:
        n, own = queries.num_rows, queries.column("_id").to_numpy()
        if not n or not tree.num_rows:
            none = pa.array([[]] * n, pa.list_(pa.int64()))
            found, scores = none, none
        else:
            (_, _, vectors), = _by_size(queries)
            ball, floors, leasts = pickle.loads(tree.column("data")[0].as_py()), *(queries.column(c).to_numpy() for c in ("floor", "least"))
            counts, names, values = [], [], []
            for at in range(0, n, STRIP):
                some = slice(at, at + STRIP)
                best = search(ball, own[some], vectors[some], floors[some], leasts[some], k)
                floor, least = (x[:, None] for x in (best.floor, best.least))
                held = (best.id != _LAST) & ((best.score > floor) | ((best.score == floor) & (best.id < least)))
                counts.append(held.sum(1))
                names.append(best.id[held])
                values.append(best.score[held])
            ends = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(counts)))), pa.int32())
            found, scores = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (names, values))
        return queries.select(["size", "cell", "shard", "block", "_id", "copy", "_vector"]).append_column("ids", found).append_column("scores", scores)

    # other names: both sides come from the same asks
    renamed = {c: f"to_{c}" for c in _UNIT}
    units = asks.select(*_UNIT).distinct().withColumnsRenamed(renamed)
    met = trees.withColumnsRenamed(renamed).join(units, ["to_size", "to_cell", "to_shard"])
    dealt = lambda rows, keys: rows.repartition(parts, *keys).groupBy(*keys)
    return dealt(asks, _UNIT).cogroup(dealt(met, [*renamed.values()])).applyInArrow(run, _FOUND)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates, the query's own id excepted."""
    spark = vectors.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def clean(rows: DataFrame) -> DataFrame:
        vector = F.col(vector_col).cast("array<double>")
        usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return (
            rows.select(F.col(id_col).cast("long").alias("_id"), vector.alias("_raw"), F.coalesce(usable, F.lit(False)).alias("_ok"))
            .filter("_ok and _id is not null and size(_raw) > 0")
            .select("_id", F.size("_raw").alias("size"), F.transform("_raw", lambda x: F.floor(x * 64).cast("long")).alias("_vector"))
        )

    def pack(table: pa.Table) -> pa.Table:
        (part, _, points), = _by_size(table)
        order = np.argsort(part.column("_id").to_numpy(), kind="stable")
        width = _widths(points).max()
        data = pickle.dumps(build_tree(part.column("_id").to_numpy()[order], points[order].astype(f"<i{width}")), 5)
        return pa.table({**{c: part.column(c)[:1] for c in _UNIT[:3]}, "data": pa.array([data], pa.binary())})

    points = clean(vectors)
    total = points.count()
    sample = points.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).toArrow()
    wanted = min(CELLS, max(8, total // CELL_ROWS))
    pivots = {size: place_pivots(some, min(wanted, max(1, len(some) // 4))) for _, size, some in _by_size(sample)} if sample.num_rows else {}
    assigned = _assigned(points, spark.sparkContext.broadcast(pivots))
    stats: dict[int, list] = {}
    # at most CELLS for each length of vectors
    for r in assigned.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).orderBy("size", "cell").collect():
        stats.setdefault(r["size"], []).append(r)
    cells = {}
    for size, own in stats.items():
        number = np.array([r.cell for r in own])
        shards = np.array([-(-r.n // SHARD_ROWS) for r in own])
        cells[size] = Cells(pivots.get(size, np.zeros((1, size)))[number], number, np.array([r.radius for r in own]), shards)
    shared = spark.sparkContext.broadcast(cells)
    by_cell = spark.createDataFrame([(s, int(n), int(m)) for s, c in cells.items() for n, m in zip(c.number, c.shards, strict=True)], "size int, cell int, shards int")
    dealt = assigned.join(F.broadcast(by_cell), ["size", "cell"]).withColumn("shard", F.pmod(F.xxhash64("_id", F.monotonically_increasing_id()), "shards").cast("int"))
    trees = stored(dealt.select("size", "cell", "shard", "_id", "_vector").groupBy("size", "cell", "shard").applyInArrow(pack, "size int, cell int, shard int, data binary"))

    asked = stored(clean(queries).withColumn("copy", F.monotonically_increasing_id()))
    homes = asked.withColumn("block", F.lit(0).cast("long")).mapInArrow(_home(shared), _ASK)
    many = F.broadcast(homes.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks")))  # as many rows as cells
    block = F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("copy"), "blocks")
    first = stored(_searched(homes.join(many, ["size", "cell"]).withColumn("block", block).drop("blocks"), trees, k, parts))
    # whatever their home cells: a block for each BLOCK_ROWS, or more where shards are too few for all cores
    shards = sum(int(c.shards.sum()) for c in cells.values())
    blocks = max(-(-asked.count() // BLOCK_ROWS), -(-2 * spark.sparkContext.defaultParallelism // max(shards, 1)))
    further = first.mapInArrow(_others(shared, k), _ASK).withColumn("block", F.pmod(F.xxhash64("copy"), F.lit(blocks)))
    second = _searched(further, trees, k, parts)
    by_query = Window.partitionBy("copy", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = (
        first.select("copy", "_id", "ids", "scores").unionAll(second.select("copy", "_id", "ids", "scores"))
        .select("copy", F.col("_id").alias("query_id"), F.explode(F.arrays_zip("ids", "scores")).alias("one"))
        .select("copy", "query_id", F.col("one.ids").alias("vec_id"), F.col("one.scores").alias("score"))
        .withColumn("rank", F.row_number().over(by_query))
        .filter(F.col("rank") <= k)
    )
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
