"""A trie of conversation prefixes, by prefix-doubling names.

Turns get dense names by content, then aligned blocks of 2, 4, 8, ... turns get
dense names from the names of their halves, one join round for each power of
two. A prefix of d turns is told by the names of the blocks that the binary
digits of d cut it into; conversations with equal lists share the node. A node
is known by its depth and its least member, which is also found by (member,
depth) for any depth, so ancestors 1, 2, 4, ... levels up are looked up by keys
that no other node has, and sums over subtrees take as many rounds as the depth
has binary digits.

Rows move by (conversation, position) or by content, never by conversation
alone: turns are numbered by one sort over all rows. Sums are pre-aggregated, so
a first turn shared by a third of all conversations is one entry a task. The
ids that end at a node are packed by tasks in order and then hashed as a stream.
Every round is written to the shared folder.

Defined results: turns are ordered by (turn, role, text), null turns first; null
roles and texts are ''. Rows with a null conversation form no conversation and
are left out. Repeated rows are turns of their own. Texts of any length only
move into their digest. An empty table gives an empty result. Only the four
named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.shared import stored

#: Conversations of a family share the head of its first one, of up to HEADS - 1 turns.
FAMILY, HEADS = 5, 9
#: Characters of packed ids in one row.
PACKED = 1 << 16


def indexed(rows: DataFrame, name: str) -> DataFrame:
    """``name``: 0, 1, 2, ... over the rows of a stored table, in its order."""
    raw = rows.withColumn(name, F.monotonically_increasing_id()).withColumn("_part", F.shiftright(name, 33))
    sizes = {r["_part"]: r["n"] for r in raw.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    # as many rows as the table has partitions
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _start long"))
    inside = F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    return raw.join(offsets, "_part").withColumn(name, F.col("_start") + inside).drop("_part", "_start")


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``at``: the row's number from 0 within its key, by one sort of the whole table."""
    place = indexed(stored(rows.orderBy(F.col(key).asc(), *(F.col(c).asc_nulls_first() for c in order))), "_global")
    least = place.groupBy(key).agg(F.min("_global").alias("_first"))
    return place.join(least, key).withColumn("at", F.col("_global") - F.col("_first")).drop("_global", "_first")


def dense(distinct: DataFrame) -> DataFrame:
    """``name``: a number from 0 on for each row of a table of distinct rows."""
    return indexed(stored(distinct), "name")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, content, bytes) of every rebuilt turn, and (conv_id, turns) of every conversation.

    A conversation takes the first h turns of its family's first conversation,
    h being crc32 of its id modulo HEADS, and then its own turns after its first h.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")
    )
    # the order of texts matters only between equal turns, so a digest stands for the text where it moves
    turns = stored(
        numbered(rows, "conv_id", "turn", "role", "text").select(
            "conv_id", "at", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("content"), F.octet_length("text").cast("long").alias("bytes")
        )
    )
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    known = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumn("h", head)
    known = known.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = turns.filter(F.col("at") < HEADS - 1).withColumnRenamed("conv_id", "base")
    taken = known.select("conv_id", "base", "h").join(heads, "base").filter("at < h").select("conv_id", "at", "content", "bytes")
    taken = stored(taken)  # at most eight for each conversation
    known = known.join(taken.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k")), "conv_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    known = stored(known.withColumn("turns", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    own = turns.join(known.select("conv_id", "h", "k"), "conv_id").filter("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("k")).alias("at"), "content", "bytes")
    return stored(taken.unionAll(own)), known.select("conv_id", "turns")


def block_names(turns: DataFrame) -> list[DataFrame]:
    """Names (conv_id, block, name) of all whole aligned blocks of 2^level turns, for each level."""
    names = dense(turns.select("content").distinct())
    level = stored(turns.join(names, "content").select("conv_id", F.col("at").alias("block"), "name"))
    levels = [level]
    while not (pairs := _halves(level)).isEmpty():
        names = dense(pairs.select("left", "right").distinct())
        level = stored(pairs.join(names, ["left", "right"]).select("conv_id", "block", "name"))
        levels.append(level)
    return levels


def _halves(level: DataFrame) -> DataFrame:
    odd = F.col("block") % 2 == 1
    pairs = level.groupBy("conv_id", F.shiftright("block", 1).alias("block")).agg(
        F.max(F.when(~odd, F.col("name"))).alias("left"), F.max(F.when(odd, F.col("name"))).alias("right")
    )
    return stored(pairs.filter("left is not null and right is not null"))


def _prefixes(turns: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(conv_id, depth, bytes, prefix): the names of the blocks by the binary digits of the depth, longest first."""
    whole = levels[0].select("conv_id", F.lit(0).alias("level"), "block", "name")
    for k, level in enumerate(levels[1:], 1):
        whole = whole.unionAll(level.select("conv_id", F.lit(k).alias("level"), "block", "name"))
    depth = F.col("at") + 1
    digits = F.filter(F.sequence(F.lit(0), F.lit(len(levels) - 1)), lambda k: F.call_function("shiftright", depth, k) % 2 == 1)
    cut = turns.select("conv_id", depth.alias("depth"), "bytes", F.explode(digits).alias("level"))
    # the block of a digit starts where all greater digits end
    cut = cut.withColumn("block", F.call_function("shiftright", F.col("depth"), F.col("level")) - 1)
    found = cut.join(whole, ["conv_id", "level", "block"])
    return found.groupBy("conv_id", "depth").agg(
        F.max("bytes").alias("bytes"), F.sort_array(F.collect_list(F.struct("level", "name")), asc=False).alias("prefix")
    )  # one name for each binary digit


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in the order of their nodes, joined by commas, as few rows for each node."""
    node, ids, size = None, [], 0
    out: dict[str, list] = {"depth": [], "rep": [], "first": [], "ids": []}

    def close() -> None:
        if ids:
            for name, v in zip(out, (*node, ids[0], ",".join(map(str, ids))), strict=True):
                out[name].append(v)

    def rows() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pydict(out, schema=pa.schema([("depth", pa.int64()), ("rep", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))
        for v in out.values():
            v.clear()
        return made

    for batch in batches:
        for depth, rep, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (depth, rep) != node or size > PACKED:
                close()
                node, ids, size = (depth, rep), [], 0
            ids.append(conv)
            size += 20
        if len(out["ids"]) > 1000:
            yield rows()
    close()
    yield rows()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's packed ids, fed as they come."""
    node, sha = None, None
    for batch in batches:
        out: dict[str, list] = {"depth": [], "rep": [], "ends": []}
        for depth, rep, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (depth, rep) == node:
                sha.update(b"," + ids.encode())
                continue
            if node is not None:
                for name, v in zip(out, (*node, sha.hexdigest()), strict=True):
                    out[name].append(v)
            node, sha = (depth, rep), hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_pydict(out, schema=_ENDS)
    if node is not None:
        yield pa.RecordBatch.from_pydict({"depth": [node[0]], "rep": [node[1]], "ends": [sha.hexdigest()]}, schema=_ENDS)


_ENDS = pa.schema([("depth", pa.int64()), ("rep", pa.int64()), ("ends", pa.string())])


def build(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns, known = rebuilt(conversations)
    prefixes = stored(_prefixes(turns, block_names(turns)))

    # every member's place at every depth, told by the least member
    members = prefixes.groupBy("depth", "prefix").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"))
    members = stored(members)
    top = known.agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs")).filter("rep is not null")
    places = stored(prefixes.join(members.select("depth", "prefix", "rep"), ["depth", "prefix"]).select("conv_id", "depth", "rep"))
    root = top.select(F.lit(0).cast("long").alias("depth"), "rep", "n_convs", F.lit(0).cast("long").alias("bytes"))
    nodes = members.select("depth", "rep", "n_convs", "bytes").unionAll(root)

    def above(rows: DataFrame, levels: int) -> DataFrame:
        """``up``: the rep of each node's ancestor so many levels up; shallower nodes go."""
        deep = rows.filter(F.col("depth") > levels).withColumn("to", F.col("depth") - levels)
        at = places.select(F.col("conv_id").alias("rep"), F.col("depth").alias("to"), F.col("rep").alias("up"))
        found = deep.join(at, ["rep", "to"])
        under_root = rows.filter(F.col("depth") == levels).withColumn("to", F.lit(0).cast("long"))
        under_root = under_root.crossJoin(F.broadcast(top.select(F.col("rep").alias("up"))))  # one row
        return found.select("depth", "rep", "to", "up", *[c for c in rows.columns if c not in ("depth", "rep")]).unionByName(
            under_root.select("depth", "rep", "to", "up", *[c for c in rows.columns if c not in ("depth", "rep")])
        )

    parents = above(nodes, 1).select("depth", "rep", F.col("up").alias("parent"))
    children = parents.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("rep")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(parents, ["depth", "rep"], "left").join(children, ["depth", "rep"], "left")
    nodes = stored(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))

    sums = nodes.select(
        "depth", "rep", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")
    )
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach <= deepest:
        # sums hold all nodes less than `reach` levels below; those of the next ones join them
        below = above(sums, reach).groupBy(F.col("to").alias("depth"), F.col("up").alias("rep")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        sums = stored(
            sums.join(below, ["depth", "rep"], "left").select(
                "depth", "rep", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")
            )
        )
        reach *= 2

    # the ids that end at each node, in order
    last = known.withColumnRenamed("turns", "depth")
    ends = last.filter("depth > 0").join(places, ["conv_id", "depth"]).select("depth", "rep", "conv_id")
    ends = ends.unionAll(last.filter("depth = 0").crossJoin(F.broadcast(top.select("rep"))).select("depth", "rep", "conv_id"))
    sorted_ends = ends.repartitionByRange(parts, "depth", "rep", "conv_id").sortWithinPartitions("depth", "rep", "conv_id")
    packed = sorted_ends.mapInArrow(_packed, "depth long, rep long, first long, ids string")
    hashed = packed.repartition(parts, "depth", "rep").sortWithinPartitions("depth", "rep", "first").select("depth", "rep", "ids").mapInArrow(_hashed, "depth long, rep long, ends string")
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(sums, ["depth", "rep"]).join(hashed, ["depth", "rep"], "left")
        .select(
            F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
            F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"),
        )
    )
