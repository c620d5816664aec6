"""Prefix trie of conversations, with totals of all subtrees by centroid decomposition.

A node is a run of first turns that some conversations share; it is named by the smallest of these, its owner, and its depth. Runs are
told apart by 128 bits of hash: each turn is hashed with its place, and the exclusive or of these hashes, a running sum that can be cut
anywhere, names the run.

Totals of subtrees are found without walking down long conversations. The centroid of a component is its deepest node that at least
half of the component's weight stands below or in. It is taken out, which leaves the subtrees of its children and the part above as
smaller components, all of which are split again in the next round until a task can hold one and sums it up. Then the rounds
are undone: the total of a centroid is its own value and the totals of its children's components, and it is added to every node on
the path from the centroid to the top of its component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.texts import bounded_batches, text_of
from runlens.session import written

#: Conversations come in blocks; the first turns of a block's first one stand before those of the others.
BLOCK, MOST_SHARED = 100, 6
#: Nodes of a component that one task sums up.
COMPONENT = 4096
#: Characters of the texts in which the ids of a node are gathered before they meet.
TEXT = 1 << 20


def _running(rows: DataFrame, order: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds running aggregates (name: SQL function and value) of each conversation's rows in order, each row's own included.

    Rows are aggregated within range slices, and slices in their order, so that no conversation is one task.
    """
    sliced = written(rows.repartitionByRange("conv_id", *order).withColumn("slice", F.spark_partition_id()))
    here = Window.partitionBy("conv_id", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy("conv_id", "slice").agg(*(F.call_function(f, v).alias(name) for name, (f, v) in values.items()))
    # A slice begins within one conversation at most, so these are no more than slices.
    offsets = totals.select(
        F.col("conv_id").alias("own"), F.col("slice").alias("own_slice"), *(F.call_function(f, F.col(name)).over(before).alias(f"before_{name}") for name, (f, _) in values.items())
    ).where(" OR ".join(f"before_{name} IS NOT NULL" for name in values))
    counted = sliced.select("*", *(F.call_function(f, v).over(here).alias(f"here_{name}") for name, (f, v) in values.items()))
    joined = counted.join(offsets, (F.col("conv_id") == F.col("own")) & (F.col("slice") == F.col("own_slice")), "left")
    both = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "bit_xor": lambda a, b: a.bitwiseXOR(F.coalesce(b, F.lit(0).cast("long")))}
    return joined.select(*rows.columns, *(both[f](F.col(f"here_{name}"), F.col(f"before_{name}")).alias(name) for name, (f, _) in values.items()))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the rebuilt conversations (``conv_id``, ``depth``, hashes ``a`` and ``b`` of the turn, ``chars``), and ``conv_id`` with its ``size``."""
    role, text = text_of("role"), text_of("text")
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.char_length(text).cast("long").alias("chars"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"))
    numbered = written(_running(turns, ["turn", "role", "chars", "a", "b"], {"place": ("sum", F.lit(1).cast("long"))}))
    numbered = numbered.select("conv_id", "place", "a", "b", "chars")
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    convs = numbered.groupBy("conv_id").agg(F.count("*").alias("turns")).withColumn("shared", shared)
    first = numbered.where(F.col("place") < MOST_SHARED).where(F.col("conv_id") % BLOCK == 0)
    ahead = first.select(F.col("conv_id").alias("block"), F.col("place").alias("depth"), "a", "b", "chars")
    block = F.col("conv_id") - F.col("conv_id") % BLOCK
    given = convs.withColumn("block", block).join(ahead, "block").where(F.col("depth") <= F.col("shared"))
    first_count = convs.select(F.col("conv_id").alias("block"), F.col("turns").alias("block_turns"))
    sized = convs.withColumn("block", block).join(first_count, "block", "left").withColumn("begin", F.least("shared", F.coalesce("block_turns", F.lit(0).cast("long"))))
    own = numbered.join(sized.select(F.col("conv_id").alias("conv"), "shared", "begin"), F.col("conv_id") == F.col("conv")).where(F.col("place") > F.col("shared"))
    rows = given.select("conv_id", "depth", "a", "b", "chars").union(
        own.select("conv_id", (F.col("place") - F.col("shared") + F.col("begin")).alias("depth"), "a", "b", "chars"))
    size = F.col("begin") + F.greatest(F.lit(0).cast("long"), F.col("turns") - F.col("shared"))
    return rows, sized.select("conv_id", size.cast("long").alias("size"))


def trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (``own``, ``depth``, ``parent``: the parent's owner, ``n_convs``, ``n_children``, ``chars``, ``weight``) and the paths.

    A path row says which node (``own``, ``depth``) a conversation (``conv_id``) passes at a depth, the node's ``parent``, and whether it ends there.
    """
    rows, convs = rebuilt(conversations)
    convs = written(convs)
    placed = rows.withColumn("v", F.xxhash64("a", "depth")).withColumn("w", F.xxhash64("b", "depth"))
    summed = _running(placed.select("conv_id", "depth", "chars", "v", "w"), ["depth"], {"x": ("bit_xor", F.col("v")), "y": ("bit_xor", F.col("w"))})
    sizes = convs.select(F.col("conv_id").alias("conv"), "size")
    paths = written(summed.join(sizes, F.col("conv_id") == F.col("conv")).select(
        "conv_id", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("v")).alias("px"), F.col("y").bitwiseXOR(F.col("w")).alias("py"), "chars", "size"))
    weight = F.sum(F.col("size") - F.col("depth") + 1).alias("weight")
    found = written(paths.groupBy("depth", "x", "y").agg(
        F.min("conv_id").alias("own"), F.count("*").alias("n_convs"), F.first("px").alias("px"), F.first("py").alias("py"), F.first("chars").alias("chars"), weight))
    root = convs.agg(F.min("conv_id").alias("own"), F.count("*").alias("n_convs"), F.sum(F.col("size") + 1).alias("weight")).where("own IS NOT NULL").select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "own", "n_convs", F.lit(0).cast("long").alias("chars"), "weight")
    every = found.unionByName(root, allowMissingColumns=True)
    above = every.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("own").alias("parent"))
    linked = written(every.join(above, ["depth", "px", "py"], "left").select("depth", "x", "y", "own", "parent", "n_convs", "chars", "weight"))
    children = linked.where("parent IS NOT NULL").groupBy(F.col("parent").alias("mother"), (F.col("depth") - 1).alias("level")).agg(F.count("*").alias("n"))
    nodes = linked.join(children, (F.col("own") == F.col("mother")) & (F.col("depth") == F.col("level")), "left").select(
        "own", "depth", "parent", "n_convs", F.coalesce("n", F.lit(0).cast("long")).alias("n_children"), "chars", "weight")
    named = linked.select("depth", "x", "y", "own", "parent")
    ends = (F.col("depth") == F.col("size")).alias("ends")
    passed = paths.join(named, ["depth", "x", "y"]).select("conv_id", "depth", "own", "parent", ends)
    first = F.lit(convs.agg(F.min("conv_id")).first()[0]).cast("long")
    at_root = convs.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), first.alias("own"), F.lit(None).cast("long").alias("parent"), (F.col("size") == 0).alias("ends"))
    return written(nodes), written(passed.union(at_root))


def _summed(components: DataFrame) -> DataFrame:
    """Totals of the subtrees within components of bounded size, as ``own``, ``depth``, ``leaves``, ``saved``."""
    bounded_batches(components.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            # Deepest nodes first; those whose parent is of another component stay as they are.
            for key in sorted(held, key=lambda k: -k[1]):
                node = held[key]
                mother = held.get((node[0], key[1] - 1))
                if mother is not None:
                    mother[1] += node[1]
                    mother[2] += node[2]
            columns = [[k[0] for k in held], [k[1] for k in held], [n[1] for n in held.values()], [n[2] for n in held.values()]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["own", "depth", "leaves", "saved"])

        held, last = {}, None
        for batch in batches:
            for top, level, own, depth, parent, leaf, saved in zip(*(c.to_pylist() for c in batch.columns)):
                if (top, level) != last:
                    if held:
                        yield told()
                    held, last = {}, (top, level)
                held[own, depth] = [parent, leaf, saved]
        if held:
            yield told()

    sent = components.select("top", "level", "own", "depth", "parent", "leaf", "own_saved").repartition("top", "level").sortWithinPartitions("top", "level")
    return sent.mapInArrow(run, "own long, depth long, leaves long, saved long")


def rolled_up(nodes: DataFrame, paths: DataFrame, limit: int = COMPONENT) -> DataFrame:
    """``own``, ``depth``, ``leaves`` and ``saved`` of all nodes: totals of ``leaf`` and ``own_saved`` over their subtrees."""
    c = F.col
    root = F.lit(nodes.agg(F.min("own")).first()[0]).cast("long")
    open_ = nodes.withColumn("top", root).withColumn("level", F.lit(0).cast("long"))
    fields = ["top", "level", "own", "depth", "parent", "leaf", "own_saved", "weight"]
    open_, closed, rounds = written(open_.select(*fields)), [], []
    while True:
        whole = open_.groupBy("top", "level").agg(F.count("*").alias("n"), F.max("weight").alias("all"))
        big = written(whole.where(c("n") > limit))
        if big.isEmpty():
            closed.append(open_)
            break
        split = open_.join(big, ["top", "level"])
        closed.append(open_.join(big.select("top", "level"), ["top", "level"], "left_anti"))
        half = split.where(2 * c("weight") >= c("all")).groupBy("top", "level").agg(F.max(F.struct("depth", "own", "weight", "leaf", "own_saved")).alias("m"))
        centroids = written(half.select("top", "level", c("m.own").alias("c_own"), c("m.depth").alias("c_depth"), c("m.weight").alias("c_weight"),
                                        c("m.leaf").alias("c_leaf"), c("m.own_saved").alias("c_saved")))
        # Through which child a conversation goes below a centroid, and what lies on the way from a centroid up to its top.
        below = paths.join(centroids, (c("parent") == c("c_own")) & (c("depth") == c("c_depth") + 1)).select(
            c("conv_id").alias("member"), c("top").alias("old_top"), c("level").alias("old_level"), c("own").alias("child"))
        way = written(paths.join(centroids, (c("conv_id") == c("c_own")) & c("depth").between(c("level"), c("c_depth") - 1)).select(
            c("own").alias("way_own"), c("depth").alias("way_depth"), "c_own", "c_depth", "c_weight"))
        placed = split.drop("n", "all").join(centroids, ["top", "level"]).where(~((c("own") == c("c_own")) & (c("depth") == c("c_depth"))))
        placed = placed.join(below, (c("top") == c("old_top")) & (c("level") == c("old_level")) & (c("own") == c("member")) & (c("depth") > c("c_depth")), "left")
        lighter = way.select("way_own", "way_depth", c("c_weight").alias("gone"))
        placed = placed.join(lighter, (c("own") == c("way_own")) & (c("depth") == c("way_depth")), "left")
        moved = written(placed.select(
            F.coalesce("child", "top").alias("top"), F.when(c("child").isNotNull(), c("c_depth") + 1).otherwise(c("level")).alias("level"),
            "own", "depth", "parent", "leaf", "own_saved", (c("weight") - F.coalesce("gone", F.lit(0).cast("long"))).alias("weight"), "c_own", "c_depth", "child"))
        kids = moved.where((c("own") == c("child")) & (c("depth") == c("c_depth") + 1)).select("own", "depth", "c_own", "c_depth")
        rounds.append((centroids, way, written(kids)))
        open_ = moved.select(*fields)
    local = written(_summed(reduce(DataFrame.union, closed)))
    parts = [local]
    for centroids, way, kids in reversed(rounds):
        known = reduce(DataFrame.union, parts)
        sums = known.join(kids, ["own", "depth"]).groupBy("c_own", "c_depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        zero = F.lit(0).cast("long")
        total = written(centroids.join(sums, ["c_own", "c_depth"], "left").select(
            "c_own", "c_depth", (c("c_leaf") + F.coalesce("leaves", zero)).alias("leaves"), (c("c_saved") + F.coalesce("saved", zero)).alias("saved")))
        parts.append(total.select(c("c_own").alias("own"), c("c_depth").alias("depth"), "leaves", "saved"))
        parts.append(way.join(total, ["c_own", "c_depth"]).select(c("way_own").alias("own"), c("way_depth").alias("depth"), "leaves", "saved"))
    return reduce(DataFrame.union, parts).groupBy("own", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def end_digests(paths: DataFrame) -> DataFrame:
    """``own``, ``depth`` and ``ends_sha256`` of nodes at which conversations end: their ids in rising order, joined by commas.

    Ids are joined to texts of bounded length in ranges first. A digest can only be made from beginning to end, so the texts of one
    node pass through one task, which holds one at a time.
    """
    ends = paths.where("ends").select("own", "depth", "conv_id")
    bounded_batches(paths.sparkSession)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows, ids, size, last = ["own", "depth", "first", "ids"], [], [], 0, None

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names)
            rows.clear()
            return out

        for batch in batches:
            for own, depth, conv in zip(*(x.to_pylist() for x in batch.columns)):
                if (own, depth) != last or size > TEXT:
                    if ids:
                        rows.append((*last, ids[0], ",".join(map(str, ids))))
                    ids, size, last = [], 0, (own, depth)
                    if len(rows) >= 10_000 or sum(len(r[3]) for r in rows[-2:]) > TEXT:
                        yield flushed()
                ids.append(conv)
                size += 20
        if ids:
            rows.append((*last, ids[0], ",".join(map(str, ids))))
        if rows:
            yield flushed()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            keys, sums = [], []
            for own, depth, _, text in zip(*(x.to_pylist() for x in batch.columns)):
                if (own, depth) == last:
                    digest.update(b"," + text.encode())
                    continue
                if last is not None:
                    keys.append(last)
                    sums.append(digest.hexdigest())
                last, digest = (own, depth), hashlib.sha256(text.encode())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sums)], ["own", "depth", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([digest.hexdigest()])], ["own", "depth", "ends_sha256"])

    pieces = ends.repartitionByRange("own", "depth", "conv_id").sortWithinPartitions("own", "depth", "conv_id").mapInArrow(joined, "own long, depth long, first long, ids string")
    return pieces.repartition("own", "depth").sortWithinPartitions("own", "depth", "first").mapInArrow(digested, "own long, depth long, ends_sha256 string")


def digests(conversations: DataFrame, limit: int = COMPONENT) -> DataFrame:
    """All nodes of the trie with the totals of their subtrees.

    A null role or text is an empty one. Turns go by number, null first; equal numbers by role, length and hash of the text, and equal rows
    stay. Rows without a ``conv_id`` belong to no conversation. Texts of any length count whole. Columns beyond ``conv_id``, ``turn``,
    ``role`` and ``text`` are not looked at. An empty table has no root.
    """
    nodes, paths = trie(conversations)
    valued = written(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("chars")))
    totals = rolled_up(valued, paths, limit)
    ends = end_digests(paths)
    return valued.join(totals, ["own", "depth"]).join(ends, ["own", "depth"], "left").select(
        F.col("own").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
