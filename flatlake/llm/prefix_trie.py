"""The trie of conversations' beginnings, finished in sorted shards around a skeleton of splitter paths.

A node is a sequence of first turns that conversations share; the root is the empty one.

1. A turn becomes 20 bytes, 128 bits of the SHA-256 of its role and text and the text's length in bytes, before
   anything is shuffled; a conversation becomes one string of them, its path. Sorted as bytes, each subtree's
   conversations stand together, and those that end at a node come first.
2. Paths are dealt into shards by ranges of (path, conv_id), so that many copies of one conversation fill several
   shards. The splitters between shards make a trie of their own. Only its nodes, the skeleton, can have members in two
   shards. What tasks have to know of that trie is how deep the paths on both sides of each splitter agree, and those at
   both ends of each shard; these numbers (two for each shard) are broadcast, and name each skeleton node: by the first
   splitter that lies inside it, and its depth.
3. A task walks its sorted shard with a stack of open nodes. It finishes every node that isn't in the skeleton. For one
   that is, it writes a partial aggregate of what lies in its shard. All aggregates are sums or minima: a node is counted
   as a child, and the 1 of (n - 1) is taken off, in the first shard that has the node; that it is a leaf is said in its last.
4. Partial aggregates are reduced by node. Ids of conversations that end at a skeleton node are sorted by shard and hashed
   as a stream. Nodes right below the skeleton then look up their parent's conv_id.

Defined results: null roles and texts are empty. Rows are ordered by turn, null first, then by the first 64 characters of
role and of text, then by digest; repeated rows are turns of their own. Rows of a null conv_id are one conversation, which
is rebuilt from itself and counted, but neither gives a node its conv_id (null where it is alone) nor is named in ends_sha256. A
conversation without turns is a member of the root. An empty table gives an empty result. Other columns are ignored,
whatever their names. A conversation has to fit in one row of 20 bytes a turn, and a shard's ids in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HELD, col, join_counted, pinned

#: Bytes of a turn in a path, and how many of them are its text's length.
UNIT, LENGTH, HEAD = 20, 4, 64
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _turn_key(role: Column, text: Column) -> Column:
    """What rows of one conversation are sorted by, with the turn's bytes, in hex, last."""
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    unit = F.concat(F.substring(digest, 1, 2 * (UNIT - LENGTH)), F.lpad(F.hex(F.octet_length(text)), 2 * LENGTH, "0"))
    turn = col("turn").cast("long")
    return F.struct(turn.isNotNull().alias("numbered"), F.coalesce(turn, F.lit(0)).alias("turn"), F.substring(role, 1, HEAD).alias("role"), F.substring(text, 1, HEAD).alias("head"), unit.alias("unit"))


def _keyed(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(col(c), F.lit("")) for c in ("role", "text"))
    return rows.select(col("conv_id").cast("long").alias("conv_id"), _turn_key(role, text).alias("__key"))


def _joined(group: list[str], keyed: DataFrame) -> DataFrame:
    units = F.transform(F.sort_array(F.collect_list("__key")), lambda k: k["unit"])
    return keyed.groupBy(*group).agg(F.unhex(F.array_join(units, "")).alias("path"))


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, path) of rows (conv_id, turn, role, text)."""
    return _joined(["conv_id"], _keyed(rows))


def rebuilt_paths(rows: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """paths() of rebuilt conversations: the first h turns of conversation c - c % every, h a hash of c under `most`, then c's
    own from the one after its first h on. Rows are shuffled once, with those of the conversation that they begin with."""
    base = F.col("conv_id") - F.col("conv_id") % every
    own = _joined(["__base", "conv_id"], _keyed(rows).withColumn("__base", base).repartition("__base"))
    heads = F.max(F.when(F.col("conv_id") == F.col("__base"), F.substring("path", 1, (most - 1) * UNIT))).over(Window.partitionBy("__base"))
    taken = F.coalesce(F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)), F.lit(0)).cast("int") * UNIT
    head = F.coalesce(F.substring(heads, F.lit(1), taken), F.lit(b""))
    return own.select("conv_id", F.concat(head, F.substring(F.col("path"), taken + 1, F.length("path"))).alias("path"))


def _shared(a: Column, b: Column) -> Column:
    """How many first turns two paths share."""
    units = lambda p: F.when(F.length(p) < UNIT, F.array().cast("array<binary>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(p) - UNIT + 1, F.lit(UNIT)), lambda at: F.substring(p, at, F.lit(UNIT))))
    differs = F.array_position(F.zip_with(units(a), units(b), lambda x, y: ~x.eqNullSafe(y)), F.lit(True))
    return F.when(differs == 0, F.length(a) / UNIT).otherwise(differs - 1).cast("long")


class Open:
    """A node whose members are being read: what its shard has of it."""

    __slots__ = ("size", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "has_child", "ends", "waiting")

    def __init__(self, size: int):
        self.size, self.conv_id, self.n_convs, self.n_children, self.n_leaves, self.saved = size, None, 0, 0, 0, 0
        self.has_child, self.ends, self.waiting = False, [], []  # waiting: children that lack this node's conv_id


class Shard:
    """The walk over a sorted shard. shared: how deep the paths on both sides of each splitter agree; inside: the first and the
    last of each shard; at: the shard's number."""

    def __init__(self, shared: list[int], inside: list[int], at: int):
        self.at, self.below = at, shared[at] if at < len(shared) else -1
        self.above: list[int] = []  # by depth: the first splitter inside the node that lies across the one before this shard
        if at:
            first = at - 1
            self.above = [0] * (shared[first] + 1)
            for depth in range(shared[first], -1, -1):
                while first and min(shared[first - 1], inside[first]) >= depth:
                    first -= 1
                self.above[depth] = first
        self.path, self.fresh, self.out = b"", True, []
        self.stack = [Open(0)]
        self.from_before = len(self.above)  # so many open nodes have members in the shard before

    def add(self, path: bytes, conv_id: int | None) -> None:
        if path != self.path:
            depth, most = 0, min(len(path), len(self.path)) // UNIT
            while depth < most and path[depth * UNIT : depth * UNIT + UNIT] == self.path[depth * UNIT : depth * UNIT + UNIT]:
                depth += 1
            while len(self.stack) > depth + 1:
                self._close(False)
            for at in range(depth * UNIT, len(path), UNIT):
                self.stack.append(Open(int.from_bytes(path[at + UNIT - LENGTH : at + UNIT], "big")))
            self.path = path
            if not self.fresh:  # only nodes that the first path opens can come from the shard before
                self.from_before = min(self.from_before, depth + 1)
        self.fresh = False
        top = self.stack[-1]
        top.n_convs += 1
        if conv_id is not None:
            top.conv_id = conv_id if top.conv_id is None else min(conv_id, top.conv_id)
            top.ends.append(conv_id)

    def end(self) -> None:
        while self.stack:
            self._close(len(self.stack) - 1 <= self.below)

    def _key(self, depth: int, goes_on: bool) -> tuple[int | None, int | None]:
        """A skeleton node's name; nulls for any other."""
        return (self.above[depth], depth) if depth < self.from_before else (self.at, depth) if goes_on else (None, None)

    def _close(self, goes_on: bool) -> None:
        """The last node of the stack has all its members of this shard; goes_on: and has more in the next."""
        node, depth = self.stack.pop(), len(self.stack)
        key, begins = self._key(depth, goes_on), depth >= self.from_before
        node.saved += node.n_convs * node.size - (node.size if begins else 0)
        if not goes_on and not node.has_child:
            node.n_leaves = 1
        for row in node.waiting:
            self.out.append((*row[:2], node.conv_id if key[0] is None else None, *row[3:8], *key, None, None, None))
        if self.stack:
            up = self.stack[-1]
            up.n_convs, up.n_leaves, up.saved, up.has_child = up.n_convs + node.n_convs, up.n_leaves + node.n_leaves, up.saved + node.saved, True
            up.n_children += begins
            if node.conv_id is not None:
                up.conv_id = node.conv_id if up.conv_id is None else min(node.conv_id, up.conv_id)
        ids = ",".join(map(str, node.ends))
        row = (node.conv_id, depth, None, node.n_convs, node.n_children, node.n_leaves, node.saved)
        if key[0] is not None:
            parent = self._key(depth - 1, goes_on) if depth else (None, None)
            self.out.append((*row, None, *parent, key[0], self.at, ids))
        elif self.stack:
            self.stack[-1].waiting.append((*row, hashlib.sha256(ids.encode()).hexdigest()))
        else:
            self.out.append((*row, hashlib.sha256(ids.encode()).hexdigest(), None, None, None, None, None))


WALKED = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, up_border long, up_depth long, border long, shard long, ids string"
SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def prefix_trie(paths: DataFrame, shards: int | None = None, held: int = HELD) -> DataFrame:
    """The nodes of paths (conv_id, path), a row each: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. shards: as many as a shuffle's partitions, if not given. Skeletons of up to `held`
    nodes are broadcast where parents are looked up."""
    shards = shards or int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("path"), F.col("conv_id").asc_nulls_last()]
    ranged = paths.select("conv_id", "path").repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ranged = pinned(ranged.withColumn("__shard", F.spark_partition_id()))
    ends = ranged.groupBy("__shard").agg(F.min("path").alias("low"), F.max("path").alias("high"))  # a row for each shard
    next_low = F.lead("low").over(Window.orderBy("__shard"))
    agree = ends.select("__shard", _shared(F.col("high"), next_low).alias("across"), _shared(F.col("low"), F.col("high")).alias("inside"))
    borders = agree.orderBy("__shard").collect()
    numbers, shared, inside = {r["__shard"]: k for k, r in enumerate(borders)}, [r["across"] for r in borders[:-1]], [r["inside"] for r in borders]
    names = [c.split()[0] for c in WALKED.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in WALKED.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None

        def written() -> pa.RecordBatch:
            rows, own.out = own.out, []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for conv_id, path, shard in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "__shard")), strict=True):
                if shard != at:
                    if own:
                        own.end()
                        yield written()
                    at, own = shard, Shard(shared, inside, numbers[shard])
                own.add(path, conv_id)
                if len(own.out) > 20_000:
                    yield written()
        if own:
            own.end()
            yield written()

    walked = pinned(ranged.mapInArrow(walk, WALKED))
    local, parts = walked.filter("border IS NULL"), walked.filter("border IS NOT NULL")
    bone = parts.groupBy("border", "depth").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in SUMS), F.max("up_border").alias("up_border"), F.max("up_depth").alias("up_depth"))
    bone = pinned(bone.join(_digests(parts), ["border", "depth"]))
    key = lambda border, depth: F.concat_ws(":", border, depth)
    parents = bone.select(key("border", "depth").alias("__up"), F.col("conv_id").alias("__parent"), F.col("n_children").alias("__count"))
    lone = local.filter("up_border IS NULL").select(*NODE)
    below = local.filter("up_border IS NOT NULL").unionByName(bone, allowMissingColumns=True).withColumn("__up", key("up_border", "up_depth"))
    if sum(shared) + len(shared) <= held:  # at least as many as there are skeleton nodes
        met = below.join(F.broadcast(parents.drop("__count")), "__up", "left")
    else:
        met = join_counted(below, parents, "__up", "__count", F.col("conv_id"))
    return lone.unionByName(met.withColumn("parent_conv_id", F.col("__parent")).select(*NODE))


def _digests(parts: DataFrame) -> DataFrame:
    """(border, depth, ends_sha256): the ids of each skeleton node's shards, hashed one after the other."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, any_ids = None, None, False
        row = lambda: pa.RecordBatch.from_pylist([{"border": key[0], "depth": key[1], "ends_sha256": sha.hexdigest()}], pa.schema([("border", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())]))
        for batch in batches:
            for border, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("border", "depth", "ids")), strict=True):
                if (border, depth) != key:
                    if key:
                        yield row()
                    key, sha, any_ids = (border, depth), hashlib.sha256(), False
                if ids:
                    sha.update(("," * any_ids + ids).encode())
                    any_ids = True
        if key:
            yield row()

    return parts.repartition("border", "depth").sortWithinPartitions("border", "depth", "shard").select("border", "depth", "ids").mapInArrow(digest, "border long, depth long, ends_sha256 string")


def with_turns(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """nodes of paths(rows) with the role and text of their last turn; nulls for the root and for nodes that only the
    conversation without an id has."""
    role, text = (F.coalesce(col(c), F.lit("")) for c in ("role", "text"))
    own = rows.select(col("conv_id").cast("long").alias("conv_id"), _turn_key(role, text).alias("__key"), role.alias("role"), text.alias("text"))
    placed = own.withColumn("depth", F.row_number().over(Window.partitionBy("conv_id").orderBy("__key")).cast("long"))
    return nodes.join(placed.drop("__key"), ["conv_id", "depth"], "left")
