"""Conversation prefix tries: a minimal-perfect-hash node table for each shard.

1. Turns are range-sorted by conversation and turn and packed into units: runs of
   a conversation's turns, each turn by its identity (128 bits of a SHA-256 over
   role and text) and its code points. A long conversation is many units, so no
   task needs all of it.
2. A prefix's digest is the sum over its turns of hashes of (identity, depth),
   modulo 2^128. Sums of units are added up per conversation, and each unit then
   knows the digests of all prefixes that end in it.
3. Units are sorted by their first digests, so that conversations that begin alike
   lie together, and cut into shards of bounded size. A shard enumerates its
   distinct digests, gives each a slot by a minimal perfect hash, verifies that
   all turns in a slot have the digest, parent and identity of the slot, scatters
   counts into flat arrays and adds them to the parents' slots, deepest first.
   Node counts of shards are summed by digest.
4. With counts and children known, each node's own worth (leaf, saved tokens) goes
   to the unit of its smallest member, which is one chain of nodes downwards, and
   is accumulated once more in the same way.

A unit that does not begin at the root subtracts from the node above it what the
unit before adds at its end, so that sums are right wherever shards are cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import GOLDEN, distinct, mix, ragged, release
from graphloom.operators.digests import ordered_digest
from graphloom.scratch import materialize, shuffle_width

#: Turns of a unit, and of a shard, at most.
UNIT, SHARD_TURNS = 1024, 200_000
#: Digests of a unit's first prefixes by which units are sorted.
PATH = 8
#: Bytes of a turn's identity.
IDENTITY = 16
SEEDS = 4

ROOT = bytes(16)
UNITS = "conv_id long, first long, n int, said binary, chars binary"


class PerfectTable:
    """A minimal perfect hash of distinct 64-bit keys: each level keeps the keys that are alone in their place, the rest go on to the next."""

    def __init__(self, keys: np.ndarray, levels: int = 40):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, given = 0, keys
        for level in range(levels):
            if not len(given):
                break
            at = self._place(given, level, size := len(given) * 3 // 2 + 8)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, np.cumsum(alone) - 1 + self.size))
            self.size += int(alone.sum())
            given = given[~alone[at]]
        self.rest = np.sort(given)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * int(GOLDEN) % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return self.size + len(self.rest)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that the table was not made for: any slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._place(keys[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            out[left[hit]] = self.size + at[hit]
        return out


def _terms(said: np.ndarray, depth: np.ndarray, seed: int) -> np.ndarray:
    """What turns (identities as two words) at depths add to a digest."""
    salt = mix(depth.astype(np.uint64) * GOLDEN + np.uint64(seed * 2 + 1))
    return np.stack([mix(said[:, 0] ^ salt), mix(said[:, 1] + mix(salt))], axis=1)


@dataclass
class Units:
    """Rows of turns of several units, one after another."""

    conv: np.ndarray
    first: np.ndarray
    n: np.ndarray
    said: np.ndarray
    chars: np.ndarray
    carry: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch) -> Units:
        """From columns conv_id, first, n, said, chars, and the digest before the unit, if it is there."""
        said = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, 2)
        chars = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.int64)
        carry = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, 2) if batch.num_columns > 5 else np.zeros((batch.num_rows, 2), np.uint64)
        return Units(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64), said, chars, carry)

    def digests(self, seed: int) -> np.ndarray:
        """Of every prefix that ends in a unit."""
        term = _terms(self.said, ragged(self.first, self.n) + 1, seed)
        sums = np.cumsum(term, axis=0, dtype=np.uint64)
        begin = np.cumsum(self.n) - self.n
        before = np.where((begin > 0)[:, None], sums[np.maximum(begin, 1) - 1], np.uint64(0)) if len(sums) else np.zeros((len(self.n), 2), np.uint64)
        return sums + np.repeat(self.carry - before, self.n, axis=0)


def _blobs(x: np.ndarray) -> list[bytes]:
    """Each row of a matrix as bytes."""
    raw, width = np.ascontiguousarray(x).tobytes(), x.shape[1] * x.itemsize
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def _pack(unit: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows (conv_id, said, chars) in; units with the shard and how many of their conversation's turns the shard has before."""
        shard = TaskContext.get().partitionId()
        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32())
        last, at = None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            said, chars = b"".join(batch.column(1).to_pylist()), batch.column(2).to_numpy().astype(np.int64)
            cuts = [0, *(np.flatnonzero(conv[1:] != conv[:-1]) + 1).tolist(), len(conv)]
            out: list[tuple] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                for i in range(a, b, unit):
                    j = min(b, i + unit)
                    if (c := int(conv[i])) != last:
                        last, at = c, 0
                    out.append((c, at, j - i, said[i * IDENTITY : j * IDENTITY], chars[i:j].tobytes(), shard))
                    at += j - i
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "first", "n", "said", "chars", "shard"])

    return pack


def pack_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """Units (conv_id, first, n, said, chars) of the conversations' turns in order, `first` the number of turns before.

    Turns are ordered by `turn`, null first, ties by the SHA-256 of role and text;
    repeated rows are turns each. A null role or text is empty; rows without
    conv_id are left out.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    identity = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, IDENTITY)
    slim = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), identity.alias("said"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie"))
    by = ["conv_id", F.col("turn").asc_nulls_first(), "said", "tie"]
    packed = slim.repartitionByRange(shuffle_width(turns.sparkSession), *by).sortWithinPartitions(*by).select("conv_id", "said", "chars").mapInArrow(_pack(unit), UNITS + ", shard int")
    units = materialize(packed, "turn-units")
    # a conversation that goes on from earlier shards: of each shard the first at most
    parts = units.groupBy("conv_id", "shard").agg(F.sum("n").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).where("before > 0")
    joined = units.join(F.broadcast(before.select("conv_id", "shard", "before")), ["conv_id", "shard"], "left")
    return joined.select("conv_id", (F.col("first") + F.coalesce("before", F.lit(0))).alias("first"), "n", "said", "chars")


def branch(units: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """Conversations of which the first turns are another's: units of each conversation of `plan` (conv_id, base_id, h).

    Its first h turns, h up to `most`, are replaced by the first h of conversation
    base_id (all if it has fewer, none if it is absent); turns after its own first
    h follow, if there are any.
    """
    def cut(name: str, width: int, skip, n):
        return F.substring(F.col(name), skip * width + 1, n * width).alias(name)

    some = units.where(F.col("first") < most).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "said", "chars"))).alias("u"))
    joined = lambda name: F.aggregate("u", F.lit(b""), lambda a, x: F.concat(a, x[name]))
    heads = some.select(F.col("conv_id").alias("base_id"), joined("said").alias("said"), joined("chars").alias("chars"))
    known = plan.join(heads, "base_id", "left").withColumn("n", F.least("h", F.coalesce((F.octet_length("said") / IDENTITY).cast("int"), F.lit(0))))
    known = materialize(known.select("conv_id", "h", "n", cut("said", IDENTITY, F.lit(0), F.col("n")), cut("chars", 8, F.lit(0), F.col("n"))), "branch-heads")
    begin = known.where("n > 0").select("conv_id", F.lit(0).cast("long").alias("first"), "n", "said", "chars")
    own = units.join(known.select("conv_id", "h", F.col("n").alias("taken")), "conv_id")
    skip = F.greatest(F.lit(0).cast("long"), F.least(F.col("n").cast("long"), F.col("h") - F.col("first"))).cast("int")
    own = own.withColumn("skip", skip).where("skip < n").select("conv_id", (F.col("taken") + F.col("first") + F.col("skip") - F.col("h")).alias("first"), (F.col("n") - F.col("skip")).alias("n"), *(cut(c, w, F.col("skip"), F.col("n") - F.col("skip")) for c, w in (("said", IDENTITY), ("chars", 8))))
    return begin.unionByName(own)


def _totals(seed: int):
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a unit adds to a digest, as four 32-bit numbers."""
        for batch in batches:
            if not batch.num_rows:
                continue
            u = Units.of(batch)
            d = u.digests(seed)[np.cumsum(u.n) - 1]
            halves = [(d[:, k] >> np.uint64(s) & np.uint64(0xFFFFFFFF)).astype(np.int64) for k in (0, 1) for s in (0, 32)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, halves)], names=["conv_id", "first", "n", "said", "chars", "t0", "t1", "t2", "t3"])

    return totals


def _place(seed: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units with the sums before them in: the digest before, the path and the digest at the end."""
        for batch in batches:
            if not batch.num_rows:
                continue
            u = Units.of(batch.select(range(5)))
            lo0, hi0, lo1, hi1 = (batch.column(c).to_numpy().astype(np.uint64) for c in range(5, 9))
            u.carry = np.stack([lo0 + (hi0 << np.uint64(32)), lo1 + (hi1 << np.uint64(32))], axis=1)
            d = u.digests(seed)
            ends = np.cumsum(u.n)
            path = np.zeros((len(u.n), PATH), np.uint64)
            for k in range(PATH):
                has = u.n > k
                path[has, k] = d[(ends - u.n)[has] + k, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(_blobs(u.carry)), pa.array(_blobs(path.byteswap())), pa.array(_blobs(d[ends - 1]))], names=["conv_id", "first", "n", "said", "chars", "carry", "path", "end"])

    return place


class Shard:
    """The trie of some units: slots by a minimal perfect hash over the distinct digests, also of the nodes above the units."""

    def __init__(self, u: Units, seed: int):
        self.units, begin = u, np.cumsum(u.n) - u.n
        self.digest = u.digests(seed)
        parent = np.concatenate([np.zeros((1, 2), np.uint64), self.digest[:-1]])
        parent[begin] = u.carry
        self.depth = ragged(u.first, u.n) + 1
        fold = lambda d: d[:, 0] + mix(d[:, 1] + np.uint64(seed))
        every = np.concatenate([self.digest, u.carry])
        self.table = PerfectTable(distinct(fold(every)))
        slot = self.table.slots(fold(every))
        size = len(self.table)
        self.row_slot, self.above = slot[: len(self.digest)], slot[len(self.digest) :]
        self.node = np.zeros((size, 2), np.uint64)
        self.node[slot] = every
        self.parent_digest, self.said = np.zeros((size, 2), np.uint64), np.zeros((size, 2), np.uint64)
        self.parent_digest[self.row_slot], self.said[self.row_slot] = parent, u.said
        same = (self.node[slot] == every).all() and (self.parent_digest[self.row_slot] == parent).all() and (self.said[self.row_slot] == u.said).all()
        self.clash = not same
        self.level = np.zeros(size, np.int64)
        self.level[self.above], self.level[self.row_slot] = u.first, self.depth
        self.chars = np.zeros(size, np.int64)
        self.chars[self.row_slot] = u.chars
        self.own = np.zeros(size, bool)  # nodes that a turn of the shard ends at
        self.own[self.row_slot] = True
        up = self.table.slots(fold(self.parent_digest))
        met = self.own & (up >= 0)
        met[met] = (self.node[up[met]] == self.parent_digest[met]).all(axis=1)
        self.up = np.where(met, up, -1)

    def accumulate(self, worth: np.ndarray) -> np.ndarray:
        """Adds each node's sum to its parent's, deepest first."""
        order = np.argsort(-self.level, kind="stable")
        cuts = np.flatnonzero(np.diff(self.level[order], prepend=-1, append=-1))
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = order[a:b]
            at = at[self.up[at] >= 0]
            np.add.at(worth, self.up[at], worth[at])
        return worth


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(batch.column(2).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + most - size, side="right")))
            held.append(batch.slice(at, upto - at))
            size += int(ends[upto - 1] - done)
            at = upto
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    del held
    release()


NODES = "node binary, parent binary, said binary, depth long, chars long, n long, conv_id long, first long, clash boolean"


def _count_nodes(seed: int, most: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units (conv_id, first, n, said, chars, carry) in: nodes with their members in the shard, and the smallest with its unit."""
        for batch in _shards(batches, most):
            u = Units.of(batch)
            s = Shard(u, seed)
            n = np.zeros(len(s.table), np.int64)
            np.add.at(n, s.row_slot[np.cumsum(u.n) - 1], 1)
            np.add.at(n, s.above[u.first > 0], -1)
            n = s.accumulate(n)
            conv, first = np.repeat(u.conv, u.n), np.repeat(u.first, u.n)
            order = np.lexsort((conv, s.row_slot))
            slots, at = np.unique(s.row_slot[order], return_index=True)
            smallest, unit = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            smallest[slots], unit[slots] = conv[order][at], first[order][at]
            sent = np.flatnonzero((s.level > 0) & (s.own | (n != 0)))
            own = ~s.own[sent]
            blobs = lambda x: pa.array([None if o else b for o, b in zip(own, _blobs(x[sent]), strict=True)], pa.binary())
            longs = lambda x: pa.array(x[sent], mask=own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_blobs(s.node[sent]), pa.binary()), blobs(s.parent_digest), blobs(s.said), longs(s.level), longs(s.chars), pa.array(n[sent]), longs(smallest), longs(unit), pa.array(np.full(len(sent), s.clash))],
                names=["node", "parent", "said", "depth", "chars", "n", "conv_id", "first", "clash"],
            )

    return count


def _sum_worth(seed: int, most: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units with their own nodes' worth (depths, leaves, saved) and that of the units after them in: sums by node."""
        for batch in _shards(batches, most):
            u = Units.of(batch.select(range(6)))
            s = Shard(u, seed)
            ends, out = np.cumsum(u.n), []
            for leaf_or_saved in (0, 1):
                worth = np.zeros(len(s.table), np.int64)
                values = batch.column(7 + leaf_or_saved)
                lengths = np.array([0 if x is None else x for x in batch.column(6).value_lengths().to_pylist()], np.int64)
                unit = np.repeat(np.arange(len(u.n)), lengths)
                at = s.row_slot[(ends - u.n)[unit] + batch.column(6).flatten().to_numpy() - 1 - u.first[unit]]
                own = values.flatten().to_numpy().astype(np.int64)
                np.add.at(worth, at, own)
                after = batch.column(9 + leaf_or_saved).to_numpy().astype(np.int64)
                whole = after.copy()
                np.add.at(whole, unit, own)
                np.add.at(worth, s.row_slot[ends - 1], after)
                np.add.at(worth, s.above[u.first > 0], -whole[u.first > 0])
                out.append(s.accumulate(worth))
            sent = np.flatnonzero((out[0] != 0) | (out[1] != 0))
            yield pa.RecordBatch.from_arrays([pa.array(_blobs(s.node[sent]), pa.binary()), pa.array(out[0][sent]), pa.array(out[1][sent])], names=["node", "leaves", "saved"])

    return add


def prefix_trie(units: DataFrame, conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of conversations: one row for each distinct sequence of first turns, from the root (no turn).

    `units` are those of `pack_turns` or `branch`; `conversations` (conv_id) are all
    conversations, those without turns too. Returns conv_id (the smallest member),
    depth, parent_conv_id (root: null), n_convs (conversations that begin with the
    sequence), n_children, n_leaves (childless nodes of the subtree, itself
    included), saved_tokens (over the subtree, (n_convs - 1) times the code points
    of a node's last text), ends_sha256 (SHA-256 of the ids of the conversations
    that end here, ascending, joined by commas).

    Turns are equal when role and text are (128 bits of a SHA-256). No conversation:
    an empty result. Conversations that share all their turns end at one node.
    """
    for seed in range(SEEDS):
        nodes = _nodes(units, conversations, shard_turns, seed)
        if nodes is not None:
            return nodes
    raise RuntimeError(f"digests of prefixes clash with {SEEDS} seeds")


def _nodes(units: DataFrame, conversations: DataFrame, shard_turns: int, seed: int) -> DataFrame | None:
    width = shuffle_width(units.sparkSession)
    earlier = Window.partitionBy("conv_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    summed = units.mapInArrow(_totals(seed), UNITS + ", t0 long, t1 long, t2 long, t3 long")
    carried = summed.select("conv_id", "first", "n", "said", "chars", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("t0", "t1", "t2", "t3")))
    placed = carried.mapInArrow(_place(seed), UNITS + ", carry binary, path binary, end binary")
    placed = materialize(placed.repartitionByRange(width, "path", "conv_id", "first").sortWithinPartitions("path", "conv_id", "first"), "trie-units")
    everyone = materialize(conversations.select("conv_id").where("conv_id is not null").distinct(), "trie-members")

    inner = placed.select("conv_id", "first", "n", "said", "chars", "carry")
    parts = inner.mapInArrow(_count_nodes(seed, shard_turns), NODES)
    smallest = F.min(F.when(F.col("conv_id").isNotNull(), F.struct("conv_id", "first")))
    both = [F.max(c).alias(c) for c in ("parent", "said", "depth", "chars")]
    differ = F.max("clash") | (F.min("parent") != F.max("parent")) | (F.min("said") != F.max("said")) | (F.min("depth") != F.max("depth"))
    counted = parts.groupBy("node").agg(*both, F.sum("n").alias("n_convs"), smallest.alias("at"), differ.alias("clash"))
    root = everyone.agg(F.min("conv_id").alias("c"), F.count("*").alias("n")).where("n > 0").select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("binary").alias("said"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), F.col("n").alias("n_convs"), F.struct(F.col("c").alias("conv_id"), F.lit(0).cast("long").alias("first")).alias("at"), F.lit(False).alias("clash"))
    nodes = materialize(counted.unionByName(root), "trie-nodes")
    if nodes.where("clash").limit(1).count():
        return None
    children = nodes.groupBy("parent").agg(F.count("*").alias("n_children")).where("parent is not null").withColumnRenamed("parent", "node")
    above = nodes.select(F.col("node").alias("parent"), F.col("at.conv_id").alias("parent_conv_id"))
    known = nodes.join(above, "parent", "left").join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = materialize(known.select("node", "depth", "chars", "n_convs", "at", "n_children", "parent_conv_id"), "trie-known")

    worth = known.where("depth > 0").select("at.conv_id", "at.first", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    own = worth.groupBy("conv_id", "first").agg(F.collect_list(F.struct("depth", "leaf", "saved")).alias("own"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("total"))
    later = Window.partitionBy("conv_id").orderBy(F.col("first").desc()).rowsBetween(Window.unboundedPreceding, -1)
    given = inner.join(own, ["conv_id", "first"], "left").withColumns({f"after_{c}": F.coalesce(F.sum(c).over(later), F.lit(0)) for c in ("leaves", "total")})
    given = given.where("own is not null or after_leaves <> 0 or after_total <> 0").withColumn("own", F.coalesce("own", F.array().cast("array<struct<depth:bigint,leaf:bigint,saved:bigint>>")))
    given = given.select("conv_id", "first", "n", "said", "chars", "carry", F.col("own.depth").alias("d"), F.col("own.leaf").alias("l"), F.col("own.saved").alias("s"), "after_leaves", "after_total")
    sums = given.mapInArrow(_sum_worth(seed, shard_turns), "node binary, leaves long, saved long").groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    ends = placed.groupBy("conv_id").agg(F.max_by("end", "first").alias("end"))
    ends = everyone.join(ends, "conv_id", "left").select("conv_id", F.lower(F.hex(F.coalesce("end", F.lit(ROOT)))).alias("key"))
    digests = ordered_digest(ends, "key", ["conv_id"], F.col("conv_id"), "sha256", ",").select(F.unhex("key").alias("node"), F.col("digest").alias("ends_sha256"))
    out = known.join(sums, "node", "left").join(digests, "node", "left")
    alone = F.when((F.col("depth") == 0) & (F.col("n_children") == 0), 1).otherwise(0)  # a root without children is itself a leaf
    return out.select(
        F.col("at.conv_id").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", (F.coalesce("leaves", F.lit(0)) + alone).alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`prefix_trie` of conversations as they are; nulls, ties and odd rows as in `pack_turns`, other columns do not matter."""
    units = pack_turns(turns, conv_col, turn_col, role_col, text_col)
    return prefix_trie(units, turns.select(F.col(conv_col).cast("long").alias("conv_id")))
