"""Prefix trie of conversations by vertical bitmaps.

A shard holds the turns of some conversations over a band of depths.  Its index maps
(position, turn) to the bitset of the conversations that have this turn there.  From the bitset
of a node the depth-first walk takes the lowest conversation left, meets its next turn's posting
with the node's bitset and has a child; popcounts, smallest members and lists of
conversations that end come from the bitsets.  The same node found in several shards is put together
by Spark under the key of its path: the XOR of the keys of (position, turn) along it, 128 bits
of a SHA-256 each.  As that key is a sum, a long conversation is cut into bands and no shard
grows with the length of a conversation, with the popularity of a turn or with the table.

Sums over subtrees add up by member: a node belongs to its smallest member, and what lies below a
node is what its members own from its depth on.  So the second walk adds suffix sums of the members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fallpoint.llm.common import prepared, store

BAND = 256     # depths of a shard
CONVS = 1024   # conversations of a shard on average
LISTED = 4096  # ids of one piece of a list of ends
HEAD = 48      # characters of a text in a splitter of the sort; routing only

HEADER, TURN, VALUE, LATER = range(4)  # kinds of rows of a shard

_PARTIAL = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("q1", pa.int64()), ("q2", pa.int64()), ("depth", pa.int64()),
                      ("chars", pa.int64()), ("low", pa.int64()), ("n", pa.int64()), ("ends", pa.list_(pa.int64()))])
_SUMS = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())])


def _numbered(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, part, at, digest, chars: turns by (turn, role, text), ``at`` counting on inside the part of a range sort."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clean = rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = clean.repartitionByRange(parts, "conv_id", "turn", F.substring("role", 1, HEAD), F.substring("text", 1, HEAD))
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "text")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    out = store(ordered.select("conv_id", digest.alias("digest"), F.length("text").cast("long").alias("chars"),
                               F.monotonically_increasing_id().alias("at")), "turns")
    return out.withColumn("part", F.shiftright("at", 33))


def borrowed_prefixes(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", family: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on a common start: (ids: conv_id), (turns: conv_id, depth, digest, chars).

    Conversation c takes the first h turns of c - c % family and goes on with its own turns after its first h,
    where h = crc32(decimal c) % (longest + 1).  With ``longest=0`` they stay as they are.  Turns come in the order of
    (turn, role, text), a null turn first; null roles and texts count as empty; repeated rows are turns of their own; rows without a
    conv_id belong to no conversation and are left out; other columns are ignored.  Texts of any length are
    replaced by digests when they have been sorted, and the turns of one conversation may lie in many ranges.
    """
    turns = _numbered(rows, conv_col, turn_col, role_col, text_col)
    parts = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = store(parts.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                               F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(longest + 1)).cast("int").alias("h"),
                               (F.col("conv_id") - F.col("conv_id") % family).alias("base")), "turn-ranges")
    place = lambda data: data.withColumn("pos", F.col("before") + F.col("at") - F.col("first") + 1)
    of_base = place(turns.join(parts.where("conv_id = base"), ["conv_id", "part"])).where(F.col("pos") <= longest)
    starts = of_base.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("start"))
    none = F.array().cast("array<struct<pos: bigint, digest: string, chars: bigint>>")
    parts = parts.join(starts, "base", "left").withColumn("start", F.slice(F.coalesce("start", none), F.lit(1), F.col("h")))
    ids = parts.where("before = 0").select("conv_id", "start")
    own = place(turns.join(parts.select("conv_id", "part", "first", "before", "h", F.size("start").alias("used")), ["conv_id", "part"]))
    own = own.where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("used")).alias("depth"), "digest", "chars")
    begun = ids.select("conv_id", F.explode("start").alias("s")).select("conv_id", "s.pos", "s.digest", "s.chars")
    return ids.select("conv_id"), begun.toDF(*own.columns).union(own)


def _band(depth: Column, band: int) -> Column:
    return F.floor(F.greatest(depth - 1, F.lit(0)) / band).cast("long")


class _Shard:
    """Bitmaps of one shard: conversations in id order are the bits."""

    def __init__(self, table: pa.Table, band: int):
        col = {c: table.column(c).to_numpy() for c in ("kind", "conv_id", "depth", "k1", "k2", "a")}
        head = np.flatnonzero(col["kind"] == HEADER)
        head = head[np.argsort(col["conv_id"][head], kind="stable")]
        self.ids = col["conv_id"][head]
        self.start = int(col["depth"][head[0]])
        self.end = self.start + band
        self.total = col["a"][head].tolist()
        turn = np.flatnonzero(col["kind"] == TURN)
        turn = turn[np.lexsort((col["depth"][turn], col["conv_id"][turn]))]
        self.bit = np.searchsorted(self.ids, col["conv_id"][turn])
        # A conversation's turns in the band are neighbours, depth by depth.
        self.first = np.searchsorted(self.bit, np.arange(len(self.ids))).tolist()
        self.depth, self.chars = col["depth"][turn].tolist(), col["a"][turn].tolist()
        self.keys = list(zip(col["k1"][turn].tolist(), col["k2"][turn].tolist()))
        self.posting: dict = {}
        for d, key, i in zip(self.depth, self.keys, self.bit.tolist()):
            self.posting[d, key] = self.posting.get((d, key), 0) | 1 << i
        self.ending: dict = {}
        self.entries: dict = {}
        for i, (d, key) in enumerate(zip(self.total, zip(col["k1"][head].tolist(), col["k2"][head].tolist()))):
            self.ending[d] = self.ending.get(d, 0) | 1 << i
            self.entries[key] = self.entries.get(key, 0) | 1 << i

    def members(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(low.bit_length() - 1)
            bits ^= low
        return out

    def nodes(self) -> Iterator[tuple]:
        """Depth first: (bitset, depth, path key, parent's path key or None, characters of the last text)."""
        stack = [(bits, self.start, key, None, 0) for key, bits in self.entries.items()]
        while stack:
            node = bits, depth, key, _, _ = stack.pop()
            if depth > self.start or not self.start:  # the entries of a later band are nodes of the one before
                yield node
            rest = bits & ~self.ending.get(depth, 0) if depth < self.end else 0
            while rest:
                row = self.first[(rest & -rest).bit_length() - 1] + depth - self.start
                turn = self.keys[row]
                child = bits & self.posting[depth + 1, turn]
                rest &= ~child
                stack.append((child, depth + 1, (key[0] ^ turn[0], key[1] ^ turn[1]), key, self.chars[row]))


def _nodes_of(table: pa.Table, band: int) -> pa.Table:
    shard = _Shard(table, band)
    ids = shard.ids.tolist()
    out: list[list] = [[] for _ in _PARTIAL.names]
    for bits, depth, key, parent, chars in shard.nodes():
        ended = shard.members(bits & shard.ending.get(depth, 0))
        for at, v in zip(out, (*key, *(parent or (None, None)), depth, chars, ids[(bits & -bits).bit_length() - 1], bits.bit_count(),
                               [ids[i] for i in ended])):
            at.append(v)
    return pa.table(out, schema=_PARTIAL)


def _sums_of(table: pa.Table, band: int) -> pa.Table:
    shard = _Shard(table, band)
    kind, conv, depth = (table.column(c).to_numpy() for c in ("kind", "conv_id", "depth"))
    width = max(shard.depth, default=shard.start) - shard.start + 1
    value, later = np.flatnonzero(kind == VALUE), np.flatnonzero(kind == LATER)
    suffix = []
    for field in "ab":
        given = table.column(field).to_numpy()
        own = np.zeros((len(shard.ids), width), dtype=np.int64)
        own[np.searchsorted(shard.ids, conv[value]), depth[value] - shard.start] = given[value]
        own = own[:, ::-1].cumsum(axis=1)[:, ::-1]
        own[np.searchsorted(shard.ids, conv[later])] += given[later][:, None]
        suffix.append(own)
    out: list[list] = [[] for _ in _SUMS.names]
    for bits, at, key, _, _ in shard.nodes():
        some = shard.members(bits)
        for column, v in zip(out, (*key, *(int(s[some, at - shard.start].sum()) for s in suffix))):
            column.append(v)
    return pa.table(out, schema=_SUMS)


def _digests(ends: DataFrame, listed: int) -> DataFrame:
    """SHA-256 of the sorted ids per node (p1, p2, conv_id in): ids become pieces of text in sorted ranges, a hash then reads the pieces."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, done = None, [], []

        def close():
            if held:
                done.append((*node, held[0], ",".join(map(str, held))))

        for b in batches:
            for p1, p2, conv in zip(*(c.to_pylist() for c in b.columns)):
                if (p1, p2) != node or len(held) == listed:
                    close()
                    node, held = (p1, p2), []
                held.append(conv)
            if done:
                yield pa.record_batch([list(c) for c in zip(*done)], names=["p1", "p2", "first", "piece"])
                done = []
        close()
        if done:
            yield pa.record_batch([list(c) for c in zip(*done)], names=["p1", "p2", "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = state = None
        for b in batches:
            done = []
            for p1, p2, piece in zip(*(c.to_pylist() for c in b.columns)):
                if (p1, p2) != node:
                    if state is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (p1, p2), hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if done:
                yield pa.record_batch([list(c) for c in zip(*done)], names=["p1", "p2", "ends_sha256"])
        if state is not None:
            yield pa.record_batch([[node[0]], [node[1]], [state.hexdigest()]], names=["p1", "p2", "ends_sha256"])

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = ends.repartitionByRange(parts, "p1", "p2", "conv_id").sortWithinPartitions("p1", "p2", "conv_id").mapInArrow(
        pieces, "p1 long, p2 long, first long, piece string")
    return some.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first").select("p1", "p2", "piece").mapInArrow(
        hashed, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(ids: DataFrame, turns: DataFrame, band: int = BAND, convs: int = CONVS, listed: int = LISTED) -> DataFrame:
    """Nodes of the trie of all prefixes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``ids`` (conv_id): every conversation, once; ``turns`` (conv_id, depth, digest, chars): depths 1, 2, ... of each
    without gaps, ``digest`` telling turns apart.  A node is a distinct sequence of first turns; conv_id is its smallest
    member, n_convs counts members, n_leaves the childless nodes in its subtree, saved_tokens adds
    (n_convs - 1) * chars over its subtree, ends_sha256 digests the ids of the members that end there.
    The textless root is always a node where there is a conversation; without any there are no rows.  A shard holds about
    ``convs`` conversations over ``band`` depths; a list of ends is hashed in pieces of ``listed`` ids.
    """
    spark = prepared(ids)
    shards = max(1, -(-ids.count() // convs))
    # Families of ids that follow one another share starts, so they meet in one shard.
    block = F.pmod(F.xxhash64(F.floor(F.col("conv_id") / 100)), F.lit(shards))
    code = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "digest"), 256)
    half = lambda k: F.conv(F.substring(code, 16 * k + 1, 16), 16, -10).cast("long")
    keyed = store(turns.select("conv_id", F.col("depth").cast("long").alias("depth"), "chars", half(0).alias("k1"), half(1).alias("k2"))
                  .withColumn("band", _band(F.col("depth"), band)), "trie-turns")
    # Where the bands before one lead to, and how many turns a conversation has.
    per = keyed.groupBy("conv_id", "band").agg(F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    per = per.union(ids.select("conv_id", zero, zero, zero, zero)).groupBy("conv_id", "band").agg(
        F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.sum("n").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    heads = store(per.select("conv_id", "band", *[F.coalesce(F.bit_xor(k).over(before), zero).alias(k) for k in ("k1", "k2")],
                             F.sum("n").over(Window.partitionBy("conv_id")).alias("total")), "trie-heads")

    def shard_rows(data: DataFrame, kind: int, depth: Column, k1: Column, k2: Column, a: Column, b: Column) -> DataFrame:
        return data.select(F.lit(kind).alias("kind"), block.alias("block"), "band", "conv_id", depth.alias("depth"), k1.alias("k1"),
                           k2.alias("k2"), a.alias("a"), b.alias("b"))

    c = F.col
    index = shard_rows(heads, HEADER, c("band") * band, c("k1"), c("k2"), c("total"), zero).union(
        shard_rows(keyed, TURN, c("depth"), c("k1"), c("k2"), c("chars"), zero))
    partial = store(index.groupBy("block", "band").applyInArrow(
        lambda table: _nodes_of(table, band), "p1 long, p2 long, q1 long, q2 long, depth long, chars long, low long, n long, ends array<long>"), "trie-parts")
    one = lambda name: F.any_value(name).alias(name)
    nodes = partial.groupBy("p1", "p2").agg(F.min("low").alias("conv_id"), F.sum("n").alias("n_convs"), one("depth"), one("chars"), one("q1"), one("q2"))
    nodes = store(nodes, "trie-merged")
    below = nodes.where("depth > 0").groupBy(c("q1").alias("p1"), c("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = store(nodes.join(below, ["p1", "p2"], "left").na.fill(0, ["n_children"]), "trie-nodes")
    # What a node is worth belongs to its smallest member.
    worth = nodes.select("conv_id", "depth", _band(c("depth"), band).alias("band"), (c("n_children") == 0).cast("long").alias("leaf"),
                         ((c("n_convs") - 1) * c("chars")).alias("saved"))
    after = Window.partitionBy("conv_id").orderBy(c("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = heads.select("conv_id", "band").join(worth.groupBy("conv_id", "band").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")),
                                                 ["conv_id", "band"], "left")
    later = later.select("conv_id", "band", *[F.coalesce(F.sum(x).over(after), zero).alias(x) for x in ("leaf", "saved")]).where("leaf <> 0 or saved <> 0")
    valued = index.union(shard_rows(worth, VALUE, c("depth"), zero, zero, c("leaf"), c("saved"))).union(
        shard_rows(later, LATER, c("band") * band, zero, zero, c("leaf"), c("saved")))
    sums = valued.groupBy("block", "band").applyInArrow(lambda table: _sums_of(table, band), "p1 long, p2 long, leaves long, saved long").groupBy("p1", "p2").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = _digests(partial.select("p1", "p2", F.explode("ends").alias("conv_id")), listed)
    parents = nodes.select(c("p1").alias("q1"), c("p2").alias("q2"), c("conv_id").alias("parent_conv_id"))
    # One parent may have very many children: a join that the adaptive execution may split.
    out = nodes.join(sums, ["p1", "p2"]).join(ends, ["p1", "p2"], "left").join(parents, ["q1", "q2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
