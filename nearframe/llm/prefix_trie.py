"""The prefix trie of conversations from vertical bitmaps.

Turns are hashed where they are read, so no text is shuffled. Conversations are
range-partitioned by id and cut into shards. A shard indexes (position, turn) to
the bitset of its conversations, and walks depth first: a node is a bitset, the
lowest conversation not yet dealt names the posting to intersect it with, and the
result is a child. Popcounts give members, what no child takes ends at the node.
A node is named by a 128-bit hash of its path, so shards are put together by
grouping: members are added, the smallest id stays, and the ends of a node are
hashed in the order of the shards, in one stream that holds no list.

Sums over subtrees take as many rounds as the depth has bits: a node carries the
names of its ancestors 1, 2, 4, 8, ... levels up, and in round k a node's sum so far
goes to the ancestor 2^k levels up, which then covers twice as many levels.

Defined results
---------------
* A null role or text is the empty one. Rows without a conversation id are left out.
* Turns go by number, null first; turns with one number go by a hash of role and
  text, so that the order does not depend on how rows lie; repeated rows are turns.
* An empty table has no conversations and gives no node, not even the root.
* A node whose members all end there has no child and is a leaf.
* Sequences count as equal when the 128-bit hashes of their turns agree.
* Texts of any length are hashed whole. The turn hashes of one conversation, not
  its texts, have to fit into a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import join_hubs
from .tables import stored

# A shard has at most this many conversations, and is closed beyond this many turns.
SHARD_CONVS, SHARD_TURNS = 4096, 1 << 18
ROWS_OUT = 8192
ROOT = bytes(16)
NODES = pa.schema([("node", pa.binary()), ("above", pa.list_(pa.binary())), ("depth", pa.int64()), ("members", pa.int64()),
                   ("least", pa.int64()), ("chars", pa.int64()), ("ends", pa.string()), ("first_end", pa.int64())])
NODE_TYPE = ("node binary, above array<binary>, depth bigint, members bigint, least bigint, chars bigint, "
             "ends string, first_end bigint")


def hashed_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """(conv_id, place, turn, chars): turns numbered from 0, as hashes of role and text, and the text's code points."""
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    one = F.unhex(F.md5(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said).cast("binary")))
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("number"), one.alias("turn"),
                     F.char_length(said).cast("long").alias("chars")).where("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("number"), "turn")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("place"), "turn", "chars")


def with_heads(turns: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """Give every conversation the first ``taken`` turns of conversation ``base`` in place of its own.

    Both are columns over ``conv_id``; ``taken`` is at most ``most``. Returns
    (conv_id, part, place, turn, chars); a row without a turn stands for the conversation itself.
    """
    convs = turns.select("conv_id").distinct().select("conv_id", base.alias("base"), taken.alias("taken"))
    heads = (turns.where(F.col("place") < most).groupBy(F.col("conv_id").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("place", "turn", "chars"))).alias("head")))
    heads = heads.join(convs.select("base").distinct(), "base", "left_semi")
    head = F.coalesce(F.filter("head", lambda x: x["place"] < F.col("taken")),
                      F.array().cast("array<struct<place:int,turn:binary,chars:bigint>>"))
    nobody = F.array(F.struct(F.lit(-1).alias("place"), F.lit(None).cast("binary").alias("turn"),
                              F.lit(0).cast("bigint").alias("chars")))
    given = (convs.join(heads, "base", "left").select("conv_id", F.explode(F.concat(nobody, head)).alias("x"))
             .select("conv_id", F.lit(0).alias("part"), "x.*"))
    own = turns.where(F.col("place") >= taken).select("conv_id", F.lit(1).alias("part"), "place", "turn", "chars")
    return given.unionAll(own)


class _Shard:
    """Conversations of one range of ids, each a list of turn hashes and their sizes."""

    def __init__(self):
        self.ids: list[int] = []
        self.turns: list[list[bytes]] = []
        self.chars: list[list[int]] = []
        self.size = 0

    def add(self, conv: int, turn: bytes | None, chars: int) -> None:
        if not self.ids or self.ids[-1] != conv:
            self.ids.append(conv)
            self.turns.append([])
            self.chars.append([])
        if turn is not None:
            self.turns[-1].append(turn)
            self.chars[-1].append(chars)
            self.size += 1

    def full(self) -> bool:
        return len(self.ids) >= SHARD_CONVS or self.size >= SHARD_TURNS

    def _postings(self) -> list[dict[bytes, int]]:
        """By position, the bitset of the conversations with each turn there, for turns that two have."""
        seen: list[dict[bytes, list[int]]] = [{} for _ in range(max(map(len, self.turns), default=0))]
        for i, turns in enumerate(self.turns):
            for place, turn in enumerate(turns):
                seen[place].setdefault(turn, []).append(i)
        out: list[dict[bytes, int]] = []
        for place in seen:
            sets = {}
            for turn, convs in place.items():
                if len(convs) > 1:
                    bits = bytearray(convs[-1] // 8 + 1)
                    for i in convs:
                        bits[i // 8] |= 1 << i % 8
                    sets[turn] = int.from_bytes(bits, "little")
            out.append(sets)
        return out

    def nodes(self) -> Iterator[tuple]:
        """Rows of :data:`NODES`, depth first; a parent comes before its children."""
        if not self.ids:
            return
        postings = self._postings()
        path = [ROOT]
        stack = [(0, ROOT, (1 << len(self.ids)) - 1, 0)]
        while stack:
            depth, name, members, chars = stack.pop()
            del path[depth:]
            path.append(name)
            children, ends, rest = [], [], members
            while rest:
                low = rest & -rest
                i = low.bit_length() - 1
                turns = self.turns[i]
                if len(turns) == depth:
                    ends.append(self.ids[i])
                    rest ^= low
                    continue
                same = members & postings[depth].get(turns[depth], low)
                rest &= ~same
                children.append((depth + 1, _below(name, turns[depth]), same, self.chars[i][depth]))
            yield self._row(path, depth, members, chars, ends)
            for child in reversed(children):
                if child[2] & (child[2] - 1):
                    stack.append(child)
                else:  # Nobody else goes on here, so the rest is a chain.
                    yield from self._chain(path, child)

    def _row(self, path: list[bytes], depth: int, members: int, chars: int, ends: list[int]) -> tuple:
        least = self.ids[(members & -members).bit_length() - 1]
        return (path[depth], _above(path, depth), depth, members.bit_count(), least, chars,
                ",".join(map(str, ends)) if ends else None, ends[0] if ends else None)

    def _chain(self, path: list[bytes], child: tuple[int, bytes, int, int]) -> Iterator[tuple]:
        depth, name, member, chars = child
        i = member.bit_length() - 1
        del path[depth:]
        while True:
            path.append(name)
            last = depth == len(self.turns[i])
            yield self._row(path, depth, member, chars, [self.ids[i]] if last else [])
            if last:
                break
            name, chars = _below(name, self.turns[i][depth]), self.chars[i][depth]
            depth += 1
        del path[child[0]:]


def _below(name: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(name + turn, digest_size=16).digest()


def _above(path: list[bytes], depth: int) -> list[bytes]:
    """The names 1, 2, 4, ... levels up."""
    return [path[depth - (1 << k)] for k in range(depth.bit_length()) if 1 << k <= depth]


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), NODES)], schema=NODES)

    def emit(shard: _Shard) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in shard.nodes():
            rows.append(row)
            if len(rows) == ROWS_OUT:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)

    shard = _Shard()
    for batch in batches:
        for conv, turn, chars in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if shard.ids and conv != shard.ids[-1] and shard.full():
                yield from emit(shard)
                shard = _Shard()
            shard.add(conv, turn, chars)
    yield from emit(shard)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ends of each node, which come in order; only the running digest is held."""
    node, digest = None, None
    for batch in batches:
        names, shas = [], []
        for name, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name == node:
                digest.update(b",")
            else:
                if node is not None:
                    names.append(node)
                    shas.append(digest.hexdigest())
                node, digest = name, hashlib.sha256()
            digest.update(ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(shas, pa.string())], ["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])


def _subtree_sums(nodes: DataFrame, deepest: int) -> DataFrame:
    """(node, n_leaves, saved_tokens) summed over subtrees from (node, above, leaf, saved)."""
    sums = nodes.select("node", "above", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    for k in range(deepest.bit_length()):
        sums = stored(sums, "subtrees")
        below = (sums.where(F.size("above") > k).groupBy(F.get("above", F.lit(k)).alias("node"))
                 .agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved")))
        sums = sums.join(below, "node", "left").select(
            "node", "above", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"))
    return sums.drop("above")


def build_trie(turns: DataFrame) -> DataFrame:
    """One row per node: node, depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    ``turns`` has (conv_id, part, place, turn, chars) as :func:`with_heads` makes them.
    """
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (stored(turns, "turns").repartitionByRange(parts, "conv_id").sortWithinPartitions("conv_id", "part", "place")
              .select("conv_id", "turn", "chars"))
    raw = stored(ranged.mapInArrow(_shard_nodes, NODE_TYPE), "shard-nodes")
    ends = (raw.where("ends IS NOT NULL").select("node", "ends", "first_end").repartition(parts, "node")
            .sortWithinPartitions("node", "first_end").select("node", "ends").mapInArrow(_hash_ends, "node binary, ends_sha256 string"))
    merged = raw.groupBy("node").agg(F.first("above").alias("above"), F.first("depth").alias("depth"),
                                     F.sum("members").alias("n_convs"), F.min("least").alias("conv_id"),
                                     F.first("chars").alias("chars"))
    merged = stored(merged, "nodes")
    parent = F.get("above", F.lit(0))
    counts = merged.where("depth > 0").groupBy(parent.alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(merged.join(counts, "node", "left").join(ends, "node", "left").select(
        "node", "above", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    whole = nodes.join(_subtree_sums(nodes, deepest), "node").withColumn("parent", parent)
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # Nodes with more children than a share of a task are few, so only their keys are sent to the tasks.
    hubs = nodes.where("n_children > 1").orderBy(F.desc("n_children"), "node").limit(4 * parts).select(F.col("node").alias("parent"))
    return join_hubs(whole, parents, "parent", hubs, how="left", spread=parts, by=["node"]).select(
        "node", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
