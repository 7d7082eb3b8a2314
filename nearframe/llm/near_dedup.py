"""MinHash near-deduplication by a multi-index Hamming join.

A document's set are its distinct word shingles. Its signature has ``16`` bits
of each of K minimum hashes, so two signatures differ in about (1 - J) * K
symbols. They are cut into m chunks; if two differ in at most r = 2m - 1 symbols,
some chunk has at most one error (pigeonhole), so each chunk is entered once per
place at which the error may be, with that place left out. Documents with an
entry in common are candidates, which finds *all* pairs up to distance r. K and m
are chosen so that a pair just at the similarity threshold exceeds r with a
chance below ``MISS``; every link is confirmed on the full sets.

How groups are kept from growing pairs
--------------------------------------
* Documents with equal sets are one node from the start.
* An entry shared by up to ``CROWD`` nodes gives their pairs, which are dropped if
  their distance is above r. A larger one only gives edges to its smallest node.
* The components of these edges are clusters, which no pair up to distance r
  leaves. A cluster is cut into blocks of ``BLOCK`` nodes; a task gets two blocks
  with their texts, compares full sets and reports a spanning forest of the links
  it finds. So no table of all pairs of a group is ever made, and none is missed.

Defined results
---------------
* Words are lower-cased (A-Z). Fewer words than a shingle are one shingle, their
  whole sequence. Null, empty and white texts have no set and no links.
* A component's id is the smallest ``doc_id`` in it; null ids are above all
  numbers. One row of a component is kept: that with this id, of repeated such
  rows one.
* Repeated rows have equal sets. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import free_names, stored
from .words import Words, mix, runs, slices

WIDTH = 5          # symbols in a chunk
MISS = 1e-6        # chance that a pair at the threshold is not a candidate
CROWD = 32         # nodes of an entry up to which it gives pairs
BLOCK = 256        # nodes of a cluster that are compared with as many others in one task
SIGNED = "doc_id long, text_hash long, row long, n long, h1 long, h2 long, signature binary"


@cache
def chunk_count(similarity: float) -> int:
    """The least number of chunks at which a pair at ``similarity`` is missed with a chance below ``MISS``."""
    apart = 1 - similarity
    for m in range(4, 200):
        k = m * WIDTH
        tail = sum(math.comb(k, i) * apart**i * (1 - apart) ** (k - i) for i in range(2 * m, k + 1))
        if tail < MISS:
            return m
    raise ValueError("too low a similarity for one error per chunk")


def _sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    words = Words(column, lower=True)
    hashes, _, bounds = runs(words, words.hashes(), size, short=True)
    return hashes, bounds


def signatures(hashes: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Sixteen bits of the ``k`` minimum hashes of each set; no set may be empty."""
    random = np.random.default_rng(11)
    flips = random.integers(0, 2**64, k, dtype=np.uint64)
    odds = random.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(bounds) - 1, k), np.uint16)
    for i in range(k):
        least = np.minimum.reduceat((hashes ^ flips[i]) * odds[i], bounds[:-1])
        out[:, i] = mix(least) >> np.uint64(48)
    return out


def _digest(own: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), "<i8")
    return int(both[0]), int(both[1])


def _sign(size: int, k: int):
    def sign(batches: Iterator[pa.RecordBatch]):
        at = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in slices(whole)):
            hashes, bounds = _sets(batch.column("text"), size)
            counts, digests = [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = np.unique(hashes[a:b])
                counts.append(len(own))
                digests.append(_digest(own) if len(own) else (0, 0))
            some = np.flatnonzero(np.diff(bounds))
            signed = [None] * batch.num_rows
            if len(some):
                made = signatures(hashes, np.append(bounds[some], bounds[-1]), k)
                for i, row in zip(some.tolist(), made):
                    signed[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(range(at, at + batch.num_rows), pa.int64()),
                 pa.array(counts, pa.int64()), pa.array([d[0] for d in digests], pa.int64()),
                 pa.array([d[1] for d in digests], pa.int64()), pa.array(signed, pa.binary())],
                names=["doc_id", "text_hash", "row", "n", "h1", "h2", "signature"])
            at += batch.num_rows

    return sign


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(s, np.uint16) for s in column.to_pylist()])


def entries(symbols: np.ndarray) -> np.ndarray:
    """Keys of every signature: each chunk with each of its places left out."""
    n, k = symbols.shape
    chunks = symbols.reshape(n, k // WIDTH, WIDTH).astype(np.uint64)
    out = np.empty((n, k // WIDTH, WIDTH), np.uint64)
    for gap in range(WIDTH):
        code = np.zeros(chunks.shape[:2], np.uint64)
        for place in range(WIDTH):
            if place != gap:
                code = (code << np.uint64(16)) | chunks[:, :, place]
        out[:, :, gap] = mix(mix(code) + (np.arange(k // WIDTH, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(gap)))
    return out.reshape(n, -1)


def _enter(limit: int):
    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, node, crowd). Of a key with a crowd in one batch, only the first node is handed
        on, and the others become edges to it (rows without a key)."""
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = entries(_matrix(batch.column("signature")))
            nodes = np.repeat(np.asarray(batch.column("node")), keys.shape[1])
            keys = keys.ravel()
            order = np.lexsort((nodes, keys))
            keys, nodes = keys[order], nodes[order]
            head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            size = np.diff(np.append(head, len(keys)))
            crowd = np.repeat(size > limit, size)
            first = np.zeros(len(keys), bool)
            first[head] = True
            least = np.repeat(nodes[head], size)
            send, link = ~crowd | first, crowd & ~first
            yield _rows(["key", "node", "crowd"], keys[send].view(np.int64), nodes[send], np.where(crowd[send], -1, -2))
            if link.any():
                yield _rows(["key", "node", "crowd"], mix(nodes[link].view(np.uint64)).view(np.int64), nodes[link], least[link])

    return enter


def _rows(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64), pa.int64()) for c in columns], names=names)


def _meet(limit: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges (a, b, sure) from rows sorted by key and node; ``sure`` edges need no look at their distance.

        Of an unfinished key only the first ``limit`` nodes and their number are carried on.
        """
        carried = None  # key, smallest node, first nodes, whether a crowd
        for batch in batches:
            key, node, crowd = (np.asarray(batch.column(c)) for c in ("key", "node", "crowd"))
            ready = crowd >= 0
            if ready.any():
                yield _rows(["a", "b", "sure"], node[ready], crowd[ready], np.ones(ready.sum()))
                key, node, crowd = key[~ready], node[~ready], crowd[~ready]
            if not len(key):
                continue
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = np.append(head[1:], len(key))
            a, b, sure = [], [], []

            def finish(members, flagged, least):
                if not flagged and len(members) <= limit:
                    x, y = np.triu_indices(len(members), 1)
                    a.append(members[x])
                    b.append(members[y])
                    sure.append(np.zeros(len(x)))
                else:
                    rest = members[members != least]
                    a.append(rest)
                    b.append(np.full(len(rest), least))
                    sure.append(np.ones(len(rest)))

            # Keys of one node that end in this batch lead nowhere.
            busy = np.flatnonzero((ends - head > 1) | (head == 0) | (ends == len(key)))
            for i in busy:
                members, flagged = np.unique(node[head[i]:ends[i]]), bool((crowd[head[i]:ends[i]] == -1).any())
                least = members[0]
                if carried is not None:
                    if carried[0] == key[head[i]]:
                        least, flagged = min(least, carried[1]), flagged or carried[3]
                        members = np.unique(np.concatenate([carried[2], members]))
                    else:
                        finish(carried[2], carried[3], carried[1])
                    carried = None
                if ends[i] < len(key):
                    finish(members, flagged, least)
                elif flagged or len(members) > limit:
                    finish(members, True, least)
                    carried = key[head[i]], least, np.array([least]), True
                else:
                    carried = key[head[i]], least, members, flagged
            if a:
                yield _rows(["a", "b", "sure"], np.concatenate(a), np.concatenate(b), np.concatenate(sure))
        if carried is not None and len(carried[2]) > 1:
            members = carried[2]
            if carried[3] or len(members) > limit:
                rest = members[members != carried[1]]
                yield _rows(["a", "b", "sure"], rest, np.full(len(rest), carried[1]), np.ones(len(rest)))
            else:
                x, y = np.triu_indices(len(members), 1)
                yield _rows(["a", "b", "sure"], members[x], members[y], np.zeros(len(x)))

    return meet


def _close(limit: int):
    def close(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                apart = (_matrix(batch.column("sa")) != _matrix(batch.column("sb"))).sum(1)
                yield batch.select(["a", "b"]).filter(pa.array(apart <= limit))

    return close


def _verify(size: int, percent: int):
    """Links between the blocks of one task at a time; rows come sorted by task."""
    def verify(batches: Iterator[pa.RecordBatch]):
        held, task = [], None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j"))))
            start = 0
            for at in range(1, len(names) + 1):
                if at == len(names) or names[at] != names[start]:
                    if task is not None and names[start] != task:
                        yield from _links(pa.Table.from_batches(held), size, percent, task)
                        held = []
                    task = names[start]
                    held.append(batch.slice(start, at - start))
                    start = at
        if held:
            yield from _links(pa.Table.from_batches(held), size, percent, task)

    return verify


def _links(rows: pa.Table, size: int, percent: int, task: tuple) -> Iterator[pa.RecordBatch]:
    node, block = rows.column("node").to_numpy(), rows.column("block").to_numpy()
    hashes, bounds = _sets(rows.column("text").combine_chunks(), size)
    own, keep, seen = [], [], set()
    for i, digest in enumerate(zip(rows.column("h1").to_pylist(), rows.column("h2").to_pylist())):
        mine = np.unique(hashes[bounds[i]:bounds[i + 1]])
        # Another text of the same doc_id has come along with the node's; equal sets once.
        if len(mine) and _digest(mine) == digest and node[i] not in seen:
            seen.add(node[i])
            own.append(mine)
            keep.append(i)
    if len(own) < 2:
        return
    node, block = node[keep], block[keep]
    number = np.unique(np.concatenate(own), return_inverse=True)[1]
    sizes = np.array([len(s) for s in own])
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(number.max() + 1, np.int32)
    root = list(range(len(own)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    for i in range(len(own) - 1):
        mine = number[starts[i]:starts[i] + sizes[i]]
        mark[mine] = 1
        shared = np.add.reduceat(mark[number[starts[i + 1]:]], starts[i + 1:] - starts[i + 1])
        mark[mine] = 0
        hit = 100 * shared >= percent * (sizes[i] + sizes[i + 1:] - shared)
        if task[1] != task[2]:
            hit &= block[i + 1:] != block[i]
        for j in (np.flatnonzero(hit) + i + 1).tolist():
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(node[i])
                b.append(node[j])
    if a:
        yield _rows(["a", "b"], np.array(a), np.array(b))


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id",
                crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, and ``text_hash`` (xxhash64 of the text)."""
    m = chunk_count(percent / 100)
    k, limit = m * WIDTH, 2 * m - 1
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                         F.xxhash64(text).alias("text_hash"))
    signed = stored(narrow.mapInArrow(_sign(size, k), SIGNED), "signed")
    nodes = stored(signed.where("n > 0").groupBy("h1", "h2").agg(
        F.min("row").alias("node"), F.min_by(F.struct("doc_id", "text_hash"), "row").alias("of"), F.first("signature").alias("signature"),
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("least")), "nodes")

    met = (nodes.select("node", "signature").mapInArrow(_enter(crowd), "key long, node long, crowd long")
           .repartition("key").sortWithinPartitions("key", "node").mapInArrow(_meet(crowd), "a long, b long, sure long"))
    edges = stored(met.groupBy("a", "b").agg(F.max("sure").alias("sure")), "candidates")
    near = (edges.where("sure = 0").select("a", "b")
            .join(nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")
            .join(nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
            .mapInArrow(_close(limit), "a long, b long"))
    clusters = components(near.unionAll(edges.where("sure = 1").select("a", "b")))

    sizes = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    work = (clusters.join(sizes, "component").withColumnRenamed("component", "cluster")
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .select("cluster", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
            .join(nodes.select("node", F.col("of.doc_id").alias("id"), F.col("of.text_hash").alias("hash"), "h1", "h2"), "node"))
    whole = work.join(narrow, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))).select(
        "cluster", "i", "j", "node", "block", "h1", "h2", "text")
    links = (whole.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "block", "node")
             .mapInArrow(_verify(size, percent), "a long, b long"))
    linked = components(links)

    named = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("first"))
    named = named.join(names, "component").select("h1", "h2", "first")
    out = signed.select("doc_id", "text_hash", "row", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    alone = F.col("n") == 0
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
                      (alone | (F.col("row") == F.col("first.row"))).alias("kept"))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text",
                     doc_id: str = "doc_id") -> DataFrame:
    """One document of each group with all its columns; rows with equal ids and texts go or stay together."""
    groups = near_groups(docs, size, percent, text, doc_id)
    gone = (groups.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
            .agg(F.max("kept").alias("kept")).where("not kept").select(F.struct("gone_id", "gone_hash").alias("gone")))
    gone_name, = free_names(docs, "gone")
    gone = gone.withColumnRenamed("gone", gone_name)
    return docs.join(gone, docs[doc_id].eqNullSafe(gone[f"{gone_name}.gone_id"])
                     & (F.xxhash64(docs[text]) == gone[f"{gone_name}.gone_hash"]), "left_anti")
