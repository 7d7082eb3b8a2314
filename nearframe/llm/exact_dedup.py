"""Exact deduplication by Grace hashing.

Texts are equal when they are the same bytes after lower-casing A-Z. Rows are
split by a hash of the text, first within each input task and then, with one row
per text and task left, over the cluster. Inside a task an open-addressing table
holds the texts and compares them in full; once the table is full, rows of other
texts go to spill files, one per value of the next hash bits, and each file is
treated in the same way until its texts fit. A text is always in the table or in
one file as a whole, and every pass takes at least one text, so it always ends.

Defined results
---------------
* A null text is the empty text; all such rows form one group.
* Of equal texts the row with the largest ``doc_id`` stays; a null id is below
  every number. Of rows that repeat that id exactly one stays.
* An empty table gives an empty result. Other columns are carried along and may
  have any name.
* A very long text takes part whole; one text has to fit into a task's memory.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import free_names, stored
from .words import slices

# Text bytes that one table may hold.
TABLE_BYTES = 24 << 20
# Spill files per level; each level looks at the next four bits of the hash.
FAN_OUT, LEVEL_BITS = 16, 4
_ENTRY_BYTES = 200


class _Table:
    """Open addressing with linear probing; a match compares the whole text."""

    def __init__(self):
        self.slots = array("q", [-1]) * 1024
        self.hashes, self.texts, self.used = [], [], 0

    def find(self, code: int, text: bytes) -> int:
        """The entry of ``text``, or minus one."""
        mask = len(self.slots) - 1
        at = code & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == code and self.texts[entry] == text:
                return entry
            at = (at + 1) & mask
        return -1

    def add(self, code: int, text: bytes) -> int:
        if 2 * (len(self.texts) + 1) > len(self.slots):
            self.slots = array("q", [-1]) * (2 * len(self.slots))
            for entry, other in enumerate(self.hashes):
                self._place(other, entry)
        self.hashes.append(code)
        self.texts.append(text)
        self.used += len(text) + _ENTRY_BYTES
        self._place(code, len(self.texts) - 1)
        return len(self.texts) - 1

    def _place(self, code: int, entry: int) -> None:
        mask = len(self.slots) - 1
        at = code & mask
        while self.slots[at] >= 0:
            at = (at + 1) & mask
        self.slots[at] = entry


class GraceFold:
    """Folds Arrow batches with a column of texts into one row per text.

    ``members`` reports every row with the key of its text (the number of the
    first row seen with it); ``gather`` keeps the numbers of all rows of a text,
    for input that has one row per text and task.
    """

    def __init__(self, text: str, doc_id: str, row: str, count: str | None, limit: int):
        self.text, self.doc_id, self.row, self.count, self.limit = text, doc_id, row, count, limit

    def run(self, batches: Iterator[pa.RecordBatch], members: bool = False,
            gather: bool = False) -> Iterator[tuple[str, tuple]]:
        """Yields ("members", (rows, keys)) and ("best", (rows, keys, sizes, digests)), a row per text."""
        with tempfile.TemporaryDirectory() as folder:
            yield from self._level(batches, 0, folder, members, gather)

    def _level(self, batches, level, folder, members, gather):
        table, best, sizes, keys, parts = _Table(), [], [], [], {}
        kept: list[pa.RecordBatch] = []   # rows that were the best of their batch
        place: list[tuple[int, int]] = []  # of each entry: kept batch, row in it
        held = 0
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(self.text)).cast(pa.large_binary()).to_pylist()
            ids = batch.column(batch.schema.get_field_index(self.doc_id)).to_pylist()
            rows = batch.column(batch.schema.get_field_index(self.row)).to_pylist()
            counts = batch.column(batch.schema.get_field_index(self.count)).to_pylist() if self.count else None
            spilled: dict[int, list[int]] = {}
            improved: dict[int, int] = {}
            owner = []
            for i, text in enumerate(texts):
                text = (text or b"").lower()
                code = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")
                entry = table.find(code, text)
                rank = (ids[i] is not None, ids[i] or 0, -rows[i])
                if entry < 0:
                    if table.texts and table.used + len(text) > self.limit:
                        # Low bits pick the slot, so files are cut by the high bits.
                        part = (code >> (60 - LEVEL_BITS * level)) % FAN_OUT if level < 16 else 0
                        spilled.setdefault(part, []).append(i)
                        continue
                    entry = table.add(code, text)
                    best.append(rank)
                    sizes.append(0)
                    keys.append([] if gather else [rows[i]])
                    place.append((-1, -1))
                    improved[entry] = i
                elif rank > best[entry]:
                    best[entry] = rank
                    improved[entry] = i
                sizes[entry] += counts[i] if counts else 1
                if members:
                    owner.append((i, keys[entry][0]))
                if gather:
                    keys[entry].append(rows[i])
            if members and owner:
                some = batch.take(pa.array([i for i, _ in owner], pa.int64()))
                yield "members", (some, [key for _, key in owner])
            for part, picks in spilled.items():
                if part not in parts:
                    sink = pa.OSFile(os.path.join(folder, f"{level}-{part}"), "wb")
                    parts[part] = sink, pa.ipc.new_stream(sink, batch.schema)
                parts[part][1].write_batch(batch.take(pa.array(picks, pa.int64())))
            if improved:
                for j, entry in enumerate(improved):
                    place[entry] = len(kept), j
                kept.append(batch.take(pa.array(list(improved.values()), pa.int64())))
                held += kept[-1].num_rows
                if held > 2 * len(place) + 1000:  # rows that a better one has replaced
                    kept = [self._rows(kept, place)]
                    place, held = [(0, j) for j in range(len(place))], len(place)
        if place:
            yield "best", (self._rows(kept, place), keys, sizes, [hashlib.sha256(t).hexdigest() for t in table.texts])
        del table, best, kept, place, keys
        for part, (sink, writer) in parts.items():
            writer.close()
            sink.close()
            path = os.path.join(folder, f"{level}-{part}")
            inner = os.path.join(folder, f"in{level}-{part}")
            os.mkdir(inner)
            with pa.memory_map(path) as source:
                yield from self._level(iter(pa.ipc.open_stream(source)), level + 1, inner, members, gather)
            os.remove(path)

    @staticmethod
    def _rows(kept: list[pa.RecordBatch], place: list[tuple[int, int]]) -> pa.RecordBatch:
        starts, total = [], 0
        for batch in kept:
            starts.append(total)
            total += batch.num_rows
        whole = pa.Table.from_batches(kept).take(pa.array([starts[b] + j for b, j in place], pa.int64()))
        return whole.combine_chunks().to_batches()[0]


def _numbered(batches: Iterator[pa.RecordBatch], name: str, text: str) -> Iterator[pa.RecordBatch]:
    """Add a number that no other row of the job has."""
    at = TaskContext.get().partitionId() << 40
    for batch in _cut(batches, text):
        yield batch.append_column(name, pa.array(range(at, at + batch.num_rows), pa.int64()))
        at += batch.num_rows


def _cut(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    return (part for whole in batches for part in slices(whole, text))


def _hash(df: DataFrame, text: str):
    """Where a text goes: equal texts have equal values."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.xxhash64(F.translate(F.coalesce(df[text], F.lit("")), upper, upper.lower()))


def drop_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, with all their columns. One shuffle, of one row per text and input task."""
    row, = free_names(df, "_row")
    width, schema = len(df.columns), df.schema
    fold = GraceFold(text, doc_id, row, None, table_bytes)

    def local(batches):
        for _, (rows, *_) in fold.run(_numbered(batches, row, text)):
            yield rows

    def over_all(batches):
        for _, (rows, *_) in fold.run(_cut(batches, text)):
            yield rows.select(list(range(width)))

    near = df.mapInArrow(local, T.StructType([*schema.fields, T.StructField(row, T.LongType())]))
    return near.repartition(_hash(near, text)).mapInArrow(over_all, schema)


LOCAL = "doc_id long, row long, key long, size long, text string, best boolean"
GROUP = "key long, keep_id long, keep_row long, group_size long, text_sha256 string"


def copy_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept, text_sha256.

    Each input task writes its rows with the key of their text in that task, and
    each text once. The texts are shuffled and folded; what comes back per key is
    joined to the thin rows.
    """
    narrow = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def local(batches):
        fold = GraceFold("text", "doc_id", "row", None, table_bytes)
        for kind, (rows, keys, *more) in fold.run(_numbered(batches, "row", "text"), members=True):
            n, best = rows.num_rows, kind == "best"
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("row"),
                 pa.array([k[0] for k in keys] if best else keys, pa.int64()),
                 pa.array(more[0] if best else [None] * n, pa.int64()),
                 rows.column("text").cast(pa.string()) if best else pa.nulls(n, pa.string()),
                 pa.array([best] * n, pa.bool_())],
                names=["doc_id", "row", "key", "size", "text", "best"])

    def over_all(batches):
        # The row of a text in this step is its key in its task; the best row's own number rides along.
        fold = GraceFold("text", "doc_id", "key", "size", table_bytes)
        for _, (rows, keys, sizes, digests) in fold.run(_cut(batches, "text"), gather=True):
            ids, winners = rows.column("doc_id").to_pylist(), rows.column("row").to_pylist()
            flat = [(k, ids[i], winners[i], sizes[i], digests[i]) for i in range(len(keys)) for k in keys[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*flat), [pa.int64()] * 4 + [pa.string()])],
                names=["key", "keep_id", "keep_row", "group_size", "text_sha256"])

    near = stored(narrow.mapInArrow(local, LOCAL), "copies")
    texts = near.where("best").select("doc_id", "row", "key", "size", "text")
    groups = texts.repartition(_hash(texts, "text")).mapInArrow(over_all, GROUP)
    rows = near.where("not best").select("doc_id", "row", "key")
    return rows.join(groups, "key").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
