"""Benchmark decontamination: short test items inside long documents.

An item is contained in a document if at least a threshold of its distinct
five-word shingles occur in it. The search is by MinHash, partitioned by size:
items go to partitions by their number of shingles q, and an item's sketch is
its s smallest values under a random hash. How large s has to be follows from q:
a document with ``ceil(t * q)`` of the shingles lacks at most ``q - ceil(t * q)``
of them, so it has one of any ``s = q - ceil(t * q) + 1``. Hence the sketches find
every containing document, however long, and a partition is only searched for
documents that have enough shingles for its smallest item. What is found is
verified with the words of the shingles themselves.

Items are sent to the tasks in blocks of about ``BLOCK_BYTES``. With more than one
block, what a block finds is written to the shared folder before the next one is
collected, so a larger benchmark takes more passes over the documents, not more memory.

Defined results
---------------
* Words are lower-cased (A-Z). An item of fewer words than a shingle is one
  shingle, its whole sequence, and is found as such a run of words.
* Null or empty items and documents contain nothing and are contained in nothing.
* Items with equal texts are reported each; repeated rows give repeated results.
* Ties do not arise: every pair at or above the threshold is reported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import free_names, stored
from .words import Words, mix, runs, slices, whole_run

# Bytes of item texts in the tasks' memory at a time.
BLOCK_BYTES = 8 << 20
FOUND = "doc_id long, item_id long, item_shingles long, found long, containment double"
_PERMUTE = np.uint64(0xD6E8FEB86659FD93)
_FILTER_BITS = 20


class Items:
    """A block of items with its size-partitioned index, built where it is first used."""

    def __init__(self, ids: list[int], texts: list[str], size: int, threshold: float):
        self.ids, self.texts, self.size, self.threshold = ids, texts, size, threshold

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("ids", "texts", "size", "threshold")}

    @cached_property
    def shingles(self) -> list[dict[int, set[bytes]]]:
        """Of each item: the words of its shingles, by hash."""
        out = []
        for text in self.texts:
            words = Words(pa.array([text]), lower=True)
            hashes, where, _ = runs(words, words.hashes(), self.size, short=True)
            own: dict[int, set[bytes]] = {}
            for code, first in zip(hashes.tolist(), where.tolist()):
                own.setdefault(code, set()).add(_words(words, first, min(self.size, len(words))))
            out.append(own)
        return out

    @cached_property
    def needed(self) -> np.ndarray:
        """Shingles that a document has to have of each item."""
        return np.array([math.ceil(self.threshold * sum(map(len, own.values())) - 1e-9) for own in self.shingles])

    @cached_property
    def partitions(self) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per width and class of sizes: width, least shingles needed, sketch values, their items, a bit filter."""
        members: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item, own in enumerate(self.shingles):
            if not own:
                continue
            total = sum(map(len, own.values()))
            width = min(self.size, len(Words(pa.array([self.texts[item]]))))
            codes = np.array(list(own), np.uint64)
            sketch = codes[np.argsort(mix(codes ^ _PERMUTE))][:total - int(self.needed[item]) + 1]
            members.setdefault((width, total.bit_length()), []).extend((int(c), item) for c in sketch)
        out = []
        for (width, _), pairs in sorted(members.items()):
            codes = np.array([c for c, _ in pairs], np.uint64)
            order = np.argsort(codes, kind="stable")
            items = np.array([i for _, i in pairs])[order]
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[codes >> np.uint64(64 - _FILTER_BITS)] = True
            out.append((width, int(self.needed[items].min()), codes[order], items, bits))
        return out

    def find(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, item's shingles, found ones) of every contained item."""
        words = Words(column, lower=True)
        single = words.hashes()
        by_width: dict[int, tuple] = {}
        for width, least, codes, items, bits in self.partitions:
            if width not in by_width:
                # Runs as long as the item, which of items below the shingle's size is the whole sequence.
                hashes, where, bounds = runs(words, single, width)
                if width < self.size:
                    hashes = whole_run(single, where, width)
                by_width[width] = hashes, where, bounds
            hashes, where, bounds = by_width[width]
            large = np.repeat(np.diff(bounds) >= least, np.diff(bounds))
            some = np.flatnonzero(bits[hashes >> np.uint64(64 - _FILTER_BITS)] & large)
            low = np.searchsorted(codes, hashes[some], "left")
            high = np.searchsorted(codes, hashes[some], "right")
            rows = np.searchsorted(bounds, some, "right") - 1
            pairs = {(int(r), int(i)) for r, a, b in zip(rows, low, high) if b > a for i in items[a:b]}
            for row, item in sorted(pairs):
                own = self.shingles[item]
                mine = hashes[bounds[row]:bounds[row + 1]]
                hit = np.flatnonzero(np.isin(mine, np.array(list(own), np.uint64)))
                if len(hit) < self.needed[item]:
                    continue
                seen: set[bytes] = set()
                for at in hit.tolist():
                    run = _words(words, int(where[bounds[row] + at]), width)
                    if run in own[int(mine[at])]:
                        seen.add(run)
                if len(seen) >= self.needed[item]:
                    yield row, item, sum(map(len, own.values())), len(seen)


def _words(words: Words, first: int, n: int) -> bytes:
    return b" ".join(words.data[words.starts[i]:words.ends[i]].tobytes() for i in range(first, first + n))


def _blocks(items: DataFrame, item_id: str, text: str, size: int, threshold: float) -> tuple[int, Iterator[Items]]:
    """The benchmark in blocks of bounded size, each collected when it is asked for, and their number."""
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // BLOCK_BYTES))

    def collect(block: int) -> Items:
        got = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == block).orderBy("id", "text").collect()
        return Items([r["id"] for r in got], [r["text"] for r in got], size, threshold)

    return count, map(collect, range(count))


def find_items(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8, doc_id: str = "doc_id",
               text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and an item that it contains."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    count, blocks = _blocks(items, item_id, item_text, size, threshold)
    for block in blocks:
        def search(batches, block=block):
            for batch in (part for whole in batches for part in slices(whole, "text")):
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[r], block.ids[i], n, k, k / n) for r, i, n, k in block.find(batch.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 5,
                                                          [pa.int64()] * 4 + [pa.float64()])],
                    names=["doc_id", "item_id", "item_shingles", "found", "containment"])

        part = narrow.mapInArrow(search, FOUND)
        if count > 1:
            part = stored(part, "found")
        out = part if out is None else out.unionAll(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8, text: str = "text",
                      item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that contain no item, with all their columns.

    With one block of items this is one pass and nothing is shuffled. With more, digests of the
    texts found are stored block by block and their documents are left out by a join.
    """
    count, blocks = _blocks(items, item_id, item_text, size, threshold)

    def dirty(block: Items, batch: pa.RecordBatch) -> pa.Array:
        found = np.zeros(batch.num_rows, bool)
        for row, *_ in block.find(batch.column(batch.schema.get_field_index(text))):
            found[row] = True
        return pa.array(found)

    if count == 1:
        block = next(blocks)

        def keep(batches):
            for batch in (part for whole in batches for part in slices(whole, text)):
                yield batch.filter(pa.compute.invert(dirty(block, batch)))

        return docs.mapInArrow(keep, docs.schema)

    gone, (name,) = None, free_names(docs, "digest")
    for block in blocks:
        def drop(batches, block=block):
            for batch in (part for whole in batches for part in slices(whole, text)):
                yield batch.filter(dirty(block, batch)).select([name])

        digests = docs.select(F.col(text), F.md5(F.col(text).cast("binary")).alias(name))
        part = stored(digests.mapInArrow(drop, f"{name} string"), "contaminated")
        gone = part if gone is None else gone.unionAll(part)
    gone = gone.distinct()
    return docs.join(gone, F.md5(docs[text].cast("binary")) == gone[name], "left_anti")
