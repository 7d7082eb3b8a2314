"""Substring deduplication by seed and extend.

A window is ``length`` consecutive words of one document. Words covered by a
window whose words also start somewhere in a document with a smaller id are
removed; what stays is judged on the input.

Seeds are winnowed anchors: of the five-word runs in a window the one with the
smallest hash is its anchor. Equal windows have equal anchors at equal places, so
documents are joined on anchors. Around a shared anchor the match is extended to
both sides as far as the windows reach that chose it: a row carries, for each of
them, a hash of the words left and right of the anchor. All occurrences of an
anchor are extended together, sorted by document, so the first one with the same
extension is the smallest document and no pair of documents is ever formed.
Neighbouring matches are put together into maximal repeats at the end.

Before anything is shuffled, each task drops windows that a smaller document of
its own input settles, so a passage that very many documents share leaves a task
once. Two windows count as equal when two hashes agree: 40 bits of the anchor, and 64
bits, from other hashes of the words, of the whole window and the anchor's place in it.
Windows that share an anchor are told apart by all 64 bits of the latter. The anchor's
hash only brings rows together, so its other bits are not shuffled; whole texts are
shuffled once, each compressed.

Defined results
---------------
* Null and empty texts have no words, lose none and keep the empty text.
* A null id is above every number and below no other null.
* Rows with equal ids never remove words of each other; repeats inside one
  document stay. Rows with an id in common are told apart by a 64-bit hash of
  their text; those with equal texts too have one result.
* Texts of fewer words than a window are left as they are, but for white space.
* An empty table gives an empty result. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, inside, mix, slices, spans

ANCHOR = 5
# Windows of a task's input that are settled together before the shuffle.
SLAB = 2 << 20
_NULL_ID = (1 << 63) - 1
# Bits of an anchor's hash that rows are joined on.
ANCHOR_BITS = 40
_UPPER = np.uint64(2**64 - 2**(64 - ANCHOR_BITS))
SEEDS = "seed long, doc_id long, text_id long, place long, n int, extensions binary"
PACKED = "key long, doc_id long, text_id long, size long, packed binary"
MARKS = "doc_id long, text_id long, place long, n int"
KEPT = "n_words long, n_removed long, kept_text string, repeats array<struct<start:long,stop:long>>"


def _starts(*changes: np.ndarray) -> np.ndarray:
    """Where a run of neighbours that belong together begins."""
    new = np.ones(len(changes[0]) + 1, bool)
    if len(changes[0]):
        new[1:] = np.any(changes, axis=0)
        return np.flatnonzero(new)
    return np.flatnonzero(new)


def _runs(pos: np.ndarray, *owners: np.ndarray) -> np.ndarray:
    """First elements of runs of neighbouring windows of one owner (a text, an anchor)."""
    if not len(pos):
        return np.zeros(0, np.int64)
    return _starts(pos[1:] != pos[:-1] + 1, *(o[1:] != o[:-1] for o in owners))


class _Slab:
    """Windows of a part of a task's input."""

    def __init__(self, length: int):
        self.length, self.parts, self.size = length, [], 0

    def add(self, ids: np.ndarray, text_ids: np.ndarray, column: pa.Array) -> None:
        words = Words(column)
        where, bounds = inside(words, self.length)
        if not len(where):
            return
        window, small = spans(words.hashes(1), self.length)[where], spans(words.hashes(), ANCHOR)
        seed, offset = small[where], np.zeros(len(where), np.int64)
        for i in range(1, self.length - ANCHOR + 1):
            other = small[where + i]
            less = other < seed
            seed, offset = np.where(less, other, seed), np.where(less, i, offset)
        window = mix(window ^ offset.view(np.uint64))
        text = np.repeat(np.arange(len(ids)), np.diff(bounds))
        pos = where - words.first[text]
        self.parts.append((window, seed, where + offset + (self.size << 32), ids[text], text_ids[text], pos))
        self.size += len(where)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What the slab settles as marks, the rest as seeds."""
        if not self.parts:
            return
        window, seed, anchor, doc, text, place = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.size = [], 0
        # Only windows that occur twice in the slab are sorted.
        ordered = np.sort(window)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        bits = np.zeros(1 << 24, bool)
        bits[twice >> np.uint64(40)] = True
        some = np.flatnonzero(bits[window >> np.uint64(40)])
        some = some[np.lexsort((doc[some], seed[some], window[some]))]
        settled = np.zeros(len(window), bool)
        if len(some):
            head = _starts((window[some][1:] != window[some][:-1]) | (seed[some][1:] != seed[some][:-1]))
            least = np.repeat(doc[some][head], np.diff(np.append(head, len(some))))
            settled[some[doc[some] > least]] = True
        done = np.flatnonzero(settled)
        head = _runs(place[done], doc[done], text[done])
        if len(head):
            n = np.diff(np.append(head, len(done)))
            yield _seed_rows(doc[done][head], doc[done][head], text[done][head], place[done][head], n, None, None)
        open_ = np.flatnonzero(~settled)
        head = _runs(place[open_], doc[open_], anchor[open_])
        if len(head):
            n = np.diff(np.append(head, len(open_)))
            yield _seed_rows((seed[open_][head] & _UPPER).view(np.int64), doc[open_][head], text[open_][head],
                             place[open_][head], n, window[open_], head)


def _seed_rows(seed, doc, text, place, n, checks, head) -> pa.RecordBatch:
    if checks is None:
        binary = pa.nulls(len(seed), pa.binary())
    else:
        ends = np.append(head, len(checks)).astype(np.int32) * 8
        binary = pa.BinaryArray.from_buffers(pa.binary(), len(seed), [None, pa.py_buffer(ends), pa.py_buffer(checks)])
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int64()) for c in (seed, doc, text, place)), pa.array(n.astype(np.int32), pa.int32()), binary],
        names=["seed", "doc_id", "text_id", "place", "n", "extensions"])


def _seeds(length: int, slab_windows: int):
    def make(batches: Iterator[pa.RecordBatch]):
        slab = _Slab(length)
        for batch in (part for whole in batches for part in slices(whole)):
            slab.add(*(np.asarray(batch.column(c)) for c in ("key", "text_id")), batch.column("text"))
            if slab.size >= slab_windows:
                yield from slab.rows()
        yield from slab.rows()

    return make


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks from rows sorted by seed and document.

    Of the seed that a batch ends with, the extensions seen and their smallest
    document are carried over to the next batch.
    """
    carried = None
    for batch in batches:
        marks = pa.compute.is_null(batch.column("extensions"))
        settled = batch.filter(marks)
        if settled.num_rows:
            yield settled.select(["doc_id", "text_id", "place", "n"])
        batch = batch.filter(pa.compute.invert(marks))
        if not batch.num_rows:
            continue
        seed, doc, text, place, n = (np.asarray(batch.column(c)) for c in ("seed", "doc_id", "text_id", "place", "n"))
        joined = batch.column("extensions")
        ends = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset:joined.offset + len(joined) + 1]
        checks = np.frombuffer(joined.buffers()[2], np.uint64)[ends[0] // 8:ends[-1] // 8]
        alone = np.ones(len(seed), bool)
        same = seed[1:] == seed[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        alone[-1] = False  # may go on in the next batch
        if carried is not None and seed[0] == carried[0]:
            alone[0] = False
        rows = np.flatnonzero(~alone)
        of_row = np.repeat(np.arange(len(seed)), n)
        use = ~alone[of_row]
        check, row = checks[use], of_row[use]
        first = np.cumsum(n) - n
        at = np.arange(len(of_row))[use] - first[row]
        seeds, docs = seed[row], doc[row]
        extra = 0
        if carried is not None and seed[0] == carried[0]:
            extra = len(carried[1])
            seeds = np.concatenate([np.full(extra, carried[0]), seeds])
            check, docs = np.concatenate([carried[1], check]), np.concatenate([carried[2], docs])
        order = np.lexsort((docs, check, seeds))
        head = _starts((seeds[order][1:] != seeds[order][:-1]) | (check[order][1:] != check[order][:-1]))
        least = np.repeat(docs[order][head], np.diff(np.append(head, len(order)))) if len(order) else docs
        hit = np.sort(order[docs[order] > least])
        hit = hit[hit >= extra] - extra
        # Runs of settled windows inside a row.
        r, a = row[hit], at[hit]
        begin = _runs(a, r)
        if len(begin):
            size = np.diff(np.append(begin, len(hit)))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c[r[begin]], pa.int64()) for c in (doc, text)), pa.array(place[r[begin]] + a[begin], pa.int64()),
                 pa.array(size.astype(np.int32), pa.int32())], names=["doc_id", "text_id", "place", "n"])
        last = seeds[order][head] == seed[-1] if len(rows) else np.zeros(0, bool)
        carried = (seed[-1], check[order][head][last], docs[order][head][last])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts, each compressed for the shuffle."""
    codec = pa.Codec("zstd", compression_level=6)
    for batch in (part for whole in batches for part in slices(whole)):
        texts = [text or b"" for text in batch.column("text").cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("key", "doc_id", "text_id")), pa.array([len(text) for text in texts], pa.int64()),
             pa.array([codec.compress(text, asbytes=True) for text in texts], pa.binary())],
            names=["key", "doc_id", "text_id", "size", "packed"])


def _remove(length: int, names: list[str]):
    """Cut the marked words out of whole texts."""
    def cut(batches: Iterator[pa.RecordBatch]):
        codec = pa.Codec("zstd")
        for batch in (part for whole in batches for part in slices(whole, size="size")):
            marks = batch.column("marks").combine_chunks() if isinstance(batch.column("marks"), pa.ChunkedArray) \
                else batch.column("marks")
            offsets, flat = np.asarray(marks.offsets), marks.values
            places = np.asarray(flat.field("place")) if len(flat) else np.zeros(0, np.int64)
            sizes = np.asarray(flat.field("n")) if len(flat) else np.zeros(0, np.int32)
            out = ([], [], [], [])
            for i, (packed, size) in enumerate(zip(batch.column("packed").to_pylist(), batch.column("size").to_pylist())):
                words, covered = codec.decompress(packed, size, asbytes=True).split(), []
                own = slice(offsets[i], offsets[i + 1])
                if own.stop > own.start:
                    order = np.argsort(places[own])
                    starts, stops = places[own][order], (places[own] + sizes[own] + length - 1)[order]
                    reach = np.maximum.accumulate(stops)
                    head = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
                    covered = list(zip(starts[head].tolist(), reach[np.append(head[1:] - 1, len(reach) - 1)].tolist()))
                keep = bytearray(b"\1") * len(words)
                for a, b in covered:
                    keep[a:b] = bytes(b - a)
                kept = list(compress(words, keep)) if covered else words
                for column, value in zip(out, (len(words), len(words) - len(kept), b" ".join(kept), covered)):
                    column.append(value)
            made = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                    pa.array(out[2], pa.binary()).cast(pa.string()),
                    pa.array([[{"start": a, "stop": b} for a, b in c] for c in out[3]],
                             pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=names)

    return cut


def remove_repeats(docs: DataFrame, length: int = 13, text: str = "text", doc_id: str = "doc_id",
                   slab: int = SLAB) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text, and ``repeats``, the removed spans of words."""
    if length < ANCHOR:
        raise ValueError(f"length has to be {ANCHOR} words at least")
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed = narrow.select("*", F.coalesce("doc_id", F.lit(_NULL_ID)).alias("key"), F.xxhash64("text").alias("text_id"))
    seeds = keyed.select("key", "text_id", "text").mapInArrow(_seeds(length, slab), SEEDS)
    marks = seeds.repartition("seed").sortWithinPartitions("seed", "doc_id").mapInArrow(_extend, MARKS)
    # Rows with equal ids and texts have equal marks, of which one set is kept.
    marks = marks.groupBy(F.col("doc_id").alias("key"), "text_id").agg(
        F.collect_set(F.struct("place", "n")).alias("marks"))
    packed = keyed.select("key", "doc_id", "text_id", "text").mapInArrow(_pack, PACKED)
    rows = packed.join(marks, ["key", "text_id"], "left").select(
        "doc_id", "size", "packed", F.coalesce("marks", F.array().cast("array<struct<place:long,n:int>>")).alias("marks"))
    schema = f"doc_id long, {KEPT}"
    return rows.mapInArrow(_remove(length, ["doc_id", *(c.split()[0] for c in KEPT.split(", "))]), schema)
