"""Words of whole texts as arrays: bounds, 64-bit hashes and hashes of runs of words.

A word is a run of bytes other than space and ``\\x09``-``\\x0D``. All functions
work on the bytes of an Arrow text column at once; no text is cut or dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text bytes handled at a time inside a task; a longer single text is one slice of its own.
SLICE_BYTES = 4 << 20
# Words above this many bytes are hashed one by one.
LONG_WORD = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = 0, size: str = "") -> Iterator[pa.RecordBatch]:
    """Cut a batch between rows so that the texts of a part stay near ``limit`` bytes.

    ``size`` names the column with the bytes of texts that come compressed.
    """
    limit = limit or SLICE_BYTES
    column = batch.column(batch.schema.get_field_index(size or text))
    ends = np.cumsum(np.asarray(column if size else pc.fill_null(pc.binary_length(column), 0)), dtype=np.int64)
    start, done = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[min(stop, batch.num_rows) - 1])


def text_bytes(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array and the offset of each text; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    data = data[offsets[0]:offsets[-1]]
    return LOWER[data] if lower else data, offsets - offsets[0]


class Words:
    """Words of a column of texts: byte bounds, and the first word of each text in ``first``."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.offsets = text_bytes(column, lower)
        solid = np.zeros(len(self.data) + 2, bool)
        np.logical_not(_SPACE[self.data], out=solid[1:-1])
        cuts = self.offsets[1:-1]
        starts, ends = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
        inner = cuts[(cuts > 0) & (cuts < len(self.data))]
        starts[inner] |= solid[1:-1][inner]
        ends[inner - 1] |= solid[1:-1][inner - 1]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self) -> np.ndarray:
        """The number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        lengths = self.ends - self.starts
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        out = mix(lengths.astype(np.uint64) + np.uint64(seed) * _A)
        live, at = np.arange(len(lengths)), self.starts
        long = np.flatnonzero(lengths > LONG_WORD)
        left = np.where(lengths > LONG_WORD, 0, lengths)
        while len(live):
            got = eights[at] & _MASK[np.minimum(left, 8)]
            out[live] = mix((out[live] ^ got) * _A)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        for i in long:
            whole = hashlib.blake2b(self.data[self.starts[i]:self.ends[i]].tobytes(), digest_size=8,
                                    salt=seed.to_bytes(8, "little")).digest()
            out[i] = int.from_bytes(whole, "little")
        return out


def spans(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` consecutive words from every word on, across texts; the last words start none."""
    span, total, parts, width, rest = hashes, None, 0, 1, n
    while rest:
        if rest & 1:
            if total is None:
                total, parts = span, width
            else:
                size = max(0, min(len(total), len(span) - parts))
                total, parts = mix(total[:size] * _A + span[parts:parts + size]), parts + width
        rest >>= 1
        if rest:
            size = max(0, len(span) - width)
            span = mix(span[:size] * _A + span[width:width + size])
            width *= 2
    return total


def inside(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all runs of ``n`` words inside one text, and their bounds per text."""
    sizes = np.maximum(words.counts - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(bounds[-1]) + np.repeat(words.first[:-1] - bounds[:-1], sizes), bounds


def whole_run(hashes: np.ndarray, where: np.ndarray, width: int) -> np.ndarray:
    """Hashes of runs of ``width`` words, made as :func:`runs` makes those of short texts."""
    value = np.full(len(where), width, np.uint64)
    for i in range(width):
        value = mix(value * _C + hashes[where + i])
    return value


def runs(words: Words, hashes: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one text.

    Returns the hashes, the first word of each run and the bounds per text.
    With ``short`` a text of fewer words, but at least one, has its whole
    sequence as its one run.
    """
    where, bounds = inside(words, n)
    total = spans(hashes, n)
    few = np.flatnonzero((words.counts > 0) & (words.counts < n)) if short else []
    if not len(few):
        return total[where], where, bounds
    sizes = np.diff(bounds)
    sizes[few] = 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    where = np.arange(bounds[-1]) + np.repeat(words.first[:-1] - bounds[:-1], sizes)
    out = np.empty(len(where), np.uint64)
    long = np.ones(len(where), bool)
    long[bounds[few]] = False
    out[long] = total[where[long]]
    for width in np.unique(words.counts[few]):
        some = few[words.counts[few] == width]
        out[bounds[some]] = whole_run(hashes, words.first[some], width)
    return out, where, bounds
