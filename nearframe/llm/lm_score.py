"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased (A-Z) UTF-8 bytes and one end mark. Every byte is
decomposed into eight binary decisions. A decision's contexts are the last 0 to
``DEPTH`` bytes, newest first, which form a tree. Each node keeps how often the
training texts decided 0 and 1 there; its block probability is the
Krichevsky-Trofimov estimate, and its weighted probability is half that and half
the product of its children's (Willems, Shtarkov and Tjalkens 1995). A byte is
predicted by mixing the estimates of all depths along its context: a node counts
with weight ``estimate / (2 * weighted)``, the rest goes to the next depth, and
the last context that training has seen gets all that is left.

How it runs
-----------
The corpus is cut into slabs inside its input tasks. A slab hands out each of its
distinct words and byte grams once, with their training counts; the counts are
summed over the corpus, nodes are built per two newest context bytes, and only
the two top levels, at most 256 * 255 nodes, pass through the driver. What comes
back to a slab is one number per distinct word and gram of it, which its texts
are then scored with, streaming. No table of the corpus is sent to every task.

Defined results
---------------
* A null or empty text is the end mark alone and has its probability.
* Texts that are equal have equal scores; repeated rows are scored each.
* Without any training text, every byte has probability 1/256 and the base score is 0.
* An empty table gives an empty result. Long texts are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored
from .words import Words, slices

DEPTH = 5
# A slab ends at this many text bytes or distinct grams; larger ones repeat fewer words and grams. Small input
# splits share a task for that.
SLAB_BYTES, SLAB_KEYS, SPLITS = 48 << 20, 1 << 20, 4
# Keys in a batch that leaves a task.
ROWS_OUT = 1 << 16
# Distinct keys of a slab's parts that are held before they are put together.
HELD_KEYS = 1 << 18
MARK = 0xFF  # before and after every text; no byte of UTF-8
WORD_KEY, GRAM_KEY, TEXT = 0, 1, 2
# Entries of a direct table that a slab's grams are looked up in; above, they are searched.
TABLE_SIZE = 8 << 20
SLABS = "chunk long, kind int, key long, count double, body binary"
SCORES = "doc_id long, train boolean, n_words long, known long, log_words double, n_bytes long, score double"


# ---- bytes and grams

def padded(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All texts with ``DEPTH`` marks before and one after each; and the first position of each text's decisions."""
    n = len(words.offsets) - 1
    block = words.offsets[:-1] + np.arange(n) * (DEPTH + 1)
    out = np.full(len(words.data) + n * (DEPTH + 1), MARK, np.uint8)
    body = np.ones(len(out), bool)
    for i in range(DEPTH):
        body[block + i] = False
    body[block + DEPTH + np.diff(words.offsets)] = False
    out[body] = words.data
    return out, block + DEPTH


def grams(text: np.ndarray) -> np.ndarray:
    """Code of each byte from ``DEPTH`` on: its context, newest byte first, and then the byte."""
    code, n = np.zeros(len(text) - DEPTH, np.uint64), len(text) - DEPTH
    for i in range(1, DEPTH + 1):
        code = (code << np.uint64(8)) | text[DEPTH - i:DEPTH - i + n]
    return (code << np.uint64(8)) | text[DEPTH:]


def _decisions(starts: np.ndarray, sizes: np.ndarray, total: int) -> np.ndarray:
    """Which positions after the first ``DEPTH`` are bytes of a text or its end mark."""
    inside = np.zeros(total + 1, np.int8)
    np.add.at(inside, starts - DEPTH, 1)
    np.add.at(inside, starts - DEPTH + sizes + 1, -1)
    return np.cumsum(inside[:-1], dtype=np.int8) > 0


# ---- slabs

def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


def _distinct(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys with the number of times that training texts have them."""
    parts = []
    for own, weight in ((keys[train], 1), (keys[~train], 0)):
        own = np.sort(own)
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
        parts.append((own[head], np.diff(np.append(head, len(own))) * float(weight)))
    return _counted(*(np.concatenate(c) for c in zip(*parts)))


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in packed pieces, whose key is the number of training texts, and after them the slab's words and grams."""
    part, slab, size = TaskContext.get().partitionId() << 24, 0, 0
    held: dict[int, list] = {WORD_KEY: [], GRAM_KEY: []}

    def keys(chunk):
        for kind, parts in held.items():
            if parts:
                key, count = _counted(*(np.concatenate(c) for c in zip(*parts)))
                parts.clear()
                for at in range(0, len(key), ROWS_OUT):
                    own = slice(at, at + ROWS_OUT)
                    yield _slab_rows(chunk, kind, key[own].view(np.int64), count[own])

    for batch in (piece for whole in batches for piece in slices(whole, limit=1 << 20)):
        words = Words(batch.column("text"), lower=True)
        train = np.asarray(batch.column("train").fill_null(False).cast(pa.int8())).astype(bool)
        text, starts = padded(words)
        sizes = np.diff(words.offsets)
        inside = _decisions(starts, sizes, len(text) - DEPTH)
        of_text = np.repeat(train, sizes + 1)
        for kind, found, flag in ((WORD_KEY, words.hashes(), train[words.text()]),
                                  (GRAM_KEY, grams(text)[inside], of_text)):
            held[kind].append(_distinct(found, flag))
            if sum(len(key) for key, _ in held[kind][1:]) > HELD_KEYS:
                held[kind] = [_counted(*(np.concatenate(c) for c in zip(*held[kind])))]
        yield _slab_rows(part + slab, TEXT, np.array([train.sum()]), np.zeros(1), [_packed(batch)])
        size += len(words.data)
        if size >= SLAB_BYTES or len(held[GRAM_KEY][0][0]) >= SLAB_KEYS:
            yield from keys(part + slab)
            slab, size = slab + 1, 0
    yield from keys(part + slab)


def _slab_rows(chunk: int, kind: int, key: np.ndarray, count: np.ndarray, body: list | None = None) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, chunk)), pa.array(np.full(n, kind, np.int32)), pa.array(key), pa.array(count),
         pa.nulls(n, pa.binary()) if body is None else pa.array(body, pa.binary())],
        names=["chunk", "kind", "key", "count", "body"])


def _packed(batch: pa.RecordBatch) -> bytes:
    """A batch of texts as one compressed value, so that they are sorted and shuffled small."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        # Only the rows of the batch, not all of the buffers that it is a slice of.
        stream.write_batch(batch.take(pa.array(np.arange(batch.num_rows))))
    return out.getvalue().to_pybytes()


# ---- the context tree

def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series eight steps up, and down again by the recurrence."""
    y = x + 8
    down = x.copy()
    for i in range(1, 8):
        down *= x + i
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(down)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


class Level:
    """Nodes of one depth: for each of the eight decisions, sorted keys with what they have counted."""

    def __init__(self, context: np.ndarray, byte: np.ndarray, count: np.ndarray):
        # One entry per context and byte, sorted.
        code, self.count = _counted((context << np.uint64(8)) | byte, count)
        self.context, self.byte = code >> np.uint64(8), code & np.uint64(0xFF)
        self.keys, self.zeros, self.ones = [], [], []
        for j in range(8):
            key = self.key(self.context, self.byte, j)
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            one = self.count * ((self.byte >> np.uint64(7 - j)) & np.uint64(1)).astype(float)
            self.keys.append(key[head])
            self.ones.append(np.add.reduceat(one, head))
            self.zeros.append(np.add.reduceat(self.count, head) - self.ones[-1])

    @staticmethod
    def key(context: np.ndarray, byte: np.ndarray, j: int) -> np.ndarray:
        """A node: its context, the number of the decision and the bits decided before it."""
        return (context << np.uint64(8)) | np.uint64(1 << j) | (byte >> np.uint64(8 - j))

    def weigh(self, children: list[np.ndarray] | None) -> None:
        """Set log block and weighted probabilities; ``children`` are sums of the children's."""
        self.block = [estimate(z, o) for z, o in zip(self.zeros, self.ones)]
        self.weighted = self.block if children is None else [
            np.logaddexp(b, c) - math.log(2) for b, c in zip(self.block, children)]

    def sums_for(self, parent: Level) -> list[np.ndarray]:
        """For each of the parent's nodes, the log weighted probabilities of its children summed up."""
        out = []
        for j in range(8):
            above = ((self.keys[j] >> np.uint64(16)) << np.uint64(8)) | (self.keys[j] & np.uint64(0xFF))
            out.append(np.bincount(np.searchsorted(parent.keys[j], above), self.weighted[j], len(parent.keys[j])))
        return out

    def predict(self, context: np.ndarray, byte: np.ndarray, j: int, deeper: np.ndarray | None) -> np.ndarray:
        """The share of the decision that ``byte`` takes; not a number where training has no such node."""
        at = np.minimum(np.searchsorted(self.keys[j], self.key(context, byte, j)), len(self.keys[j]) - 1)
        zeros, ones = self.zeros[j][at], self.ones[j][at]
        seen = (self.keys[j][at] == self.key(context, byte, j)) & (zeros + ones > 0)
        one = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
        own = (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1)
        if deeper is not None:
            weight = np.exp(self.block[j][at] - self.weighted[j][at] - math.log(2))
            own = np.where(np.isnan(deeper), own, weight * own + (1 - weight) * deeper)
        return np.where(seen, own, np.nan)


def _levels(code: np.ndarray, count: np.ndarray, top: int) -> list[Level]:
    """Levels ``top`` to ``DEPTH`` of the given grams, weighed."""
    byte = code & np.uint64(0xFF)
    levels = [Level(code >> np.uint64(8 * (DEPTH - d + 1)), byte, count) for d in range(top, DEPTH + 1)]
    children = None
    for i in range(len(levels) - 1, -1, -1):
        levels[i].weigh(children)
        if i:
            children = levels[i].sums_for(levels[i - 1])
    return levels


# A node's key has the oldest context byte last, so cutting eight bits off a context gives its parent.

def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams in order, in pieces that hold all grams of their two newest context bytes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def whole() -> tuple[np.ndarray, np.ndarray]:
        code, count = (np.concatenate(c) for c in zip(*held))
        held.clear()
        return code, count

    for batch in batches:
        if not batch.num_rows:
            continue
        code = np.asarray(batch.column("key")).view(np.uint64)
        count = np.asarray(batch.column("count"))
        pair = code >> np.uint64(8 * (DEPTH - 1))
        if held and held[-1][0][-1] >> np.uint64(8 * (DEPTH - 1)) != pair[0]:
            yield whole()
        cut = int(np.searchsorted(pair, pair[-1]))
        if cut:
            held.append((code[:cut], count[:cut]))
            yield whole()
        held.append((code[cut:], count[cut:]))
    if held:
        yield whole()


def _lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the nodes below two context bytes add to those of one: (context, byte, count) and (key, log weighted)."""
    for code, count in _groups(batches):
        level = _levels(code, count, 2)[0]
        out = [(0, level.context >> np.uint64(8), level.byte, level.count)]
        for j in range(8):
            out.append((1, level.keys[j] >> np.uint64(16), level.keys[j] & np.uint64(0xFF), level.weighted[j]))
        for what, context, low, value in out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(value), what, np.int32)),
                 pa.array(((context << np.uint64(8)) | low).astype(np.int64)), pa.array(value)],
                names=["what", "key", "value"])


def _upper(rows: list) -> list[Level]:
    """The levels of no and of one context byte, from at most 2 * 256 * 255 sums."""
    code = np.array([r["key"] for r in rows if r["what"] == 0], np.uint64)
    count = np.array([r["value"] for r in rows if r["what"] == 0])
    below = {r["key"]: r["value"] for r in rows if r["what"] == 1}
    one = Level(code >> np.uint64(8), code & np.uint64(0xFF), count)
    one.weigh([np.array([below[int(k)] for k in keys]) for keys in one.keys])
    zero = Level(np.zeros(len(code), np.uint64), code & np.uint64(0xFF), count)
    zero.weigh(one.sums_for(zero))
    return [zero, one]


def _predicted(upper: list[Level]):
    def predict(batches: Iterator[pa.RecordBatch]):
        for code, count in _groups(batches):
            levels = upper + _levels(code, count, 2)
            byte = code & np.uint64(0xFF)
            value = np.zeros(len(code))
            for j in range(8):
                share = None
                for d in range(DEPTH, -1, -1):
                    context = code >> np.uint64(8 * (DEPTH - d + 1))
                    share = levels[d].predict(context, byte, j, share)
                value += np.log10(np.where(np.isnan(share), 0.5, share))
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(value)], names=["key", "value"])

    return predict


def gram_scores(counts: DataFrame) -> DataFrame:
    """(key, value): log10 of the probability of each gram's byte in its context, from (key, count)."""
    pair = F.shiftright("key", 8 * (DEPTH - 1))
    ordered = counts.repartition(pair).sortWithinPartitions("key")
    tops = (ordered.mapInArrow(_lower, "what int, key long, value double")
            .groupBy("what", "key").agg(F.sum("value").alias("value")).collect())
    return ordered.mapInArrow(_predicted(_upper(tops) if tops else []), "key long, value double")


# ---- scores

class _Lookup:
    """Numbers by gram, found one byte at a time: the number of the bytes so far and the next byte give the
    next number, by a direct table where that is small and by a search among the ones that occur elsewhere."""

    def __init__(self, code: np.ndarray, value: np.ndarray):
        order = np.argsort(code)
        code, self.value = code[order], value[order].astype(np.float32)
        used = np.zeros(256, bool)
        for i in range(DEPTH + 1):
            used[((code >> np.uint64(8 * i)) & np.uint64(0xFF)).astype(np.int64)] = True
        self.number = (np.cumsum(used) - 1).astype(np.int32)
        self.base, self.steps = int(used.sum()), []
        at, ids = np.zeros(len(code), np.int64), 1
        for i in range(DEPTH, -1, -1):
            at = at * self.base + self.number[((code >> np.uint64(8 * i)) & np.uint64(0xFF)).astype(np.int64)]
            # The grams are in order, so the numbers of their beginnings are too.
            known = at[np.append(True, at[1:] != at[:-1])]
            if ids * self.base <= TABLE_SIZE:
                table = np.zeros(ids * self.base, np.int32)
                table[known] = np.arange(len(known), dtype=np.int32)
                self.steps.append((True, table))
            else:
                self.steps.append((False, known))
            ids = len(known)
            at = np.searchsorted(known, at)

    def get(self, text: np.ndarray) -> np.ndarray:
        """The numbers of all positions from ``DEPTH`` on; only those of known grams mean anything."""
        byte, n = self.number[text], len(text) - DEPTH
        at = np.zeros(n, np.int64)
        for i, (direct, step) in zip([*range(1, DEPTH + 1), 0], self.steps):
            at = at * self.base + byte[DEPTH - i:DEPTH - i + n]
            at = step[at].astype(np.int64) if direct else np.minimum(np.searchsorted(step, at), len(step) - 1)
        return self.value[at]


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Score texts; per slab the numbers of its words and grams come first."""
    chunk, parts, ready = None, {WORD_KEY: [], GRAM_KEY: []}, None
    for batch in batches:
        chunks, kinds = np.asarray(batch.column("chunk")), np.asarray(batch.column("kind"))
        cuts = np.flatnonzero((chunks[1:] != chunks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b <= a:
                continue
            piece, kind = batch.slice(a, b - a), int(kinds[a])
            if chunk != chunks[a]:
                chunk, parts, ready = chunks[a], {WORD_KEY: [], GRAM_KEY: []}, None
            if kind != TEXT:
                value = np.asarray(piece.column("count"), np.float32 if kind == GRAM_KEY else np.float64)
                parts[kind].append((np.array(piece.column("key")).view(np.uint64), value))
                continue
            if ready is None:
                key, count = ([np.concatenate(c) for c in zip(*parts.pop(WORD_KEY))] if parts[WORD_KEY]
                              else [np.zeros(0, np.uint64), np.zeros(0)])
                order = np.argsort(key)
                ready = key[order], count[order], _Lookup(*(np.concatenate(c) for c in zip(*parts.pop(GRAM_KEY))))
                parts = {WORD_KEY: [], GRAM_KEY: []}
            for body in piece.column("body"):
                for texts in pa.ipc.open_stream(body.as_buffer()):
                    yield _scored(texts, *ready)


def _scored(piece: pa.RecordBatch, key: np.ndarray, count: np.ndarray, lookup: _Lookup) -> pa.RecordBatch:
    words = Words(piece.column("text"), lower=True)
    counts = count[np.searchsorted(key, words.hashes())] if len(words) else np.zeros(0)

    def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return running[bounds[1:]] - running[bounds[:-1]]

    text, starts = padded(words)
    sizes = np.diff(words.offsets)
    numbers = lookup.get(text)[_decisions(starts, sizes, len(text) - DEPTH)]
    return pa.RecordBatch.from_arrays(
        [piece.column("doc_id"), piece.column("train"), pa.array(words.counts),
         pa.array(per_text(counts > 0, words.first).astype(np.int64)),
         pa.array(per_text(np.log10(counts + 0.1), words.first)), pa.array(sizes),
         pa.array(per_text(numbers, np.concatenate([[0], np.cumsum(sizes + 1)])))],
        names=["doc_id", "train", "n_words", "known", "log_words", "n_bytes", "score"])


def score_texts(docs: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Scores of all texts by a model of those rows where ``train`` holds.

    doc_id, train, n_tokens, n_known, train_tokens, base_score (word frequencies
    with add-0.1 smoothing), score (log10 probability) and bits_per_byte.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"),
                         F.col(text).alias("text"))
    splits = narrow.rdd.getNumPartitions()
    fewer = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-splits // SPLITS))
    slabs = stored((narrow.coalesce(fewer) if fewer < splits else narrow).mapInArrow(_slabs, SLABS), "slabs", compression="zstd")

    def summed(kind: int) -> DataFrame:
        return stored(slabs.where(F.col("kind") == kind).groupBy("key").agg(F.sum("count").alias("count")), "counts")

    words, found = summed(WORD_KEY), summed(GRAM_KEY)
    # Numbers of grams are used as floats, and as such are shuffled in half the bytes.
    values = [(WORD_KEY, words.withColumnRenamed("count", "value")),
              (GRAM_KEY, gram_scores(found).withColumn("value", F.col("value").cast("float").cast("double")))]
    rows = slabs.where(F.col("kind") == TEXT)
    for kind, value in values:
        back = (slabs.where(F.col("kind") == kind).select("chunk", "kind", "key").join(value, "key")
                .withColumnRenamed("value", "count"))
        rows = rows.unionByName(back, allowMissingColumns=True)
    scored = rows.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_score, SCORES)

    total = words.agg(F.coalesce(F.sum("count"), F.lit(0.0)).alias("tokens"),
                      F.count_if(F.col("count") > 0).alias("distinct")).first()
    ends = slabs.where(F.col("kind") == TEXT).agg(F.coalesce(F.sum("key"), F.lit(0))).first()[0]
    tokens, distinct = int(total["tokens"]) + ends, total["distinct"] + (ends > 0)
    n_tokens = F.col("n_words") + 1
    share = F.lit(math.log10(tokens + 0.1 * (distinct + 1)))
    return scored.select(
        "doc_id", "train", n_tokens.alias("n_tokens"), (F.col("known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log_words") + F.lit(math.log10(ends + 0.1)) - n_tokens * share).alias("base_score"), "score",
        (-F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
