"""A quality classifier with learned subword vectors.

A text's features are its trigrams and four-grams of code points (white space of any
kind is one character there), its words, and its pairs of adjacent words; a word that
repeats its predecessor is one feature of its own, whatever the word. Features
are hashed to a fixed number of buckets, each with a learned vector. The mean of
a text's vectors goes through a linear layer and a softmax. Vectors and layer
are trained together by stochastic gradient descent in numpy.

As mean and layer are linear, a trained model is one number per bucket and one
offset, half a megabyte whatever the corpus; every text is scored whole.

Defined results
---------------
* A null or empty text has no features: its score is the share of label 1 that
  the model starts from. Texts that are equal have equal scores.
* Training takes at most ``SAMPLE_ROWS`` labelled rows of each class, those with
  the smallest hash of their id. The offset is corrected for the true shares.
* Labels that are null, and labels of unknown or null ids, teach nothing.
* Without labels of both classes the score is the smoothed share of label 1, a
  half without any label. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import free_names
from .words import Words, mix, slices

# Bound of the training sample: labelled rows per class.
SAMPLE_ROWS = 1024
BUCKET_BITS = 17
WIDTH, STEPS, BATCH, RATE = 8, 1024, 16, 4.0
_POINT = np.uint32(0x01000193)
_REPEAT, _PAIR = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts that lie one behind the other, and where each text begins among them."""
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4"), begins[offsets]


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all features of a column of texts, in groups, each with its bounds per text."""
    words = Words(column)
    points, ends = characters(words.data, words.offsets)
    plain = np.where((points >= 9) & (points <= 13), np.uint32(32), points)
    shift, out = np.uint32(32 - BUCKET_BITS), []
    for n, odd in ((3, np.uint32(0x9E3779B1)), (4, np.uint32(0x85EBCA6B))):
        size = max(0, len(plain) - n + 1)
        gram = np.zeros(size, np.uint32)
        for i in range(n):
            gram = (gram ^ plain[i:size + i]) * _POINT
        counts = np.maximum(np.diff(ends) - n + 1, 0)
        gram = ((gram ^ (gram >> np.uint32(15))) * odd) >> shift
        out.append(_inner(gram, ends, counts))
    hashes = words.hashes()
    out.append(((hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32), words.first))
    pair = mix(hashes[:-1] * _PAIR + hashes[1:]) if len(hashes) else hashes
    if len(hashes):
        pair[hashes[:-1] == hashes[1:]] = _REPEAT
    out.append(_inner((pair >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32), words.first,
                      np.maximum(words.counts - 1, 0)))
    return out


def _inner(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of a running feature that lie inside one text."""
    bounds = np.concatenate([[0], np.cumsum(counts)])
    inside = np.zeros(len(values) + 1, np.int8)
    some = counts > 0
    np.add.at(inside, starts[:-1][some], 1)
    np.add.at(inside, starts[:-1][some] + counts[some], -1)
    return values[np.cumsum(inside[:-1], dtype=np.int8) > 0], bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    running = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return running[bounds[1:]] - running[bounds[:-1]]


class Model:
    """One number per bucket and an offset; ``score`` is the share of label 1."""

    def __init__(self, weights: np.ndarray | None, offset: float):
        self.weights, self.offset = weights, offset

    def score(self, column: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(column), 1 / (1 + np.exp(-self.offset)))
        total, count = np.zeros(len(column)), np.zeros(len(column))
        for buckets, bounds in features(column):
            total += _sums(self.weights[buckets], bounds)
            count += np.diff(bounds)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.offset, -500, 500)))


def shares_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text: its distinct buckets and the share of its features in each."""
    for i in range(len(column)):
        own = np.concatenate([b for b, _ in features(column.slice(i, 1))])
        which, count = np.unique(own, return_counts=True)
        yield which, (count / max(1, len(own))).astype(np.float32)


def fit(buckets: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Train vectors and layer; returns weights per bucket and offset for the given mixture of labels."""
    random = np.random.default_rng(7)
    vectors = (random.random((1 << BUCKET_BITS, WIDTH), np.float32) - 0.5) / WIDTH
    layer, bias = (random.random((2, WIDTH)) - 0.5).astype(np.float32), np.zeros(2)
    # As many steps for a small sample as for a large one.
    epochs = -(-STEPS // -(-len(labels) // BATCH))
    steps, step = epochs * -(-len(labels) // BATCH), 0
    for _ in range(epochs):
        order = random.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            index = np.concatenate([buckets[r] for r in rows])
            share = np.concatenate([shares[r] for r in rows])
            sizes = np.array([len(buckets[r]) for r in rows])
            row = np.repeat(np.arange(len(rows)), sizes)
            means = np.stack([np.bincount(row, vectors[index, k] * share, len(rows)) for k in range(WIDTH)], 1)
            logits = means @ layer.T + bias
            odds = np.exp(logits - logits.max(1, keepdims=True))
            error = odds / odds.sum(1, keepdims=True)
            error[np.arange(len(rows)), labels[rows]] -= 1
            touched, inverse = np.unique(index, return_inverse=True)
            # Both outputs' errors cancel, so one weighted count gives the gradient of every vector.
            pull = np.bincount(inverse, share * error[row, 1], len(touched))
            slope = layer[1] - layer[0]
            layer -= (rate / len(rows) * (error.T @ means)).astype(np.float32)
            bias -= rate / len(rows) * error.sum(0)
            vectors[touched] -= (rate * pull[:, None] * slope).astype(np.float32)
    return vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, text: str = "text",
          doc_id: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit a model on labelled documents; ``usable`` says which label rows may be learned from."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Model(None, float(np.log((n1 + 1) / (n0 + 1))))
    picks = [known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(sample_rows) for c in (0, 1)]
    sample = F.broadcast(picks[0].unionByName(picks[1]))  # at most 2 * sample_rows ids
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(sample, "id")

    def counted(batches: Iterator[pa.RecordBatch]):
        for batch in (part for whole in batches for part in slices(whole)):
            made = list(shares_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([w.astype("<u4").tobytes() for w, _ in made]),
                 pa.array([s.astype("<f4").tobytes() for _, s in made])], names=["id", "label", "buckets", "shares"])

    def fit_rows(batches: Iterator[pa.RecordBatch]):
        # One task, on the counted features of the bounded sample only.
        got = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        if not got:
            return
        got.sort()
        target = np.array([label for _, label, *_ in got])
        weights, offset = fit([np.frombuffer(b, "<u4") for *_, b, _ in got], [np.frombuffer(s, "<f4") for *_, s in got],
                              target)
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.astype("<f4").tobytes()]), pa.array([offset]),
             pa.array([int((target == 0).sum())]), pa.array([int((target == 1).sum())])],
            names=["weights", "offset", "n0", "n1"])

    rows = rows.select(F.col("id").cast("string").alias("id"), "label", "text").mapInArrow(
        counted, "id string, label int, buckets binary, shares binary")
    made = rows.repartition(1).mapInArrow(fit_rows, "weights binary, offset double, n0 long, n1 long").collect()
    if not made or not made[0]["n0"] or not made[0]["n1"]:
        return Model(None, float(np.log((n1 + 1) / (n0 + 1))))
    one = made[0]
    shift = np.log(n1 / n0) - np.log(one["n1"] / one["n0"])
    return Model(np.frombuffer(one["weights"], "<f4"), one["offset"] + float(shift))


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the score of every row's whole text under ``name``, which ``df`` must not have."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def add(batches: Iterator[pa.RecordBatch]):
        for batch in (part for whole in batches for part in slices(whole, text)):
            column = batch.column(batch.schema.get_field_index(text))
            yield batch.append_column(name, pa.array(model.score(column), pa.float64()))

    return df.mapInArrow(add, schema)


def keep_good(df: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Rows whose score reaches ``threshold``, with the columns they came with."""
    name, = free_names(df, "score")
    return score(df, model, text, name).where(F.col(name) >= threshold).drop(name)
