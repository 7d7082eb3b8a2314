import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearframe.llm import quality
from nearframe.llm.words import Words, mix
from made_texts import prose


def corpus(n):
    """Prose against capitals, repeated words and odd marks."""
    rows = []
    for i in range(n):
        text, kind = prose(i, 40), i % 4
        if kind == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind == 2:
            text = " ".join(w for w in text.split()[:6] for _ in range(8))
        elif kind == 3:
            text = " ".join(w + random.Random(i).choice(["***", "&&&"]) for w in text.split())
        rows.append((i, text, int(kind == 0)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t, -1.0) for i, t, _ in rows], "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5, None), (10**6, 0)],
                                   "doc_id long, quality int")
    model = quality.train(docs, labels, F.col("doc_id") % 5 != 0)
    again = quality.train(docs.repartition(5), labels, F.col("doc_id") % 5 != 0)
    assert np.array_equal(model.weights, again.weights) and model.offset == again.offset
    got = {r.doc_id: r.mine for r in quality.score(docs, model, name="mine").collect()}
    held = [(got[i], q) for i, _, q in rows if i % 5 == 0]
    assert np.mean([(s >= 0.3) == q for s, q in held]) > 0.97
    good = quality.keep_good(docs, model)
    assert good.columns == docs.columns and 140 <= good.count() <= 160


def test_awkward_texts(spark, documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    model = quality.train(documents, labels)
    rows = quality.score(documents, model, name="mine").collect()
    assert all(0 <= r.mine <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text or "", r.mine) == r.mine
    assert by_text[""] == 1 / (1 + np.exp(-model.offset))


def test_missing_labels_and_tables(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(documents, none).offset == 0
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    model = quality.train(documents, ones)
    assert {round(r.mine, 6) for r in quality.score(documents, model, name="mine").collect()} == {0.75}
    unknown = spark.createDataFrame([(-1, 1), (-2, 0)], "doc_id long, quality int")
    assert quality.train(documents, unknown).weights is None
    assert quality.score(documents.limit(0), model, name="mine").count() == 0


def plain_features(text):
    """Buckets of one text, one feature after the other, with whole numbers only."""
    out, points = [], [32 if 9 <= ord(c) <= 13 else ord(c) for c in text or ""]
    for n, odd in ((3, 0x9E3779B1), (4, 0x85EBCA6B)):
        for i in range(len(points) - n + 1):
            gram = 0
            for p in points[i:i + n]:
                gram = (gram ^ p) * 0x01000193 % 2**32
            out.append((gram ^ gram >> 15) * odd % 2**32 >> 32 - quality.BUCKET_BITS)
    words = re.findall("[^ \t\n\x0b\f\r]+", text or "")
    hashes = [int(Words(pa.array([w])).hashes()[0]) for w in words]
    out += [h >> 64 - quality.BUCKET_BITS for h in hashes]
    for a, b in zip(hashes, hashes[1:]):
        pair = int(quality._REPEAT) if a == b else int(mix(np.array([(a * int(quality._PAIR) + b) % 2**64], np.uint64))[0])
        out.append(pair >> 64 - quality.BUCKET_BITS)
    return out


ODD = ["ab  ab ab\tc", "", None, "x", "é Ü é é", "\U0001F600\U0001F600 ßé\nß", "日本語 日本語 文字", "a" * 500, " \t ", "ab"]


def test_features_against_brute_force():
    groups = quality.features(pa.array(ODD))
    for i, text in enumerate(ODD):
        got = sorted(int(v) for values, bounds in groups for v in values[bounds[i]:bounds[i + 1]])
        assert got == sorted(plain_features(text))


def test_score_against_a_plain_forward_pass():
    """Mean of the learned vectors, linear layer and softmax, one number at a time."""
    texts = [t for _, t, _ in corpus(40)]
    made = list(quality.shares_of(pa.array(texts)))
    weights, offset = quality.fit([b for b, _ in made], [s for _, s in made], np.array([q for *_, q in corpus(40)]))
    scores = quality.Model(weights, offset).score(pa.array([*texts, *ODD]))
    for text, score in zip([*texts, *ODD], scores):
        own = plain_features(text)
        logit = sum(float(weights[b]) for b in own) / max(1, len(own)) + offset
        odds = [1.0, math.exp(logit)]
        assert score == pytest.approx(odds[1] / sum(odds), abs=1e-6)
