import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearframe.llm import lm_score
from nearframe.llm.lm_score import DEPTH, MARK, log_gamma, score_texts


class Tree:
    """Context-tree weighting one decision at a time, with plain dictionaries."""

    def __init__(self, texts):
        self.counts = {}
        for text in texts:
            for context, node, bit in self.decisions(text):
                for d in range(DEPTH + 1):
                    self.counts.setdefault((context[:d], node), [0, 0])[bit] += 1
        self.children = {}
        for context, node in self.counts:
            if context:
                self.children.setdefault((context[:-1], node), []).append((context, node))
        self.memo = {}

    @staticmethod
    def decisions(text):
        data = bytes([MARK] * DEPTH) + text.lower() + bytes([MARK])
        for i in range(DEPTH, len(data)):
            context, node = data[i - DEPTH:i][::-1], 1
            for j in range(7, -1, -1):
                bit = data[i] >> j & 1
                yield context, node, bit
                node = node * 2 + bit

    def block(self, key):
        a, b = self.counts[key]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, key):
        if key not in self.memo:
            own = self.block(key)
            if len(key[0]) < DEPTH:
                own = np.logaddexp(own, sum(map(self.weighted, self.children[key]))) - math.log(2)
            self.memo[key] = own
        return self.memo[key]

    def share(self, context, node, bit, d=0):
        key = context[:d], node
        if key not in self.counts:
            return None
        own = (self.counts[key][bit] + .5) / (sum(self.counts[key]) + 1)
        deeper = self.share(context, node, bit, d + 1) if d < DEPTH else None
        if deeper is None:
            return own
        weight = math.exp(self.block(key) - self.weighted(key)) / 2
        return weight * own + (1 - weight) * deeper

    def score(self, text):
        return sum(math.log10(self.share(*d) or .5) for d in self.decisions(text))


def base(texts, train):
    def tokens(t):
        return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]
    counts = {}
    for (_, t), own in zip(texts, train):
        for w in tokens(t) if own else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    return n, [(len(tokens(t)), sum(counts.get(w, 0) > 0 for w in tokens(t)),
                sum(math.log10((counts.get(w, 0) + .1) / (n + .1 * (v + 1))) for w in tokens(t))) for _, t in texts]


def test_equal_to_brute_force(spark, documents, texts, small_batches):
    short = [(i, t) for i, t in texts if len(t or "") < 2000]
    docs = documents.where("coalesce(length(text), 0) < 2000")
    train = [i is not None and i % 3 != 0 for i, _ in short]
    got = score_texts(docs, F.col("doc_id") % 3 != 0).collect()
    tree = Tree([(t or "").encode() for (_, t), own in zip(short, train) if own])
    total, plain = base(short, train)
    want = [(i, own, *p[:2], round(p[2], 6), round(tree.score((t or "").encode()), 3))
            for (i, t), own, p in zip(short, train, plain)]
    mine = [(r.doc_id, r.train, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in got]
    assert {r.train_tokens for r in got} == {total}
    assert len(mine) == len(want)
    for a, b in zip(sorted(mine, key=repr), sorted(want, key=repr)):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=2e-3)


def test_probabilities_of_all_bytes_sum_to_one(spark):
    docs = spark.createDataFrame([(0, "abab cab"), (1, "abba")] + [(10 + i, "ab" + chr(i)) for i in range(1, 65)],
                                 "doc_id long, text string")
    rows = score_texts(docs, F.col("doc_id") < 2).select("score").collect()
    assert all(r.score < 0 for r in rows)
    tree = Tree([b"abab cab", b"abba"])
    context = b"ba" + bytes([MARK] * (DEPTH - 2))
    shares = []
    for byte in range(256):
        p, node = 1.0, 1
        for j in range(7, -1, -1):
            bit = byte >> j & 1
            p *= tree.share(context, node, bit) or .5
            node = node * 2 + bit
        shares.append(p)
    assert sum(shares) == pytest.approx(1)


def test_without_training_and_empty(spark, documents):
    rows = score_texts(documents, F.lit(False)).collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r.base_score == pytest.approx(0, abs=1e-6) and r.n_known == 0 and r.train_tokens == 0
    bits = {round(r.bits_per_byte, 3) for r in rows if r.doc_id == 408}
    assert bits == {8.0}
    assert score_texts(documents.limit(0), F.lit(True)).count() == 0


def test_log_gamma_and_search_without_tables(monkeypatch):
    x = np.array([0.5, 1.0, 1.5, 7.25, 1e3 + 0.5, 1e7])
    assert log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)
    code = np.unique(lm_score.grams(np.frombuffer(b"\xff" * 5 + b"some text here\xff", np.uint8)))
    text = np.frombuffer(b"\xff" * 5 + b"some text here\xff", np.uint8)
    direct = lm_score._Lookup(code, np.arange(len(code)) + 0.5).get(text)
    monkeypatch.setattr(lm_score, "TABLE_SIZE", 10)
    search = lm_score._Lookup(code, np.arange(len(code)) + 0.5).get(text)
    assert np.array_equal(direct, search)
