import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearframe.functions.subwords import Vocabulary, fitted, read_vocabulary, subword_counters, subword_ids
from nearframe.operators import embedding as E

TOKENS = ["[UNK]", "a", "b", "ab", "abc", "##a", "##b", "##ab", "##é", "é", "##abab", "\U0001F600", "c"]


def brute(word, tokens, inside="##"):
    at, out = 0, []
    while at < len(word):
        mark = inside if at else ""
        piece = next((word[at:end] for end in range(len(word), at, -1) if mark + word[at:end] in tokens), None)
        if piece is None:
            return [tokens.index("[UNK]")]
        out.append(tokens.index(mark + piece))
        at += len(piece)
    return out


@pytest.mark.parametrize("inside", ["##", ""])
def test_longest_match_equals_brute_force(inside):
    tokens = TOKENS if inside else [t for t in TOKENS if not t.startswith("##")]
    pick = random.Random(2)
    words = ["".join(pick.choice("ababcé\U0001F600x") for _ in range(pick.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(words[i:i + 7]) for i in range(0, 3000, 7)] + [None, "", " \n\t ", "AB\x0bÉ ", "ab" * 5000]
    got = Vocabulary(tokens, inside=inside).ids(pa.array(texts)).to_pylist()
    for text, ids in zip(texts, got):
        want = None if text is None else [i for w in text.lower().replace("\x0b", " ").split(" ") for w in w.split("\n") for w in w.split("\t")
                                          if w for i in brute(w, tokens, inside)]
        assert ids == want


def test_columns_masks_and_counters(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("\n".join(TOKENS), encoding="utf-8")
    cut = subword_ids(spark, read_vocabulary(str(tmp_path / "vocab.txt")))
    df = spark.createDataFrame([(1, "abab ab c"), (2, None), (3, ""), (4, "x")], "id int, text string").withColumn("ids", cut(F.col("text")))
    rows = {r.id: (r.ids, r.f and (r.f.ids, r.f.mask), r.g and r.g.ids) for r in
            df.select("*", fitted(F.col("ids"), 3, -1).alias("f"), fitted(F.col("ids"), 2, side="left").alias("g")).collect()}
    assert rows == {1: ([3, 7, 3, 12], ([3, 7, 3], [1, 1, 1]), [3, 12]), 2: (None, None, None),
                    3: ([], ([-1] * 3, [0] * 3), [0, 0]), 4: ([0], ([0, -1, -1], [1, 0, 0]), [0, 0])}
    assert tuple(subword_counters(df, "ids").first()) == (3, 5)
    assert subword_counters(df.limit(0), "ids").first()["tokens"] == 0


@pytest.mark.parametrize("tokens", [["a"], ["[UNK]", "a", "a"]])
def test_wrong_vocabularies(tokens):
    with pytest.raises(ValueError):
        Vocabulary(tokens)


def test_packs_keep_to_the_budget():
    sizes = np.array([3, 50, 0, 7, 7, 1, 200, 12])
    parts = E.packs(sizes, 24)
    assert sorted(np.concatenate(parts)) == list(range(8))
    assert all(len(p) == 1 or len(p) * sizes[p].max() <= 24 for p in parts)
    assert E.packs(np.zeros(0, int), 5) == []


def test_budget_gives_the_same_vectors_with_less_padding(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def factory(_model):
        import os
        import uuid

        def encode(texts):
            longest = max(len(t.split()) for t in texts)
            (log / f"{os.getpid()}-{uuid.uuid4().hex}").write_text(str(longest * len(texts)))
            return np.array([[len(t), len(t.split())] for t in texts], float)
        return encode

    E.register_backend("padded", factory, {"two": 2})
    pick = random.Random(1)
    rows = [(i, "w " * (pick.choice([1, 2, 3, 90]))) for i in range(400)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)

    def run(**options):
        for f in log.iterdir():
            f.unlink()
        got = {r.id: r.embedding for r in E.embed_column(df, "text", "padded", "two", **options).collect()}
        return got, sum(int(f.read_text()) for f in log.iterdir())

    plain, padded = run(batch_size=32)
    packed, used = run(token_budget=960)
    assert packed == plain and used < padded / 2
    with pytest.raises(ValueError):
        E.embedding_function("padded", "two", batch_size=3, token_budget=5)


def test_texts_are_cut_in_pieces_of_bounded_bytes(spark):
    """A batch of 10,000 rows may hold any amount of text."""
    from nearframe.functions import subwords
    from nearframe.operators import embedding

    rows = [(i, "ab ba " * 20_000 if i % 3 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    cut = subwords.subword_ids(spark, Vocabulary(["[UNK]", "a", "b", "##a", "##b"]))
    got = {r.id: r.n for r in df.select("id", cut(F.col("text")).alias("ids")).selectExpr("id", "size(ids) AS n").collect()}
    assert {i: n for i, n in got.items() if i % 3} == {i: 80_000 for i in range(150) if i % 3}
    parts = list(cut.func(iter([pa.array([text for _, text in rows])])))
    assert sum(map(len, parts)) == 150 and max(map(len, parts)) < 40

    def factory(_model):
        def encode(texts):
            if sum(map(len, texts)) > 5_000_000:
                raise ValueError("too much text at once")
            return np.array([[len(t), 1] for t in texts], float)
        return encode

    embedding.register_backend("bounded", factory, {"two": 2})
    for options in ({}, {"token_budget": 10**9}):
        got = {r.id: r.embedding for r in embedding.embed_column(df, "text", "bounded", "two", **options).collect()}
        assert got == {i: ([120_000.0, 1.0] if i % 3 else None) for i in range(150)}
