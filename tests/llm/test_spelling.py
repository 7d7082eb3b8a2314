import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nearframe.llm import spelling
from nearframe.llm.spelling import drop_point, last_forms, letter_runs, near_words, variants, vocabulary


def near(a, b):
    """One inserted, deleted or replaced code point, by trying them all."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio):
    out = {}
    for w, n in counts.items():
        close = [o for o in counts if near(w, o)]
        best = min(close, key=lambda o: (-counts[o], o), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [form, None, n, len(close), counts[form] if form else None]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w][1] = root
    return sorted((w, *v) for w, v in out.items())


@pytest.fixture(scope="module")
def counts():
    pick, made = random.Random(4), {}
    for i in range(120):
        word = "".join(pick.choice("abcéÿ\U0001F600z") for _ in range(pick.randint(1, 9)))
        made[word] = pick.choice([5, 6, 25, 30, 31, 700, 20_000])
        for _ in range(3):
            at = pick.randrange(len(word))
            other = pick.choice([word[:at] + word[at + 1:], word[:at] + "q" + word[at:], word[:at] + "é" + word[at + 1:]])
            made[other] = pick.choice([5, 6, 25, 150])
    long = "abcd" * 2000
    made |= {long: 500, long[:777] + "x" + long[778:]: 6, long + "a": 6, "aaaa": 9, "aaaaa": 60, "aaaaaa": 9}
    return {w: n for w, n in made.items() if w}


@pytest.mark.parametrize("rows, points, tile", [(1024, 1 << 20, 256), (3, 1 << 20, 2), (1, 1, 1), (1024, 40, 7)])
def test_equal_to_brute_force(spark, counts, small_batches, monkeypatch, rows, points, tile):
    for name, value in (("BLOCK_ROWS", rows), ("BLOCK_POINTS", points), ("TILE", tile), ("PIECE", 50)):
        monkeypatch.setattr(spelling, name, value)
    vocab = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    found = near_words(vocab).collect()
    assert len(found) == len({(r.word, r.other) for r in found})
    assert all(r.other_n == counts[r.other] for r in found)
    assert {(r.word, r.other) for r in found} == {(a, b) for a in counts for b in counts if near(a, b)}


@pytest.mark.parametrize("ratio", [2, 5])
def test_forms_and_roots(spark, counts, ratio):
    vocab = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = variants(vocab, ratio).collect()
    assert sorted(tuple(r) for r in got) == brute(counts, ratio)


def test_long_chain_and_ties(spark):
    # Every word's form is the next, up to nine links.
    chain = {"a" * i + "b" * (20 - i): 3 * 5**i for i in range(10)}
    got = {r.word: r for r in variants(spark.createDataFrame(list(chain.items()), "word string, n bigint")).collect()}
    assert {r.root for r in got.values()} == {"a" * 9 + "b" * 11}
    tied = {"wordxa": 5, "wordxb": 40, "wordxé": 40, "wordx": 40}
    got = {r.word: r.form for r in variants(spark.createDataFrame(list(tied.items()), "word string, n bigint")).collect()}
    assert got == {"wordxa": "wordx", "wordxb": None, "wordxé": None, "wordx": None}
    with pytest.raises(ValueError):
        variants(spark.createDataFrame([], "word string, n bigint"), 1)


def test_words_of_texts(spark, documents, texts):
    words = letter_runs(documents).select(drop_point(F.col("doc_id"), F.col("word"), 7).alias("word"))
    want = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 7 == 0 else run] += 1
    got = {r.word: r.n for r in vocabulary(words, 4, 3).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 4 and n >= 3} and got


def test_empty_tables(spark, documents):
    assert variants(vocabulary(letter_runs(documents.limit(0)))).count() == 0
    assert last_forms(spark.createDataFrame([], "word string, form string"), 9).count() == 0


def test_no_task_takes_more_than_two_blocks(spark, monkeypatch):
    """A group of many words with one outer part is cut into block pairs."""
    monkeypatch.setattr(spelling, "BLOCK_ROWS", 16)
    rows = spark.range(400).selectExpr("concat('same', lpad(hex(id), 4, '0'), 'tail') word", "id n")
    units = spelling._grouped(rows).groupBy("unit").count().agg(F.max("count")).first()[0]
    assert units <= 4 * 16
