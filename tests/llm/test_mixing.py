import hashlib
import re
from collections import defaultdict

import pytest

from nearframe.llm.mixing import mix


def targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight, cut off and shared again until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in out]
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = [s for s in open_ if share[s] > most * sizes[s]]
        if not full:
            return {**share, **out}
        out |= {s: most * sizes[s] for s in full}


def u(doc_id, seed=20):
    digest = hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return (int(digest[:13], 16) + 0.5) / 2**52


def words(text):
    return len(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))


def test_targets_and_copies(spark, documents):
    rows = mix(documents).collect()
    again = mix(documents.repartition(7)).collect()
    assert sorted((r.row, r.copies) for r in rows) == sorted((r.row, r.copies) for r in again)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == words(r.text) and 0 <= r.copies <= 3
        sizes[r.source] += r.size
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    want = targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1


def test_cut_off_and_order_of_ranks(spark):
    rows = [(i, "w " * (1 + i % 5), "abc"[min(2, i % 13)]) for i in range(400)] + [(1000, "w " * 30, None), (1001, None, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
    want = targets(sizes)
    for s in sizes:
        own = sorted((r for r in got if r.source == s), key=lambda r: u(r.doc_id))
        assert own[0].target == pytest.approx(want[s])
        # More copies go to the rows that rank first, none is skipped.
        copies = [r.copies for r in own]
        assert copies == sorted(copies, reverse=True) and max(copies) - min(copies) <= 1
        if want[s] == 3 * sizes[s]:
            assert set(copies) == {3} or sizes[s] == 0


def test_preference_clash_and_empty(spark, documents):
    rows = [(i, "w w", "a", float(1 + 9 * (i % 2)), 1, 2, 3, 4) for i in range(300)] + [(i, "w", "b", 1.0, 1, 2, 3, 4) for i in range(300, 320)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, want double, size int, target int, copies int, source_size int")
    got = mix(docs, weight="want")
    assert got.columns == [*docs.columns, "size_", "source_size_", "target_", "copies_"]
    found = [r for r in got.collect() if r.source == "a"]
    likes = [sum(r.copies_ for r in found if r.want == w) for w in (1.0, 10.0)]
    assert likes[1] > 3 * likes[0] and abs(sum(r.copies_ for r in found) * 2 - found[0].target_) <= 4
    assert mix(documents.limit(0)).count() == 0
    assert {r.copies for r in mix(documents.where("text is null")).collect()} == {0}
    plan = mix(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
