import re
from collections import defaultdict

import pytest

from nearframe.llm.line_dedup import HOT_PER_PARTITION, drop_lines, keep_bitmaps
from made_texts import prose

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key(line):
    return line.strip(" \t\n\x0b\f\r").translate(str.maketrans(UPPER, LOWER))


def brute(rows, min_docs, keep):
    """(doc_id, lines, lines gone, kept text) of every row; equal rows never settle each other's first lines."""
    lines = [(t or "").split("\n") for _, t in rows]
    found = defaultdict(set)
    for n, own in enumerate(lines):
        for line in own:
            found[key(line)].add(n)
    first, out = {}, []
    for n, own in enumerate(lines):
        for i, line in enumerate(own):
            first.setdefault(key(line), []).append((rows[n][0] is None, rows[n][0] or 0, n, i))
    for n, own in enumerate(lines):
        kept = []
        for i, line in enumerate(own):
            k = key(line)
            least = min(first[k])
            goes = k != "" and len(found[k]) >= min_docs
            if keep == "first" and (rows[n][0] is None, rows[n][0] or 0, i) == (least[0], least[1], least[3]):
                goes = False
            if not goes:
                kept.append(line)
        out.append((rows[n][0], len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def lined():
    """Lines shared by one to many documents, with ids in common only where texts are equal."""
    shared = [prose(i, 5) for i in range(80)]
    rows = []
    for n in range(60):
        own = [prose(1000 + n, 4)] + [f" \t{s.upper() if n % 2 else s}\r" for i, s in enumerate(shared) if n % (1 + i % 13) == 0]
        rows.append((n, "\n".join(own * (1 + n % 2))))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, " \n\t\n"), (104, shared[0] + "\n"), (105, "É\né\n" + shared[0])]
    rows += [(106 + i, "É") for i in range(9)] + [(130, "\n".join(shared * 40)), (131, "x" * 60_000 + "\n" + shared[0])]
    rows += [(200, shared[2])] * 3 + [(None, shared[3] + "\nalone")]
    return rows


@pytest.mark.parametrize("min_docs, keep", [(10, "none"), (2, "none"), (1, "none"), (10, "first"), (2, "first")])
def test_equal_to_brute_force(spark, lined, min_docs, keep):
    docs = spark.createDataFrame(lined, "doc_id long, text string").repartition(5)
    got = drop_lines(docs, min_docs, keep).collect()
    assert len({key(l) for _, t in lined for l in (t or "").split("\n")}) > 4 * HOT_PER_PARTITION
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=repr) == brute(lined, min_docs, keep)
    for r in got:
        assert sum(64 - bin(w.bits & (2**64 - 1)).count("1") for w in r.keep) == r.n_dropped
        assert [w.word for w in r.keep] == sorted({w.word for w in r.keep}) and all(w.bits != -1 for w in r.keep)


@pytest.mark.parametrize("hot", [0, 1, 100])
def test_hot_lines_do_not_change_the_result(spark, lined, monkeypatch, hot):
    monkeypatch.setattr("nearframe.llm.line_dedup.HOT_PER_PARTITION", hot)
    docs = spark.createDataFrame(lined, "doc_id long, text string").repartition(3)
    got = drop_lines(docs, 3, "first").collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=repr) == brute(lined, 3, "first")


def test_a_hot_line_is_spread(spark):
    """A line in every document is dealt over all tasks behind the shuffle."""
    rows = spark.range(4000).selectExpr("id doc_id", "concat('the same line\n', hex(xxhash64(id))) text")
    got = drop_lines(rows, 10)
    assert {(r.n_dropped, "\n" in r.kept_text) for r in got.collect()} == {(1, False)}
    assert keep_bitmaps(rows, 10).count() == 4000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and not re.search("Cartesian|NestedLoop", plan)


def test_clashing_names_empty_table_and_bad_option(spark, documents):
    clash = documents.withColumnRenamed("row", "keep").withColumnRenamed("score", "kept_text").withColumnRenamed("kept", "t")
    got = drop_lines(clash, 2)
    assert got.columns == [*clash.columns, "n_lines", "n_dropped", "keep_", "kept_text_"]
    assert got.count() == documents.count()
    assert drop_lines(documents.limit(0)).count() == 0
    with pytest.raises(ValueError):
        drop_lines(documents, keep="last")
