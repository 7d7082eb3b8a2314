import re

import pytest

from nearframe.llm.components import components
from nearframe.llm.near_dedup import chunk_count, drop_near_copies, near_groups


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(texts, n, percent):
    """Component of every row, by comparing all pairs of sets."""
    sets = [shingles(t, n) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(texts):
        ids.setdefault(find(i), []).append(doc_id)
    least = {k: min((v for v in vs if v is not None), default=None) for k, vs in ids.items()}
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(texts)), key=repr), len(ids)


@pytest.mark.parametrize("size, percent, crowd, block", [(3, 85, 32, 256), (3, 85, 2, 3), (5, 80, 2, 256), (3, 75, 4, 2)])
def test_components_equal_brute_force(documents, texts, small_batches, size, percent, crowd, block):
    got = near_groups(documents, size, percent, crowd=crowd, block=block).collect()
    want, groups = brute(texts, size, percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.component_id for r in kept)


def test_rows_that_stay(documents, texts):
    got = drop_near_copies(documents)
    assert got.columns == documents.columns
    rows = [(r.doc_id, r.text) for r in got.collect()]
    # Rows that repeat id and text stay together: (3, the text of 3) is there three times.
    _, groups = brute(texts, 5, 80)
    assert len(set(rows)) <= groups and rows.count((3, texts[3][1])) == 3
    assert not {i for i, _ in rows} & set(range(200, 214)) - {5}
    assert set(range(300, 308)) <= {i for i, _ in rows}


def test_empty_tables(documents):
    assert near_groups(documents.limit(0)).count() == 0
    assert near_groups(documents.where("text is null")).count() == 3
    assert components(documents.sparkSession.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (9, 8)]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_more_chunks_for_lower_similarity():
    assert chunk_count(0.9) < chunk_count(0.85) < chunk_count(0.8)
    with pytest.raises(ValueError):
        chunk_count(0.5)
