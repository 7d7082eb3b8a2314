from collections import defaultdict
from hashlib import sha256

import pytest

from nearframe.llm.exact_dedup import copy_groups, drop_copies


def norm(text):
    return (text or "").encode().lower()


def brute(texts):
    groups = defaultdict(list)
    for doc_id, text in texts:
        groups[norm(text)].append(doc_id)
    return groups


@pytest.mark.parametrize("table_bytes", [1 << 20, 500, 1])
def test_groups_equal_brute_force(documents, texts, small_batches, table_bytes):
    got = copy_groups(documents, table_bytes=table_bytes).collect()
    groups = brute(texts)
    want = sorted(((doc_id, max((i for i in ids if i is not None), default=None), len(ids), sha256(t).hexdigest())
                   for t, ids in groups.items() for doc_id in ids), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("table_bytes", [1 << 20, 300])
def test_rows_that_stay(documents, texts, small_batches, table_bytes):
    got = drop_copies(documents, table_bytes=table_bytes)
    assert got.columns == documents.columns
    rows = got.collect()
    groups = brute(texts)
    assert len(rows) == len(groups)
    source = {(i, t) for i, t in texts}
    for r in rows:
        assert (r.doc_id, r.text) in source
        assert r.doc_id == max((i for i in groups[norm(r.text)] if i is not None), default=None)


def test_empty_table(documents):
    none = documents.limit(0)
    assert copy_groups(none).count() == 0 and drop_copies(none).count() == 0
