import re

import pytest

from nearframe.llm.decontaminate import drop_contaminated, find_items
from made_texts import prose

ITEMS = [(1, prose(99, 40).upper()), (2, prose(3, 20)), (3, "one two"), (4, "y y y"), (5, None), (6, ""), (7, prose(7000, 300)),
         (8, prose(99, 40)), (9, prose(99, 20) + " " + prose(12345, 3)), (10, prose(31337, 30)), (None, prose(4, 25)), (11, "x" * 50_000)]


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def brute(texts, size, threshold):
    out = []
    for item_id, item in ITEMS:
        own = words(item)
        if not own:
            continue
        n = min(size, len(own))
        runs = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)}
        for doc_id, text in texts:
            mine = words(text)
            k = len(runs & {tuple(mine[i:i + n]) for i in range(len(mine) - n + 1)})
            if k and k >= threshold * len(runs) - 1e-9:
                out.append((doc_id, item_id, len(runs), k))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size, threshold", [(5, 0.8), (5, 0.3), (3, 1.0)])
def test_equal_to_brute_force(spark, documents, texts, small_batches, size, threshold):
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, doc_id int")
    want = brute(texts, size, threshold)
    got = find_items(documents, items, size, threshold).collect()
    assert want and sorted(((r.doc_id, r.item_id, r.item_shingles, r.found) for r in got), key=repr) == want
    kept = drop_contaminated(documents, items, size, threshold)
    dirty = {repr(d) for d, *_ in want}
    rows = [r.doc_id for r in kept.collect()]
    # Ids that stand for several texts may be dirty in one row only.
    single = {repr(i) for i, _ in texts if [j for j, _ in texts].count(i) == 1}
    assert kept.columns == documents.columns
    assert {repr(i) for i in rows} & single == single - dirty


def test_many_blocks_and_empty_tables(spark, documents, texts, monkeypatch):
    from nearframe.llm import decontaminate
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20_000)
    got = find_items(documents, items).collect()
    assert sorted(((r.doc_id, r.item_id, r.item_shingles, r.found) for r in got), key=repr) == brute(texts, 5, 0.8)
    assert find_items(documents.limit(0), items).count() == 0
    assert find_items(documents, items.limit(0)).count() == 0
    assert drop_contaminated(documents, items.limit(0)).count() == documents.count()


def test_blocks_do_not_pile_up(spark, documents, texts, small_batches, monkeypatch):
    """With many blocks no task and no plan holds more than one of them."""
    from nearframe.llm import decontaminate
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = sorted(drop_contaminated(documents, items).collect(), key=repr)
    assert 0 < len(whole) < len(texts)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10_000)
    pieces = drop_contaminated(documents, items)
    assert pieces.columns == documents.columns and sorted(pieces.collect(), key=repr) == whole
    for df in (pieces, find_items(documents, items)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 1
