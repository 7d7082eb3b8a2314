import numpy as np
import pyarrow as pa
import pytest

from nearframe.operators import cells, tree
from nearframe.operators.neighbours import knn_join
from nearframe.operators.tree import build_tree, open_tree, tree_search


def rows(df):
    return sorted((r["query_id"], r["rank"], r["item_id"], r["dist"]) for r in df.collect())


@pytest.fixture(scope="module")
def items(spark):
    pick = np.random.default_rng(6)
    x = (pick.normal(size=(20, 6)) * 3)[pick.integers(0, 20, 900)] + pick.normal(size=(900, 6))
    x[300:600] = x[0]  # a third are copies
    frame = spark.createDataFrame(pa.table({"id": np.arange(900), "v": list(x), "label": np.arange(900) % 3}))
    return frame.unionByName(spark.createDataFrame([(9000, None, 1)], frame.schema))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_exact_search_equals_full_search(spark, items, tmp_path, metric):
    made = build_tree(items, f"{tmp_path}/tree", 5, 6, metric, "id", "v", block_rows=100)
    q = items.where("id % 17 = 0").selectExpr("id AS query_id", "v AS embedding")
    want = rows(knn_join(q, items, 5, metric, item_id="id", item_vector="v"))
    assert rows(tree_search(open_tree(spark, made.path), q, 5, 1, 2, exact=True, block_rows=40)) == want
    assert rows(tree_search(made, q, 5, 99, 999)) == want
    got = set(rows(tree_search(made, q, 5, 3, 8)))
    assert len(got & set(want)) / len(want) >= 0.9


def test_more_cells_than_could_be_sent(spark, items, tmp_path, monkeypatch):
    """A limit that fits a dozen centroids at a time: a flat index is refused, the tree has more cells than that."""
    limit = 12 * 8 * 6
    monkeypatch.setattr(cells, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(tree, "BROADCAST_BYTES", limit)
    with pytest.raises(ValueError):
        cells.build_index(items, f"{tmp_path}/flat", cells=40, item_id="id", vector="v")
    made = build_tree(items, f"{tmp_path}/tree", 50, 50, item_id="id", vector="v")
    assert len(made.coarse) == 12 and 8 * 6 * made.fine(spark).count() > 3 * limit
    q = items.where("id % 31 = 0").selectExpr("id AS query_id", "v AS embedding")
    assert rows(tree_search(made, q, 5, exact=True)) == rows(knn_join(q, items, 5, item_id="id", item_vector="v"))


def test_what_is_stored_and_odd_input(spark, items, tmp_path):
    made = build_tree(items, f"{tmp_path}/tree", item_id="id", vector="v")
    got = made.items(spark).collect()
    assert sorted((r.item_id, r.label, r.embedding) for r in got) == sorted(
        (r.id, r.label, r.v) for r in items.where("v IS NOT NULL").collect())
    fine = {(r.coarse, r.cell): r for r in made.fine(spark).collect()}
    for r in got:
        gap = np.linalg.norm(np.array(r.embedding) - np.array(fine[r.coarse, r.cell].center))
        assert gap <= fine[r.coarse, r.cell].radius + 1e-9
        assert np.linalg.norm(np.array(r.embedding) - made.coarse[r.coarse]) <= fine[r.coarse, r.cell].coarse_radius + 1e-9
    with pytest.raises(ValueError):
        build_tree(items.where("v IS NULL"), f"{tmp_path}/none", item_id="id", vector="v")
    one = build_tree(items.where("id = 5"), f"{tmp_path}/one", item_id="id", vector="v")
    q = items.where("id = 7").selectExpr("id AS query_id", "v AS embedding")
    assert [r.item_id for r in tree_search(one, q, 5, exact=True).collect()] == [5]
    assert tree_search(one, q.limit(0), 5, exact=True).count() == 0
