import numpy as np
import pyarrow as pa
import pytest

from nearframe.operators import partitioned as P
from nearframe.operators.neighbours import knn_join


def frame(spark, x, key):
    return spark.createDataFrame(pa.table({key: np.arange(len(x)), "vector": [list(map(float, v)) for v in x]})).repartition(3)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["item_id"], r["dist"]) for r in df.collect())


def full(q, x, k, metric):
    return rows(knn_join(q, x, k, metric, query_vector="vector", item_vector="vector", strategy="items"))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("partitions, block_rows", [(1, 1000), (12, 50), (40, 7)])
def test_equals_full_search(spark, metric, partitions, block_rows):
    pick = np.random.default_rng(partitions)
    centers = 5 * pick.normal(size=(10, 4))
    x = centers[pick.integers(0, 10, 500)] + pick.normal(size=(500, 4))
    x[100:260] = x[0]  # a third are copies
    x[480:485] = 0
    q = np.concatenate([centers[pick.integers(0, 10, 90)] + pick.normal(size=(90, 4)), np.zeros((2, 4)), x[:20]])
    q, x = frame(spark, q, "query_id"), frame(spark, x, "item_id")
    assert rows(P.partition_join(q, x, 5, metric, block_rows, partitions)) == full(q, x, 5, metric)


def test_items_are_copied_only_where_they_may_count(spark, monkeypatch):
    """Twenty far groups: bounds leave nearly one copy of an item, not one for each partition."""
    pick = np.random.default_rng(1)
    x = np.repeat(100 * pick.normal(size=(20, 3)), 60, axis=0) + pick.normal(size=(1200, 3))
    dealt = []
    real = P._numbers
    monkeypatch.setattr(P, "_numbers", lambda *a: dealt.append(real(*a)) or dealt[-1])
    q, x = frame(spark, x[::5] + 0.1, "query_id"), frame(spark, x, "item_id")
    got = P.partition_join(q, x, 5, partitions=20)
    assert rows(got) == full(q, x, 5, "l2")
    assert dealt[0].sum() < 3 * 1200


def test_few_items_and_empty_sides(spark):
    q, x = frame(spark, np.eye(3), "query_id"), frame(spark, np.eye(3)[:2] * 2, "item_id")
    assert rows(P.partition_join(q, x, 5, partitions=2)) == full(q, x, 5, "l2")
    for a, b in ((q.limit(0), x), (q, x.limit(0)), (q.limit(0), x.limit(0))):
        got = P.partition_join(a, b, 5)
        assert got.count() == 0 and got.columns == ["query_id", "item_id", "dist", "rank"]
