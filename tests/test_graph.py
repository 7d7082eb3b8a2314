import numpy as np
import pyarrow as pa
import pytest

from nearframe.operators.graph import _padded, _reached, build_graph, graph_search, layers_of, open_graph, walk
from nearframe.operators.neighbours import knn_join


def table(spark, x, ids=None):
    ids = ids if ids is not None else list(range(len(x)))
    return spark.createDataFrame(pa.table({"item_id": ids, "embedding": [list(map(float, v)) for v in x]})).repartition(4)


def recall(spark, x, queries, tmp_path, metric="l2", **options):
    items, q = table(spark, x), table(spark, queries).withColumnRenamed("item_id", "query_id")
    index = build_graph(items, f"{tmp_path}/graph", metric=metric, part_rows=options.pop("part_rows", 8192))
    near = graph_search(open_graph(spark, index.path), q, 5, **options).collect()
    full = knn_join(q, items, 5, metric=metric).collect()
    want = {(r.query_id, r.item_id): r.dist for r in full}
    got = {(r.query_id, r.item_id): r.dist for r in near}
    assert len(got) == len(near) and all(got[p] == want[p] for p in got if p in want)
    assert {r.query_id for r in near} == {r.query_id for r in full}
    return len(got.keys() & want.keys()) / len(want)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_recall(spark, tmp_path, metric):
    pick = np.random.default_rng(1)
    x = pick.normal(size=(2500, 24)) + 4 * pick.normal(size=(30, 24))[pick.integers(0, 30, 2500)]
    assert recall(spark, x, x[:600] + 0.1, tmp_path, metric, part_rows=700) >= 0.95


def test_far_clusters_and_few_probes(spark, tmp_path):
    """Groups so far apart that no chosen link leads from one to the other are still walked to."""
    pick = np.random.default_rng(2)
    x = 1e3 * np.arange(12)[:, None, None] + pick.normal(size=(12, 130, 6))
    assert recall(spark, x.reshape(-1, 6), x[:, :20].reshape(-1, 6), tmp_path, ef=20) == 1.0


def test_copies_are_one_node(spark, tmp_path):
    x = np.repeat(np.random.default_rng(3).normal(size=(40, 5)), 60, axis=0)
    items = table(spark, x)
    index = build_graph(items, f"{tmp_path}/graph")
    assert index.nodes(spark).count() == 40
    near = graph_search(index, items.withColumnRenamed("item_id", "query_id"), 5, block_rows=500)
    want = knn_join(items.withColumnRenamed("item_id", "query_id"), items, 5)
    assert sorted(map(str, near.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_a_stored_vector_finds_itself(metric):
    """Also a node that only a far one links to, which a narrow walk does not come by."""
    x = np.random.default_rng(5).normal(size=(400, 16))
    links = [[[(i + 1) % 399]] for i in range(399)] + [[[0]]]
    links[200][0].append(399)
    links[0].append([])
    graph = pa.table({"node": np.arange(400), "embedding": list(x), "links": links})
    for k, ef in ((1, 1), (3, 4)):
        r, c, dist = walk(graph, np.concatenate([x[[399, 7]], x[[399]] + 0.5]), k, ef, metric)
        first = c[np.searchsorted(r, [0, 1])]
        assert list(first) == [399, 7] and abs(dist[np.searchsorted(r, [0, 1])]).max() < 1e-9
        assert (np.bincount(r) == k).all()


def test_every_node_is_reached():
    pick = np.random.default_rng(4)
    for x in (pick.normal(size=(300, 3)), np.arange(200.0)[:, None] ** 3, np.concatenate([pick.normal(size=(90, 2)), pick.normal(size=(90, 2)) + 1e6])):
        for nodes, links in layers_of(x, pick.permutation(len(x)), 4, 8):
            entry = 0 if len(nodes) == 1 else None
            seen = np.zeros(len(nodes), bool)
            starts = [entry] if entry is not None else range(len(nodes))
            reach = max(len(_reached(_padded(links), np.array([s]), seen.copy())) for s in starts)
            assert reach == len(nodes)
            assert all(len(set(a)) == len(a) and i not in a for i, a in enumerate(links))


def test_small_odd_and_wrong_input(spark, tmp_path):
    one = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "item_id string, embedding array<double>")
    index = build_graph(one, f"{tmp_path}/one")
    near = graph_search(index, one.withColumnRenamed("item_id", "query_id"), 5).collect()
    assert [(r.query_id, r.item_id, r.dist, r.rank) for r in near] == [("a", "a", 0.0, 1)]
    assert graph_search(index, one.limit(0).withColumnRenamed("item_id", "query_id")).count() == 0
    with pytest.raises(ValueError):
        build_graph(one.where("embedding is null"), f"{tmp_path}/none")
    for options in ({"m": 1}, {"ef_construction": 4}, {"metric": "dot"}):
        with pytest.raises(ValueError):
            build_graph(one, f"{tmp_path}/wrong", **options)
