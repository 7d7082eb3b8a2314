import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from nearframe.operators import neighbours as N
from nearframe.operators import partitioned


def brute(q, x, ids, k, metric):
    out = []
    for i, a in enumerate(q):
        rows = []
        for b, key in zip(x, ids):
            if metric == "l2":
                d = float(np.sqrt(((a - b) ** 2).sum()))
            else:
                n = float(np.linalg.norm(a) * np.linalg.norm(b))
                d = 1.0 - (float(a @ b) / n if n else 0.0)
            rows.append((round(d, 9) + 0.0, key))
        out += [(i, key, d) for d, key in sorted(rows)[:k]]
    return out


def kernel(q, x, ids, k, metric):
    r, c, d = N.block_top_k(q, x, np.asarray(ids), k, metric)
    return [(int(a), ids[b], float(e)) for a, b, e in zip(r, c, d)]


def same(a, b):
    assert [(x[0], x[1]) for x in a] == [(x[0], x[1]) for x in b]
    assert np.allclose([x[2] for x in a], [x[2] for x in b], atol=2e-9)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.integers(0, 2**32 - 1), st.integers(1, 12), st.integers(1, 40), st.integers(1, 7),
       st.sampled_from(["l2", "cosine"]), st.booleans())
def test_block_kernel_equals_brute_force(seed, nq, nx, k, metric, coarse):
    rng = np.random.default_rng(seed)
    draw = (lambda n: rng.integers(-1, 2, (n, 3)).astype(float)) if coarse else (lambda n: rng.normal(size=(n, 3)) * 1e3)
    q, x = draw(nq), draw(nx)
    ids = [int(i) for i in rng.permutation(nx)]
    same(kernel(q, x, ids, k, metric), brute(q, x, ids, k, metric))


def test_many_copies_are_thinned_without_loss():
    x = np.concatenate([np.zeros((5000, 4)), np.eye(4)])
    ids = list(range(5004))[::-1]
    assert kernel(np.zeros((2, 4)), x, ids, 3, "l2") == [(i, j, 0.0) for i in range(2) for j in (4, 5, 6)]


def test_small_matrices_are_cut_in_steps(monkeypatch):
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(50, 8)), rng.normal(size=(60, 8))
    want = kernel(q, x, list(range(60)), 5, "l2")
    monkeypatch.setattr(N, "MATRIX_ENTRIES", 100)
    assert kernel(q, x, list(range(60)), 5, "l2") == want


def test_widths_have_to_match():
    with pytest.raises(ValueError, match="width"):
        N.block_top_k(np.zeros((1, 2)), np.zeros((1, 3)), np.array([1]), 1, "l2")


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(3)
    q = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(40)]
    x = [(f"n{i:03d}", [float(v) for v in rng.normal(size=6)]) for i in range(150)]
    # A third of the items are copies of one vector; one item and one query have none.
    x += [(f"c{i:03d}", x[0][1]) for i in range(75)] + [("null", None)]
    q += [(100, None), (101, [0.0] * 6)]
    return (spark.createDataFrame(q, "query_id int, embedding array<float>"),
            spark.createDataFrame(x, "item_id string, embedding array<float>"))


def rows(df):
    return sorted((r["query_id"], r["rank"], r["item_id"], round(r["dist"], 7)) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_all_strategies_agree_with_brute_force(sides, metric):
    q, x = sides
    qs = [r for r in q.collect() if r["embedding"]]
    xs = [r for r in x.collect() if r["embedding"]]
    want = brute(np.array([r["embedding"] for r in qs]), np.array([r["embedding"] for r in xs]),
                 [r["item_id"] for r in xs], 5, metric)
    want = sorted((qs[i]["query_id"], n % 5 + 1, key, round(d, 7)) for n, (i, key, d) in enumerate(want))
    for options in ({"strategy": "items"}, {"strategy": "queries"}, {"strategy": "blocks", "block_rows": 16}, {}):
        assert rows(N.knn_join(q, x, 5, metric, **options)) == want


def test_choice_of_strategy_follows_the_size(sides, monkeypatch):
    q, x = sides
    chosen = []
    for module, name in ((N, "_with_broadcast_items"), (N, "_with_broadcast_queries"), (partitioned, "partition_join")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, _n=name, _r=real: chosen.append(_n) or _r(*a))
    want = rows(N.knn_join(q, x, 3))
    for limit in (112 * 60, 112 * 10):
        monkeypatch.setattr(N, "BROADCAST_BYTES", limit)
        assert rows(N.knn_join(q, x, 3)) == want
    assert chosen == ["_with_broadcast_items", "_with_broadcast_queries", "partition_join"]


def test_a_strategy_by_name_is_held_to_the_limit(sides, monkeypatch):
    q, x = sides
    monkeypatch.setattr(N, "BROADCAST_BYTES", 112 * 10)
    for strategy in ("items", "queries"):
        with pytest.raises(ValueError, match="too many"):
            N.knn_join(q, x, 3, strategy=strategy)


def test_fewer_items_than_k_and_none(sides, spark):
    q, x = sides
    few = x.where("item_id < 'c003'")
    assert {r["query_id"]: r["rank"] for r in N.knn_join(q, few, 5).collect()}.keys() == set(range(40)) | {101}
    assert N.knn_join(q, few, 5).count() == 41 * 3
    for strategy in ("items", "queries", "blocks"):
        assert N.knn_join(q, x.where("false"), 5, strategy=strategy).count() == 0


def test_l2_and_cosine_rank_long_vectors_differently(spark):
    x = spark.createDataFrame([(1, [10.0, 0.0]), (2, [0.6, 0.8])], "item_id int, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    first = {m: N.knn_join(q, x, 1, m).first()["item_id"] for m in ("l2", "cosine")}
    assert first == {"l2": 2, "cosine": 1}


def test_single_vector(sides):
    q, x = sides
    vector = q.first()["embedding"]
    want = [(r["item_id"], r["dist"]) for r in N.knn_join(q, x, 5).where("query_id = 0").orderBy("rank").collect()]
    assert [(r["item_id"], r["dist"]) for r in N.knn_single(x, vector, 5).collect()] == want


def test_a_wrong_width_is_refused(sides):
    q, x = sides
    assert rows(N.knn_join(q, x, 2, width=6)) == rows(N.knn_join(q, x, 2))
    with pytest.raises(Exception, match="expected 5 values, found 6"):
        N.knn_join(q, x, 2, width=5).collect()
