import shutil
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearframe.operators import cells as C
from nearframe.operators import embedding as E
from nearframe.operators import neighbours as N


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 8)) * 4
    rows = [(i, [float(v) for v in centers[i % 6] + rng.normal(size=8)], i % 2) for i in range(600)]
    # A third of all rows are copies that fall into one cell.
    rows += [(1000 + i, rows[0][1], 0) for i in range(300)] + [(5000, None, 1)]
    return spark.createDataFrame(rows, "id int, v array<float>, label int")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["item_id"]) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_exact_search_through_the_index_equals_full_search(spark, items, tmp_path, monkeypatch, metric):
    C.build_index(items, str(tmp_path / "ix"), cells=9, metric=metric, item_id="id", vector="v")
    index = C.open_index(spark, str(tmp_path / "ix"))
    q = items.where("id % 7 = 0").selectExpr("id as query_id", "v as embedding")
    want = rows(N.knn_join(q, items, 5, metric, item_id="id", item_vector="v"))
    assert rows(C.ann_search(index, q, 5, nprobe=1, exact=True, block_rows=64)) == want
    monkeypatch.setattr(C, "MATRIX_ENTRIES", 30)  # three rows at a time
    assert rows(C.ann_search(index, q, 5, nprobe=99)) == want


def test_recall_of_probed_cells(spark, items, tmp_path):
    index = C.build_index(items, str(tmp_path / "ix"), cells=9, item_id="id", vector="v")
    q = items.where("v is not null").selectExpr("id as query_id", "v as embedding")
    want = set(rows(N.knn_join(q, items, 5, item_id="id", item_vector="v")))
    got = set(rows(C.ann_search(index, q, 5, nprobe=2)))
    assert len(want & got) / len(want) >= 0.95


def test_immediate_and_deferred_ingest_hold_the_same_rows(spark, items, tmp_path):
    deferred = C.ingest(items, str(tmp_path / "d"), "deferred", cells=5, item_id="id", vector="v")
    C.train_index(items, str(tmp_path / "i"), cells=5, item_id="id", vector="v")
    trained = C.open_index(spark, str(tmp_path / "i"))
    for label in (0, 1, 0):  # a load that is repeated, under its name or another, doubles nothing
        C.ingest(items.where(f"label = {label}"), trained.path, "immediate", item_id="id", vector="v", trained=trained,
                 batch=None if label else "zero")

    def stored(ix):
        return sorted((r["item_id"], r["cell"], r["label"]) for r in ix.items(spark).collect())

    assert stored(trained) == stored(deferred) and len(stored(trained)) == 900
    C.ingest(items, str(tmp_path / "n"), "none", item_id="id", vector="v")
    assert spark.read.parquet(str(tmp_path / "n" / "items")).count() == 901
    with pytest.raises(ValueError):
        C.ingest(items, "x", "immediate", item_id="id", vector="v")
    with pytest.raises(ValueError):
        C.ingest(items, "x", "sometimes")


def test_every_vector_is_computed_once(spark, tmp_path):
    """One call of the encoder per input in every step that needs vectors."""
    made = tmp_path / "made"
    made.mkdir()

    def factory(_model):
        def encode(texts):
            (made / uuid.uuid4().hex).write_text(str(len(texts)))
            return np.array([[float(len(t)), float(t[0]), 1.0] for t in texts])
        return encode

    E.register_backend("counting", factory, {"three": 3})

    def counted(run):
        for f in made.iterdir():
            f.write_text("0")
        run().collect()
        return sum(int(f.read_text()) for f in made.iterdir())

    texts = spark.range(300).selectExpr("id as item_id", "cast((id * 7) % 1000 as string) as text").repartition(3)
    table = E.embed_column(texts, "text", "counting", "three")
    queries = table.selectExpr("item_id as query_id", "embedding")
    index = []

    def build():
        index.append(C.build_index(table, str(tmp_path / "ix"), cells=9))
        return spark.range(0)

    assert counted(build) == 300
    assert counted(lambda: C.ann_search(index[0], queries, 3, nprobe=2)) == 300
    assert counted(lambda: C.ann_search(index[0], queries, 3, nprobe=2, exact=True)) == 300
    assert counted(lambda: N.knn_join(queries, table, 3, strategy="blocks", width=3, block_rows=100)) == 600


def test_upsert_replaces_across_cells(spark, items, tmp_path):
    index = C.build_index(items, str(tmp_path / "ix"), cells=9, item_id="id", vector="v")
    moved = items.where("id % 5 = 0 and v is not null").withColumn("v", F.reverse("v"))
    for name in ("a", "a", "b"):
        C.upsert_index(index, moved, name, "id", "v")
    now = moved.unionByName(items.where("id % 5 <> 0"))
    q = items.where("id % 7 = 0").selectExpr("id as query_id", "v as embedding")
    assert index.items(spark).count() == 900
    assert rows(C.ann_search(index, q, 5, nprobe=1, exact=True)) == rows(N.knn_join(q, now, 5, item_id="id", item_vector="v"))


def test_a_batch_counts_once_its_statistics_are_written(spark, items, tmp_path):
    index = C.build_index(items.where("label = 0"), str(tmp_path / "ix"), cells=4, item_id="id", vector="v")
    before = index.items(spark).count()
    C.append_to_index(index, items.where("label = 1"), "id", "v", batch="later")
    assert index.items(spark).count() == 900
    shutil.rmtree(tmp_path / "ix" / "stats" / "batch=b-later")
    assert index.items(spark).count() == before


def test_all_rows_move_the_centroids(spark, items, monkeypatch):
    table = items.where("v is not null")
    monkeypatch.setattr(C, "TRAIN_PER_CELL", 20)
    centers = C.fit_centroids(table.withColumnRenamed("id", "item_id"), "v", 6)
    x = np.array([r["v"] for r in table.collect()])
    assert centers.shape == (6, 8)
    assert np.allclose(np.average(centers, axis=0, weights=np.bincount(
        np.linalg.norm(x[:, None] - centers[None], axis=2).argmin(1), minlength=6)), x.mean(0), atol=0.5)


def test_training_is_due_when_rows_have_doubled(spark, items, tmp_path):
    index = C.build_index(items, str(tmp_path / "ix"), cells=4, item_id="id", vector="v")
    assert not index.needs_training(spark)
    C.append_to_index(index, items.selectExpr("id + 10000 as id", "v", "label"), "id", "v")
    assert index.needs_training(spark)


def test_every_item_is_stored_once_in_its_nearest_cell(spark, items, tmp_path):
    index = C.build_index(items, str(tmp_path / "ix"), cells=7, item_id="id", vector="v")
    stored = index.items(spark).collect()
    assert sorted(r["item_id"] for r in stored) == sorted(r["id"] for r in items.where("v is not null").collect())
    for r in stored:
        gaps = np.linalg.norm(index.centroids - np.array(r["embedding"]), axis=1)
        assert gaps[r["cell"]] == pytest.approx(gaps.min(), abs=1e-6) and r["gap"] == pytest.approx(gaps.min(), abs=1e-6)
    cells = {r["cell"]: r for r in index.cells(spark).collect()}
    assert sum(c["rows"] for c in cells.values()) == len(stored)
    assert all(cells[r["cell"]]["radius"] >= r["gap"] for r in stored)


def test_exact_search_far_from_the_origin(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in 1e5 + rng.normal(size=4)]) for i in range(300)]
    items = spark.createDataFrame(rows, "id int, v array<double>")
    index = C.build_index(items, str(tmp_path / "ix"), cells=8, item_id="id", vector="v")
    q = items.selectExpr("id as query_id", "v as embedding")
    want = sorted((r["query_id"], r["rank"], r["item_id"]) for r in
                            N.knn_join(q, items, 4, item_id="id", item_vector="v").collect())
    got = sorted((r["query_id"], r["rank"], r["item_id"]) for r in C.ann_search(index, q, 4, nprobe=1, exact=True).collect())
    assert got == want
    x = np.array([v for _, v in rows])
    for i in (0, 7, 299):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(axis=1)), 9)
        assert [t for q_, _, t in want if q_ == i] == list(np.lexsort((np.arange(300), d))[:4])


def test_upkeep_bounds_batches_and_cells(spark, tmp_path):
    """Small upserts with merges and splits between them: bounded batches, cells and files, exact neighbours."""
    rng = np.random.default_rng(8)
    vectors = {i: [float(v) for v in rng.normal(size=4)] for i in range(120)}

    def frame(ids):
        return spark.createDataFrame([(i, vectors[i]) for i in ids], "item_id int, embedding array<double>")

    index = C.build_index(frame(range(120)), str(tmp_path / "ix"), cells=4)
    for n in range(14):
        # Old ids under new vectors and new ids, all in one corner, so that its cell outgrows the others.
        ids = [*range(n * 5, n * 5 + 5), *range(1000 + 20 * n, 1020 + 20 * n)]
        vectors |= {i: [float(v) for v in 3 + rng.normal(size=4) / 4] for i in ids}
        C.upsert_index(index, frame(ids), f"n{n}")
        if n % 3 == 2:
            index = C.maintain(index, spark, most_batches=5, most_rows=60)
            assert len(index.batches(spark)) <= 6
    index = C.maintain(C.open_index(spark, index.path), spark, most_batches=5, most_rows=60)
    sizes = [r["count"] for r in index.live(spark).groupBy("cell").count().collect()]
    assert max(sizes) <= 60 and len(index.retired) >= 3 and len(index.active) == 4 + len(index.retired)
    assert sorted((r.item_id, r.embedding) for r in index.items(spark).collect()) == sorted(vectors.items())
    q = frame(range(0, 120, 3)).withColumnRenamed("item_id", "query_id")
    want = rows(N.knn_join(q, frame(vectors), 5))
    for ix in (index, C.open_index(spark, index.path)):
        assert rows(C.ann_search(ix, q, 5, nprobe=2, exact=True)) == want
    # Every item lies in its nearest active cell or, beyond the neighbours of a split, within its radius.
    radius = {r["cell"]: r["radius"] for r in index.cells(spark).collect()}
    for r in index.items(spark).collect():
        gaps = np.linalg.norm(index.centroids - np.array(r.embedding), axis=1)
        assert gaps[r.cell] <= radius[r.cell] + 1e-9 and r.cell not in index.retired


def test_a_writer_that_missed_a_split(spark, items, tmp_path):
    old = C.build_index(items, str(tmp_path / "ix"), cells=3, item_id="id", vector="v")
    index = C.split_cells(old, spark, 150)
    assert index.retired and C.split_cells(index, spark, 10_000) is index
    late = items.where("v is not null").withColumn("id", F.col("id") + 10_000)
    C.upsert_index(old, late, "late", item_id="id", vector="v")
    q = items.where("id % 50 = 0 and v is not null").selectExpr("id as query_id", "v as embedding")
    want = rows(N.knn_join(q, items.unionByName(late), 5, item_id="id", item_vector="v"))
    assert rows(C.ann_search(C.open_index(spark, index.path), q, 5, nprobe=1, exact=True)) == want


def test_copies_are_not_split(spark, tmp_path):
    same = spark.range(300).selectExpr("id AS item_id", "array(1.0D, 2.0D) AS embedding")
    index = C.build_index(same, str(tmp_path / "ix"), cells=1)
    assert C.maintain(index, spark, most_rows=10) is index
