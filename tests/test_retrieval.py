import pytest
from pyspark.sql import functions as F

from nearframe.operators import retrieval as R
from nearframe.operators.neighbours import knn_join


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


ITEM = "item_id int, embedding array<double>, label boolean"
QUERY = "query_id int, embedding array<double>"


def test_vote_needs_three_of_five_and_keeps_lonely_queries(spark):
    items = frame(spark, [(i, [float(i)], i in (1, 2, 3)) for i in range(10)], ITEM)
    queries = frame(spark, [(1, [2.0]), (2, [8.0]), (3, None)], QUERY)
    out = {r["query_id"]: (r["votes"], r["predicted"]) for r in R.knn_vote(queries, items).collect()}
    assert out == {1: (3, True), 2: (0, False), 3: (0, False)}


def test_vote_with_few_or_no_items(spark):
    queries = frame(spark, [(1, [0.0])], QUERY)
    two = frame(spark, [(1, [0.0], True), (2, [1.0], True)], ITEM)
    assert R.knn_vote(queries, two).first()["predicted"] is False
    assert R.knn_vote(queries, two.where("false")).collect()[0].asDict() == {
        "query_id": 1, "votes": 0, "predicted": False}


def test_equal_distances_go_to_the_smaller_id(spark):
    items = frame(spark, [(i, [1.0], True) for i in (9, 4, 7, 2)], ITEM)
    near = knn_join(frame(spark, [(1, [0.0])], QUERY), items, 2)
    assert [r["item_id"] for r in near.orderBy("rank").collect()] == [2, 4]


@pytest.fixture(scope="module")
def shop(spark):
    near = frame(spark, [(1, 10), (1, 11), (2, 10), (2, 12)], "query_id int, item_id int")
    purchases = frame(spark, [(10, 1), (10, 1), (10, 2), (11, 3), (12, 3), (99, 4)], "customer_id int, product_id int")
    products = frame(spark, [(1, "a", "X", 5.0), (2, "b", "X", 9.0), (3, "c", "Y", 1.0), (4, "d", "X", 1.0)],
                     "product_id int, name string, category string, price double")
    reviews = frame(spark, [(1, 4), (1, 5), (2, 3), (3, 5), (4, 5)], "product_id int, rating int")
    return near, purchases, products, reviews


def test_purchases_distinct_over_the_batch_and_per_query(shop):
    near, purchases, products, reviews = shop
    out = R.knn_purchases(near, purchases, products, reviews)
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (3, "c")]
    out = R.knn_purchases(near, purchases, products, reviews, per_query=True)
    assert sorted(map(tuple, out.collect())) == [(1, 1, "a"), (1, 3, "c"), (2, 1, "a"), (2, 3, "c")]


def test_hybrid_filter_includes_both_bounds(shop):
    near, purchases, products, _ = shop
    out = R.knn_hybrid(near, purchases, products, "X", 5.0, 9.0)
    assert sorted(r["product_id"] for r in out.collect()) == [1, 2]


def test_two_step_fetch_returns_each_row_once(spark, shop):
    near = shop[0]
    table = frame(spark, [(10, b"x"), (11, b"y"), (50, b"z")], "id int, blob binary")
    assert sorted(r["id"] for r in R.fetch_by_ids(near, table, "id").collect()) == [10, 11]


def test_eligible_products_and_share(shop):
    _, purchases, products, reviews = shop
    eligible = R.eligible_products(purchases, reviews)
    assert sorted(r["product_id"] for r in eligible.collect()) == [1, 3, 4]
    assert R.eligible_share(eligible, products).first()["share"] == 0.75
    assert tuple(R.eligible_counts(purchases, reviews, products).first()) == (3, 4, 0.75)


def test_price_range_rounds_half_to_even_and_keeps_one(spark):
    prices = [(i, "A", float(p)) for i, p in enumerate([5, 1, 3, 2, 4, 6, 8, 7, 10, 9])]
    products = frame(spark, prices + [(50, "B", 7.0), (51, "N", None)], "product_id int, category string, price double")
    out = {(r["category"], r["fraction"]): (r["low"], r["high"]) for r in
           R.price_range(products, [0.05, 0.25, 0.35, 1.0]).collect()}
    # round(0.5) = 0 becomes 1; round(2.5) = 2; round(3.5) = 4
    assert out == {("A", 0.05): (1, 1), ("A", 0.25): (1, 2), ("A", 0.35): (1, 4), ("A", 1.0): (1, 10),
                   ("B", 0.05): (7, 7), ("B", 0.25): (7, 7), ("B", 0.35): (7, 7), ("B", 1.0): (7, 7)}


def test_sweep_counts_ties_at_the_upper_bound(spark, shop):
    near, purchases, *_ = shop
    products = frame(spark, [(1, "X", 1.0), (2, "X", 2.0), (3, "X", 2.0), (5, "X", 9.0)],
                     "product_id int, category string, price double")
    out = {r["fraction"]: (r["eligible"], r["matched"]) for r in
           R.fraction_sweep(near, purchases, products, [0.25, 0.5, 1.0]).collect()}
    assert out == {0.25: (1, 1), 0.5: (3, 3), 1.0: (4, 3)}


def test_payload_is_fetched_for_every_match(spark):
    items = frame(spark, [(1, [0.0], True), (2, [5.0], False)], ITEM).withColumn("path", F.concat(F.lit("p"), "item_id"))
    queries = frame(spark, [(1, [0.0]), (2, [0.1])], QUERY)
    out = R.knn_payload(queries, items, ["path"], 1).collect()
    assert sorted((r["query_id"], r["path"]) for r in out) == [(1, "p1"), (2, "p1")]


def test_one_item_near_to_all_queries(spark):
    """A hub among the neighbours: the same votes and payloads, and no task has its rows alone."""
    near = spark.range(3000, numPartitions=3).selectExpr("id AS query_id", "explode(array(7L, 100 + id % 1000)) AS item_id")
    labels = spark.range(1100).selectExpr("id AS item_id", "id % 2 = 1 AS label", "concat('p', id) AS path")
    votes = R.vote(near, near.select("query_id").distinct(), labels, min_votes=2)
    want = {i: 1 + (100 + i % 1000) % 2 for i in range(3000)}
    assert {r.query_id: r.votes for r in votes.collect()} == want
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = R.attach_payload(near, labels, "item_id", ["path"])
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 6000 and max(sizes) < 1500
        assert found.where("path <> concat('p', item_id)").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
