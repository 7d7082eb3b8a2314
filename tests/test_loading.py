import pytest
from pyspark.sql import functions as F

from nearframe.context import with_position
from nearframe.operators import constraints as K
from nearframe.operators import documents as D
from nearframe.operators import loading as L
from nearframe.operators import skew
from nearframe.sources import generators as G


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_positions_are_consecutive_with_a_hot_value(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("v"), "id")
    out = with_position(df, "v", "id").orderBy("pos").collect()
    assert [r["pos"] for r in out] == list(range(1, 5001))
    assert [(r["v"], r["id"]) for r in out] == sorted((r["v"], r["id"]) for r in out)
    assert with_position(df.where("false"), "v", "id").count() == 0


@pytest.mark.parametrize("top_rows", [100, 0])
def test_sample_is_repeatable_and_without_replacement(spark, monkeypatch, top_rows):
    monkeypatch.setattr(L, "TOP_ROWS", top_rows)
    df = spark.range(200).toDF("k")
    a = [r["k"] for r in L.sample_n(df, 50, "k").collect()]
    assert sorted(a) == sorted(r["k"] for r in L.sample_n(df.repartition(7), 50, "k").collect())
    assert len(set(a)) == 50 and L.sample_n(df, 999, "k").count() == 200
    assert sorted(r["k"] for r in L.sample_n(df, 5, "k", shuffle=False).collect()) == [0, 1, 2, 3, 4]
    assert set(a) != {r["k"] for r in L.sample_n(df, 50, "k", seed=1).collect()}


def test_split_corpus(spark):
    df = spark.range(10, 20).toDF("k")
    a, b = L.split_corpus(df, "k", 3)
    assert [r["k"] for r in a.orderBy("k").collect()] == [10, 11, 12] and b.count() == 7
    a, b = L.split_corpus(df, "k", 99)
    assert (a.count(), b.count()) == (10, 0)


def test_labels_and_filter(spark):
    df = frame(spark, [(1, 0, "a"), (2, 1, "b")], "id int, spam int, text string")
    assert [r["id"] for r in L.legit(df).collect()] == [1] and L.legit(df, False).count() == 2
    assert [tuple(r) for r in L.labelled(df).orderBy("text").collect()] == [("a", False), ("b", True)]


def test_arrays_of_unequal_length_and_empty_ones(spark):
    df = frame(spark, [(1, ["a", 'b|"q"\n'], [1]), (2, [], [])], "k int, t array<string>, n array<int>")
    assert sorted(map(tuple, L.zip_arrays(df, ["t", "n"], "k").collect()), key=str) == [
        (1, 0, "a", 1), (1, 1, 'b|"q"\n', None)]
    assert [r["ordinal"] for r in L.unnest_ordinality(df, ["t", "n"], "k").orderBy("ordinal").collect()] == [1, 2]


def test_names_have_to_be_unique_to_find_keys(spark):
    inputs = frame(spark, [("a", 1), ("b", 2)], "name string, x int")
    stored = frame(spark, [("a", 10), ("b", 11)], "name string, id int")
    assert sorted((r["x"], r["id"]) for r in L.map_generated_keys(inputs, stored, "name", "id").collect()) == [(1, 10), (2, 11)]
    with pytest.raises(Exception, match="not unique"):
        L.map_generated_keys(inputs, stored.union(stored), "name", "id").collect()


def test_insert_new_and_returning_keys(spark):
    table = frame(spark, [("a", 1)], "name string, id int")
    new = frame(spark, [("a", 5), ("b", 7), ("b", 6), ("c", 8)], "name string, id int")
    assert sorted(map(tuple, L.insert_new(table, new, "name").collect())) == [("b", 6), ("c", 8)]
    names = L.insert_new(table.select("name"), new.select("name"), "name")
    keyed = L.insert_returning(names, table, ["name"])
    assert sorted((r["name"], r["id"]) for r in keyed.collect()) == [("b", 2), ("c", 3)]
    assert L.attach_fk(new.select("name"), table, "name", "id").count() == 1


def test_constraints_report_every_kind_of_violation(spark):
    tables = {
        "product": frame(spark, [(1, "a"), (1, "b"), (2, None)], "id int, name string"),
        "review": frame(spark, [(1, 1, 0), (2, 9, 6), (3, 1, 5), (4, None, 1)], "rid int, product_id int, rating int"),
        "category": frame(spark, [(1, "x"), (1, "x"), (1, "y")], "product_id int, name string"),
    }
    rules = [K.Unique("pk", "product", ["id"]), K.Unique("ck", "category", ["product_id", "name"]),
             K.NotNull("nn", "product", "name"), K.Between("range", "review", "rating", 1, 5),
             K.ForeignKey("fk", "review", "product_id", "product", "id")]
    assert sorted(map(tuple, K.check_constraints(tables, rules).collect()), key=str) == [
        ("ck", "1|x", 2), ("fk", "9", 1), ("nn", None, 1), ("pk", "1", 2), ("range", "0", 1), ("range", "6", 1)]


def test_keys_of_a_large_table_are_counted_in_many_tasks(spark, monkeypatch):
    """Distinct keys are dealt by rows, so that no task has to hold those of many; a frequent key counts once."""
    monkeypatch.setattr(K, "GROUP_ROWS", 100, raising=False)
    monkeypatch.setattr(K, "frequent_keys", lambda df, key: skew.frequent_keys(df, key, 0.1), raising=False)
    keys = [*range(500), *range(450), *[7] * 400, None]
    tables = {"t": frame(spark, [(k, 0) for k in keys], "id int, z int"), "p": frame(spark, [(k,) for k in range(400)], "id int")}
    rules = [K.Unique("pk", "t", ["id", "z"]), K.ForeignKey("fk", "t", "id", "p", "id")]
    wanted = [("pk", f"{k}|0", 2 + 400 * (k == 7)) for k in range(450)] + [("fk", str(k), 1 + (k < 450)) for k in range(400, 500)]
    assert sorted(map(tuple, K.check_constraints(tables, rules).collect())) == sorted(wanted)
    parts = K.check_constraints(tables, rules[:1]).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 150


@pytest.fixture(scope="module")
def catalogue(spark):
    product = frame(spark, [(1, "a", "A", 0.5), (2, "b", "B", 3.0), (3, "c", "C", None), (4, "d", None, 1.0)],
                    "product_id int, name string, description string, price double")
    review = frame(spark, [(i, 1, f"r{i}") for i in (6, 5, 4, 3, 2, 1)] + [(9, 2, 'x|"y"\nz')] +
                   [(20 + i, 3, f"t{i}") for i in range(5)], "review_id int, product_id int, review_text string")
    category = frame(spark, [(1, "Z", 0), (1, "A", 1)], "product_id int, category_name string, pos int")
    return product, review, category


@pytest.mark.parametrize("order, names", [("name", "A, Z"), ("pos", "Z, A")])
def test_documents(catalogue, order, names):
    out = {r["product_id"]: r["document"] for r in D.build_documents(*catalogue, category_order=order).collect()}
    assert out[1] == f"a. A. Price: $0.50. Reviews: r1 | r2 | r3 | r4 | r5. Categories: {names}"
    assert out[2] == 'b. B. Price: $3.00. Reviews: x|"y"\nz. Categories: Uncategorized'
    assert out[3] is None and out[4] is None


def test_product_without_reviews(catalogue, spark):
    product, review, category = catalogue
    out = D.build_documents(product.where("product_id = 1"), review.where("false"), category.where("false")).first()
    assert out["document"] == "a. A. Price: $0.50. Reviews: No reviews. Categories: Uncategorized"


def test_generated_products_follow_their_rule(spark):
    rows = {r["ordinal"]: r for r in G.generate_products(spark.range(12)).collect()}
    assert rows[0]["name"] == "Premium Electronics Item 0" and str(rows[0]["price"]) == "19.99"
    assert [len(rows[i]["reviews"]) for i in range(5)] == [2, 3, 4, 5, 2]
    assert rows[11]["categories"] == ["Home & Garden", "Sports", "Books"]
    assert [r["rating"] for r in rows[3]["reviews"]] == [3, 4, 5, 3, 4] and rows[3]["stock"] == 71


def test_product_family_round_trip(spark, tmp_path):
    from nearframe.operators.embedding import embed_column

    path = str(tmp_path / "f")
    nested = G.generate_products(spark.range(6))
    L.load_product_family(nested, path, "hash", "hash-32")
    product, review, category = (spark.read.parquet(f"{path}/{n}") for n in ("product", "review", "product_category"))
    tables = {"product": product, "review": review, "category": category}
    assert K.check_constraints(tables, [
        K.Unique("pk", "product", ["product_id"]), K.Unique("rk", "review", ["review_id"]),
        K.ForeignKey("fr", "review", "product_id", "product", "product_id"),
        K.ForeignKey("fc", "category", "product_id", "product", "product_id")]).count() == 0
    assert (product.count(), review.count(), category.count()) == (6, 19, 12)
    # The stored vector is the vector of the document built with input order.
    keyed = L.assign_keys(nested, "ordinal", key="product_id")
    p, r, c = L.flatten_products(keyed)
    r = L.assign_keys(r, "product_id", "pos", key="review_id")
    want = embed_column(D.build_documents(p, r, c, category_order="pos"), "document", model="hash-32")
    assert {x["product_id"]: x["embedding"] for x in product.collect()} == {x["product_id"]: x["embedding"] for x in want.collect()}
    given = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "ordinal bigint, embedding array<float>")
    L.load_product_family(nested, path, vectors=given)
    assert spark.read.parquet(f"{path}/product").agg(F.sum(F.col("embedding")[0])).first()[0] == 15.0


def test_generated_shop_keeps_its_promises(spark):
    shop = G.generate_commerce(spark.range(1, 301).toDF("customer_id"))
    assert shop["products"].count() == 1500
    bought = shop["purchases"].join(shop["customers"], "customer_id").groupBy("customer_id", "tier").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("product_id").alias("d")).collect()
    assert len(bought) == 300 and all(r["n"] == r["d"] for r in bought)
    assert all((8 <= r["n"] <= 15) if r["tier"] in ("gold", "platinum") else (2 <= r["n"] <= 6) for r in bought)
    share = shop["reviews"].count() / shop["purchases"].count()
    assert 0.6 < share < 0.8
    good = shop["reviews"].join(shop["customers"].where("tier in ('gold', 'platinum')"), "customer_id")
    assert good.agg(F.min("rating")).first()[0] == 3
    assert "reviews" not in G.generate_commerce(spark.range(3).toDF("customer_id"), with_reviews=False)


def test_split_keeps_every_row_and_null_keys_in_the_rest(spark, monkeypatch):
    df = spark.createDataFrame([(3, "c"), (None, "n"), (1, "a"), (2, "b")], "k int, v string")
    for limit in (100, 0):
        monkeypatch.setattr(L, "TOP_ROWS", limit)
        for n, first in ((2, "ab"), (3, "abc"), (9, "abc")):
            head, rest = L.split_corpus(df, "k", n)
            assert sorted(r["v"] for r in head.collect()) == list(first)
            assert sorted(r["v"] for r in rest.collect()) == sorted(set("abcn") - set(first))
