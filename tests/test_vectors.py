import math

import pytest
from pyspark.sql import functions as F

from nearframe.functions import text as X
from nearframe.functions import vectors as V


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column).first()[0]


def vec(v):
    return ("array<double>", v)


def test_distances_follow_their_definition(spark):
    a, b = [3.0, 4.0], [0.0, 8.0]
    assert one(spark, V.l2_distance(F.col("a"), F.col("b")), a=vec(a), b=vec(b)) == pytest.approx(5.0)
    assert one(spark, V.cosine_similarity(F.col("a"), F.col("b")), a=vec(a), b=vec(b)) == pytest.approx(0.8)
    assert one(spark, V.cosine_distance(F.col("a"), F.col("b")), a=vec(a), b=vec(b)) == pytest.approx(0.2)


def test_zero_vectors(spark):
    zero = vec([0.0, 0.0])
    assert one(spark, V.cosine_similarity(F.col("a"), F.col("b")), a=zero, b=vec([1.0, 0.0])) == 0.0
    assert one(spark, V.l2_normalize(F.col("a")), a=zero) is None


def test_normalize_and_reduce(spark):
    out = one(spark, V.l2_normalize(F.col("a")), a=vec([3.0, 4.0]))
    assert out == pytest.approx([0.6, 0.8])
    out = one(spark, V.reduce_dims(F.col("a"), 2), a=vec([3.0, 4.0, 12.0]))
    assert out == pytest.approx([0.6, 0.8])


def test_mean_pool_uses_marked_tokens_only(spark):
    tokens = ("array<array<double>>", [[1.0, 2.0], [3.0, 6.0], [100.0, 100.0]])
    out = one(spark, V.mean_pool(F.col("t"), F.col("m")), t=tokens, m=("array<int>", [1, 1, 0]))
    assert out == pytest.approx([2.0, 4.0])
    assert one(spark, V.mean_pool(F.col("t"), F.col("m")), t=tokens, m=("array<int>", [0, 0, 0])) is None


def test_mean_profile_is_not_normalised_and_defaults_to_zeros(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None)], "g int, v array<double>")
    profiles = V.mean_profile(df, "g", "v")
    members = spark.createDataFrame([(1,), (2,), (3,)], "g int")
    out = {r["g"]: r["embedding"] for r in V.profile_or_zero(members, profiles, "g", 2).collect()}
    assert out == {1: [0.5, 0.5], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    assert math.hypot(*out[1]) < 1


def test_width_check_fails_the_job(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    assert df.select(V.check_width(F.col("v"), 2)).count() == 2
    with pytest.raises(Exception, match="expected 3 values, found 2"):
        df.select(V.check_width(F.col("v"), 3)).collect()


@pytest.mark.parametrize("side, expected", [("right", "q: a b"), ("left", "q: c d")])
def test_request_options(spark, side, expected):
    column = X.with_options(F.col("t"), truncate_to=2, side=side, prompt="q: ")
    assert one(spark, column, t=("string", " a\tb  c\nd ")) == expected
    with pytest.raises(ValueError):
        X.with_options(F.col("t"), 2, side="middle")


def test_counters(spark):
    df = spark.createDataFrame([(1, "ab c"), (1, None), (2, "")], "k int, t string")
    out = {r["k"]: (r["inputs"], r["chars"], r["tokens"]) for r in X.text_counters(df, "t", "k").collect()}
    assert out == {1: (1, 4, 2), 2: (1, 0, 0)}
