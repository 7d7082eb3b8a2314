import pytest
from pyspark.sql import functions as F

from nearframe.operators.skew import frequent_keys, join_hubs


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows has one key, some keys have no partner, some are null."""
    return spark.range(6000, numPartitions=5).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 101 = 0 THEN NULL ELSE id % 500 END AS k")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("spread", [1, 3, None])
def test_equals_a_plain_join(spark, facts, how, spread):
    side = spark.range(0, 400).selectExpr("id k", "concat('v', id) v").unionAll(spark.sql("SELECT 7L k, 'w' v"))
    got = join_hubs(facts, side, "k", frequent_keys(facts, "k", 0.01), how, spread)
    want = facts.join(side, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_frequent_keys(spark, facts):
    assert 7 in {r.k for r in frequent_keys(facts, "k", 0.1).collect()}
    assert frequent_keys(facts.where("id < 0"), "k").count() == 0
    even = frequent_keys(spark.range(100_000).selectExpr("cast(id AS string) k"), "k", 0.01)
    assert even.count() <= 800
    assert frequent_keys(facts.selectExpr("CAST(CAST(k AS STRING) AS BINARY) k"), "k").count() == 0
    with pytest.raises(ValueError):
        join_hubs(facts, facts, "k", even, "full")


def test_no_task_gets_the_hub_alone(spark, facts):
    side = spark.range(0, 500).selectExpr("id k")
    with_task = join_hubs(facts, side, "k", frequent_keys(facts, "k", 0.01), spread=16)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        most = with_task.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most < 1000  # of 2,000 rows with the hub's key
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
