import random

import pytest

from nearframe.operators.bitmaps import bitmaps, common, ids, sizes, within


@pytest.fixture(scope="module")
def members():
    pick = random.Random(5)
    edges = [0, 1, -1, 32_767, 32_768, 32_769, 65_536, 65_537, -32_767, -32_768, -32_769, 10**12]
    return {name: {*pick.sample(range(-40_000, 120_000), 900), *pick.sample(edges, 9)} for name in "abc"}


def table(spark, members):
    rows = [(name, i) for name, own in members.items() for i in own] * 2 + [("a", None)]
    return spark.createDataFrame(rows, "s string, id long").repartition(5)


def test_members_sizes_and_cuts(spark, members):
    df = table(spark, members)
    sets = bitmaps(df, "id", "s")
    found = {name: {r.id for r in ids(sets, "id", "s").where(f"s = '{name}'").collect()} for name in members}
    assert found == members
    assert {r.s: r.n for r in sizes(sets, "s").collect()} == {name: len(own) for name, own in members.items()}
    alone = [bitmaps(df.where(f"s = '{name}'"), "id") for name in "abc"]
    assert {r.id for r in ids(common(*alone), "id").collect()} == members["a"] & members["b"] & members["c"]
    assert sizes(common(*alone[:2])).first()[0] == len(members["a"] & members["b"])
    cut = sizes(within(sets, alone[2], "s"), "s")
    assert {r.s: r.n for r in cut.collect()} == {name: len(own & members["c"]) for name, own in members.items()}


def test_empty_sets(spark, members):
    none = bitmaps(table(spark, members).limit(0), "id")
    assert none.count() == 0 and sizes(none).first()[0] == 0 and ids(none, "id").count() == 0
    assert common(none, bitmaps(table(spark, members), "id")).count() == 0
