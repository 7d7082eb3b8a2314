"""Small tables with every awkward case, shared by the tests of this folder."""

import pytest

from made_texts import mutate, prose

@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies, shared passages, nulls, empty, white, very long, repeated rows."""
    base, passage = [prose(i, 60 + 7 * i) for i in range(12)], prose(99, 40)
    rows = list(enumerate(base))
    rows += [(100 + i, t.upper()) for i, t in enumerate(base[:4])] + [(110 + i, base[0]) for i in range(5)]
    rows += [(200 + i, mutate(base[5], i, 2)) for i in range(14)] + [(220 + i, mutate(base[6], i, 6)) for i in range(8)]
    rows += [(300 + i, f"{prose(500 + i, 30)}\n{passage}\t{prose(600 + i, 9)}") for i in range(8)]
    rows += [(400, None), (401, ""), (402, " \t\n "), (403, None), (404, "one"), (405, "one two"), (406, "One"),
             (407, "é ü ÀB ß"), (408, prose(7000, 20_000)), (409, "x" * 50_000), (410, "y y " * 40)]
    rows += [(None, base[1]), (None, None), (3, base[3]), (3, base[3]), (3, base[4]), (-5, base[2])]
    return rows


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The table with columns whose names clash with those that operators use inside."""
    rows = [(i, t, "s%d" % (n % 3) if n % 7 else None, n, n % 2 == 0, float(n)) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row long, kept boolean, score double"
                                 ).repartition(4)


@pytest.fixture
def small_batches(spark):
    """Arrow batches of a few rows, so that groups go on from one batch to the next."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, before)
