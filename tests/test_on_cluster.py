"""Queries with scratch tables, on executors that are processes of their own and with a plain ``spark.checkpoint.dir``."""

import datetime
import json
import os
import random
import subprocess
import sys

import pytest

# Rows that a query has to return for the tables below.
ROWS = {
    "ann_purchases": 8,
    "ann_search": 200,
    "ann_search_cosine": 50,
    "ann_search_probes": 40,
    "ann_vote": 40,
    "build_ann_index": 40,
    "concat_runs": 10,
    "embed_and_store": 3584,
    "fraction_sweep": 10,
    "index_maintained": 200,
    "index_upsert": 200,
    "index_upsert_items": 352,
    "ingest_deferred": 320,
    "ingest_indexed": 320,
    "ingest_no_index": 320,
    "knn_batch_collection": 50,
    "knn_blob": 200,
    "knn_join_large": 200,
    "knn_payload": 200,
    "knn_purchases_per_query": 159,
    "load_product_family": 354,
}

RUN = """
import json, sys
from concurrent.futures import ThreadPoolExecutor
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
from nearframe import context
spark = (SparkSession.builder.master("local-cluster[2,4,1024]").config("spark.ui.enabled", "false")
         .config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", {folder!r})
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
def run(name):
    try:
        return name, [r.asDict() for r in entry.queries()[name](spark, {tables!r}).collect()]
    except Exception as error:
        return name, repr(error)[:500]
for found in ThreadPoolExecutor(8).map(run, {names!r}):  # small jobs, which mostly wait
    print("got", json.dumps(found))
context.drop_scratch(spark)
spark.stop()
"""


def write_tables(spark, folder):
    chance, day = random.Random(5), datetime.datetime(2024, 1, 1)
    tables = {
        "embeddings": ("vec_id long, embedding array<float>, label int",
                       [(i, [chance.gauss(0, 1) for _ in range(8)], i % 10) for i in range(40)]),
        "customer": ("c_custkey long, c_mktsegment string", [(i, "BUILDING") for i in range(40)]),
        "orders": ("o_orderkey long, o_custkey long", [(i, i) for i in range(40)]),
        "lineitem": ("l_orderkey long, l_partkey long", [(i, i % 8) for i in range(40)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
                 [(i, f"part {i}", f"Brand {i}", ("ECONOMY", "PROMO")[i % 2], 10 * i, 900.0 + i) for i in range(8)]),
        "documents": ("doc_id long, text string, lang string, source string",
                      [(i, f"text {i} of item {i // 7}", "en", "web") for i in range(56)]),
        "events": ("event_id long, ts timestamp, user_id long, event_type string, value double, props string",
                   [(n, day + datetime.timedelta(seconds=n), n % 10, ("signup", "view", "purchase", "error")[n % 4],
                     n / 8, "x" * (n % 5 + 1)) for n in range(120)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def got(spark, tmp_path_factory):
    """Rows, or the error, of every query; all in one session."""
    top = tmp_path_factory.mktemp("cluster")
    write_tables(spark, f"{top}/tables")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = RUN.format(repo=repo, folder=f"{top}/shared", tables=f"{top}/tables", names=list(ROWS))
    done = subprocess.run([sys.executable, "-c", script], cwd=top, capture_output=True, text=True, timeout=900,
                          env={**os.environ, "PYTHONPATH": repo, "PYSPARK_PYTHON": sys.executable})
    found = dict(json.loads(line[4:]) for line in done.stdout.splitlines() if line.startswith("got "))
    assert found, done.stderr[-2000:]
    return found


@pytest.mark.parametrize("name", ROWS)
def test_a_query_with_scratch_tables_runs_on_a_cluster(got, name):
    assert not isinstance(got[name], str), got[name]
    assert len(got[name]) == ROWS[name]
    if name in ("ann_search", "knn_join_large"):
        assert all(r["query_id"] == r["item_id"] and r["dist"] == 0 for r in got[name] if r["rank"] == 1)
    for checked in ("in_nearest_cell", "within_radius", "self_first"):
        assert all(r.get(checked, True) for r in got[name])
