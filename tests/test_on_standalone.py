"""Queries with scratch tables on a cluster whose master is not ``local-cluster``, with a plain ``spark.checkpoint.dir``."""

import json
import os
import random
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from test_on_cluster import ROWS, write_tables

COUNTED = ROWS | {"ann_payload": 50, "graph_search": 40}
COMPARED = ["pipeline", "op3_warc", "op5_lm_score", "op6_exact_dedup", "op8_near_dedup", "op10_mixing", "op12_spelling",
            "op13_prefix_trie", "read_reviews", "knn_vote"]

SCRIPT = """
import json, sys
from concurrent.futures import ThreadPoolExecutor
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = (SparkSession.builder.master("local-cluster[2,4,1024]").config("spark.ui.enabled", "false")
         .config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", {top!r} + "/shared")
         .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "2").getOrCreate())
spark.sparkContext.master = "spark://host:7077"  # executors are processes of their own, as on any cluster
spark.sparkContext.setLogLevel("OFF")
def run(query):
    name, tables = query
    try:
        return name, [r.asDict() for r in entry.queries()[name](spark, {top!r} + "/" + tables).collect()]
    except Exception as error:
        return name, str(error)[:500] or repr(error)
for found in ThreadPoolExecutor(8).map(run, {names!r}):  # small jobs, which mostly wait
    print("got", json.dumps(found, default=str))
spark.stop()
"""


def write_corpus(spark, folder):
    chance = random.Random(7)
    words = [f"{a}{b}ing" for a in ("stor", "wand", "hold", "read") for b in ("a", "o", "ee", "st")]
    texts = [" ".join(chance.choices(words, k=30)) for _ in range(40)]
    texts += texts[:6] + [t + " once more" for t in texts[6:12]] + ["", None]
    turns = [(c, t, ("user", "assistant")[t % 2], f"{words[(c % 3 + t) % 7]} {t}") for c in range(12) for t in range(2 + c % 3)]
    tables = {
        "documents": ("doc_id long, text string, lang string, source string",
                      [(i, t, "en", ("web", "book", None)[i % 3]) for i, t in enumerate(texts)]),
        "labels": ("doc_id long, quality int, toxic int", [(i, i % 2, 0) for i in range(50)]),
        "benchmark": ("item_id long, text string", [(i, texts[i][:60]) for i in range(0, 40, 13)]),
        "pages": ("page_id long, url string, html string",
                  [(i, f"http://a.example/{i}", t and f"<p>{t}</p>") for i, t in enumerate(texts)]),
        "conversations": ("conv_id long, turn long, role string, text string", turns),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("standalone")
    write_tables(spark, f"{top}/tables")
    write_corpus(spark, f"{top}/corpus")
    return top


@pytest.fixture(scope="module")
def got(folders):
    """Rows, or the error, of every query; all in one session."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    names = [(n, "corpus") for n in COMPARED] + [(n, "tables") for n in COUNTED]
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, top=str(folders), names=names)],
                          cwd=folders, capture_output=True, text=True, timeout=900,
                          env={**os.environ, "PYTHONPATH": repo, "PYSPARK_PYTHON": sys.executable})
    found = dict(json.loads(line[4:]) for line in done.stdout.splitlines() if line.startswith("got "))
    assert found, done.stderr[-2000:]
    return found


@pytest.mark.parametrize("name", COUNTED)
def test_a_query_with_scratch_tables_runs(got, name):
    assert not isinstance(got[name], str), got[name]
    assert len(got[name]) == COUNTED[name]


@pytest.mark.parametrize("name", COMPARED)
def test_a_query_with_scratch_tables_gives_the_rows_of_a_local_session(spark, folders, got, name):
    assert not isinstance(got[name], str), got[name]
    local = [r.asDict() for r in entry.queries()[name](spark, f"{folders}/corpus").collect()]
    plain = json.loads(json.dumps(local, default=str))
    assert plain and sorted(map(str, got[name])) == sorted(map(str, plain))
