import subprocess
import sys

import pytest

from nearframe import context

PLAIN = """
import sys; sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from nearframe.context import cut_lineage, scratch_path, shared_root, with_position
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_root(spark) == shared_root(spark)
spark.range(5).write.parquet(scratch_path(spark, "t"))
assert cut_lineage(spark.range(5)).count() == 5
assert sorted(r.pos for r in with_position(spark.range(5), "id").collect()) == [1, 2, 3, 4, 5]
"""


def test_a_plain_local_session_works(tmp_path):
    """A session without spark.checkpoint.dir, in a process without preset defaults."""
    repo = context.__file__.rsplit("/nearframe/", 1)[0]
    done = subprocess.run([sys.executable, "-c", PLAIN.format(repo=repo)], capture_output=True, text=True,
                          timeout=120, env={**__import__("os").environ, "SPARK_CONF_DIR": str(tmp_path),
                                            "PYSPARK_SUBMIT_ARGS": "pyspark-shell"})
    assert done.returncode == 0, done.stderr[-2000:]


def test_scratch_tables_are_dropped(spark):
    context.drop_scratch(spark)
    kept = context.store(spark.range(3), "kept")
    assert kept.count() == 3 and context.scratch_path(spark, "unused")
    assert context.drop_scratch(spark) == 1 and context.drop_scratch(spark) == 0


def test_a_cluster_needs_a_uri():
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, *_):
            return self.value

    class Session:
        def __init__(self, master, root):
            self.sparkContext, self.conf = type("C", (), {"master": master}), Conf(root)

    for root in (None, "/tmp/checkpoints"):
        with pytest.raises(RuntimeError):
            context.shared_root(Session("spark://host:7077", root))
    assert context.shared_root(Session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert context.shared_root(Session("local[4]", "/tmp/x")) == "/tmp/x"


CLUSTER = """
import sys; sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from nearframe import context
from nearframe.operators.cells import ann_search, build_index
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {folder!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate())
assert context.shared_root(spark) == {folder!r}
rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, embedding array<float>")
index = build_index(rows, context.scratch_path(spark, "index"), 4, item_id="id")
near = ann_search(index, rows, 2, nprobe=1, exact=True, query_id="id")
assert near.where("rank = 1 AND item_id = query_id").count() == 40
assert context.drop_scratch(spark) > 1
spark.stop()
print("searched")
"""


def test_executors_on_the_same_machine_share_a_plain_path(tmp_path):
    """local-cluster with spark.checkpoint.dir as a path without a scheme, as a preset often has it."""
    repo = context.__file__.rsplit("/nearframe/", 1)[0]
    done = subprocess.run([sys.executable, "-c", CLUSTER.format(repo=repo, folder=str(tmp_path / "shared"))],
                          cwd=tmp_path, capture_output=True, text=True, timeout=300,
                          env={**__import__("os").environ, "PYTHONPATH": repo, "PYSPARK_PYTHON": sys.executable})
    assert "searched" in done.stdout, done.stderr[-2000:]


TRIED = """
import sys; sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from nearframe import context
from nearframe.operators.cells import ann_search, build_index
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false")
         .config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "2")
         .config("spark.sql.legacy.setCommandRejectsSparkCoreConfs", "false")
         .config("spark.sql.warehouse.dir", {warehouse!r}).getOrCreate())
sc = spark.sparkContext
assert spark.conf.get("spark.checkpoint.dir", None) is None
print("unset", context.shared_root(spark))
assert context.store(spark.range(9), "t").count() == 9
sc.master = "spark://host:7077"  # executors are processes of their own, as on any cluster
print("own", context._if_shared(spark, "/proc/self/cwd/own"))  # another folder for each process
spark.conf.set("spark.checkpoint.dir", {plain!r})
print("plain", context.shared_root(spark))
rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, embedding array<float>")
index = build_index(rows, context.scratch_path(spark, "index"), 4, item_id="id")
near = ann_search(index, rows, 2, nprobe=1, exact=True, query_id="id")
print("found", near.where("rank = 1 AND item_id = query_id").count())
spark.conf.unset("spark.checkpoint.dir")
sc.setCheckpointDir({given!r})
print("given", context.shared_root(spark))
assert sorted(r.pos for r in context.with_position(context.store(spark.range(5), "t"), "id").collect()) == [1, 2, 3, 4, 5]
assert context.drop_scratch(spark) > 2
spark.stop()
"""


def test_a_folder_without_a_scheme_is_tried_by_the_executors(tmp_path):
    """Found to be shared: it is used. Another one for each process: refused. Set in the context only: tried as well."""
    folders = {name: str(tmp_path / name) for name in ("warehouse", "plain", "given")}
    repo = context.__file__.rsplit("/nearframe/", 1)[0]
    done = subprocess.run([sys.executable, "-c", TRIED.format(repo=repo, **folders)],
                          cwd=tmp_path, capture_output=True, text=True, timeout=300,
                          env={**__import__("os").environ, "PYTHONPATH": repo, "PYSPARK_PYTHON": sys.executable,
                               "SPARK_CONF_DIR": str(tmp_path)})
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.splitlines() == [
        f"unset file:{folders['warehouse']}/_scratch",
        "own None",
        f"plain file:{folders['plain']}",
        "found 40",
        f"given file:{folders['given']}"]


def test_a_session_in_another_folder_gets_the_package(tmp_path):
    """Workers of a session that was started elsewhere find the package once it has been shipped."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "elsewhere.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {root!r})
from nearframe.session import local_session, ship
spark = local_session("1")
archive = ship(spark)
from nearframe.operators.embedding import embed_column
rows = spark.createDataFrame([(1, "a b")], "id int, text string")
print("width", len(embed_column(rows, "text").first()["embedding"]))
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "width 64" in done.stdout, done.stderr[-2000:]
