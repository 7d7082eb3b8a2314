import os
import pathlib
import sys

import pyspark
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nearframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def spark_home(tmp_path_factory):
    """Workers of ``local-cluster`` end their process if they can not make the folder ``work`` in Spark's home."""
    home = tmp_path_factory.mktemp("spark-home")
    for part in pathlib.Path(os.environ.get("SPARK_HOME", pyspark.__path__[0])).iterdir():
        if part.name != "work":
            (home / part.name).symlink_to(part)
    os.environ["SPARK_HOME"] = str(home)


@pytest.fixture(scope="session")
def spark(spark_home):
    session = local_session("4")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session
