"""The queries on workers that can't import the package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as E
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setCheckpointDir(sys.argv[2])
for name, query in E.queries().items():
    if name.startswith("op") or name == "pipeline":
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("ran", name, flush=True)
"""


def test_workers_without_the_package(tmp_path):
    """All queries run from an empty folder, where workers find no module of this repository."""
    empty = tmp_path / "empty"
    empty.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", RUN, REPO, str(tmp_path / "shared")], cwd=empty, env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-3000:]
    assert out.stdout.count("ran ") == 14
