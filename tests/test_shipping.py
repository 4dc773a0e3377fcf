import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
print("ROWS", e.queries()["list_command_fold"](s, {sf!r}).count())
"""


def test_workers_started_elsewhere_find_the_package(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(root=str(Path(__file__).resolve().parent.parent), sf=sf)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS 1000" in out.stdout, out.stderr[-2000:]
