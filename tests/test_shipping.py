"""Python workers import the package though the driver started elsewhere."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from hopmetrics.shipping import ship

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
ship(spark)
ship(spark)

def run(frames):
    from hopmetrics.functions import buckets
    for frame in frames:
        yield frame.assign(name=buckets.__name__)

print(spark.range(1).mapInPandas(run, "id long, name string").first().name)
"""


def test_workers_find_the_package(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "elsewhere.py"
    script.write_text(SCRIPT)
    done = subprocess.run(
        [sys.executable, str(script), str(REPO)], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=120
    )
    assert done.stdout.split()[-1:] == ["hopmetrics.functions.buckets"], done.stderr[-2000:]
