"""Workers need not have the package on their path: its functions and models travel with the tasks."""

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
def seen(batches):
    import importlib.util
    for b in batches:
        assert importlib.util.find_spec("siftrank") is None
        yield b
assert spark.range(5).mapInArrow(seen, "id long").count() == 5
from siftrank.llm import queries
for name in {names!r}:
    print(name, queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0)
"""


@pytest.mark.parametrize("names", [["op2_gumbel_pieces", "op5_quality", "op8_toxicity"], ["op11_variants", "op12_near_dedup", "op13_hard_negatives"]])
def test_queries_without_the_package_on_the_workers_path(tmp_path, names):
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(REPO), names=names)], cwd=tmp_path, capture_output=True, text=True, timeout=900, env={"PATH": "/usr/bin:/bin:/usr/local/bin", "PYSPARK_PYTHON": sys.executable, **{k: v for k, v in __import__("os").environ.items() if k in ("JAVA_HOME", "SPARK_HOME", "HOME", "TZ", "PATH", "SPARK_LOCAL_IP")}})
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split() for line in done.stdout.strip().split("\n")] == [[n, "True"] for n in names]
