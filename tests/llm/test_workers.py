"""Workers that cannot import the package run every query and the pipeline."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    .config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
spark.sparkContext.setCheckpointDir({shared!r})


def seen(batches):
    import importlib.util
    import pyarrow as pa
    for _ in batches:
        yield pa.record_batch([pa.array([importlib.util.find_spec("geotiles") is not None])], names=["seen"])


assert not any(r[0] for r in spark.range(4).mapInArrow(seen, "seen boolean").collect())
import __spark_entry__ as entry
for name, query in entry.queries().items():
    if name == "pipeline" or name.startswith("op"):
        print(name, query(spark, {data!r}).count(), flush=True)
"""


def test_without_the_package_on_workers(data, tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=repo, shared=str(tmp_path / "shared"), data=data))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1200)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split()) >= 22
