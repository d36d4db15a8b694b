"""All operators run on workers that cannot import the package."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import os, sys
repo, folder = sys.argv[1:]
os.environ.pop("PYTHONPATH", None)
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    .config("spark.checkpoint.dir", folder + "/shared").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")

def missing(batches):
    import importlib.util
    for batch in batches:
        yield batch.slice(0, 0) if importlib.util.find_spec("casewright") is None else batch

assert spark.range(4).mapInArrow(missing, "id long").count() == 0, "workers have the package"
sys.path.insert(0, repo)
from casewright.llm.queries import QUERIES
for table in ("documents", "labels", "benchmark"):
    source = spark.read.parquet("/root/testdata/sf0.001/" + table + ".parquet")
    (source.where("doc_id < 40") if table == "documents" else source).coalesce(1).write.parquet(folder + "/" + table + ".parquet")
for name, query in QUERIES.items():
    query(spark, folder).write.format("noop").mode("overwrite").save()
    print("ran", name, flush=True)
"""


def test_workers_without_the_package(tmp_path):
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(REPO), str(tmp_path)], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    ran = [line.split()[1] for line in run.stdout.splitlines() if line.startswith("ran ")]
    from casewright.llm.queries import QUERIES

    assert ran == list(QUERIES), run.stderr[-3000:]
