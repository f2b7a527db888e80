"""Python workers that wait for their next task hold nothing of the last one's batches."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: A session with one core, so one worker: MB that it holds after a large job beyond those after a small one.
PROBE = """
import sys
import psutil
from pyspark.sql import SparkSession, functions as F
from aerolith.llm import neardup, quality, wavelet
from aerolith.llm.queries import tokenizer_json

spark = (
    SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1")
    .config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate()
)
word = lambda i: F.translate(F.hex(F.pmod(F.xxhash64("doc_id", i), F.lit(1000))), "0123456789", "ghijklmnop")
rows = lambda n: spark.range(0, n, 1, 1).withColumnRenamed("id", "doc_id").withColumn("text", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(1500)), word)))
labels = spark.range(0, 8, 1, 1).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
jobs = {
    "classifier": lambda n: quality.resample(rows(n), labels),
    "join": lambda n: neardup.jaccard_classes(rows(n)),
    "packing": lambda n: rows(n).select(wavelet.token_count(F.col("text"), tokenizer_json(), special=True).alias("n")),
    "ids": lambda n: wavelet.round_trip(rows(n), tokenizer_json(), special=True),
}

def held(n):
    jobs[sys.argv[1]](n).write.format("noop").mode("overwrite").save()
    return max(p.memory_full_info().uss for p in psutil.Process().children(recursive=True) if "pyspark" in " ".join(p.cmdline()) and "java" not in p.name()) / 1e6

small = held(20)
print("held", held(4000) - small)
"""


def left_over(job: str, folder) -> float:
    env = os.environ | {"PYTHONPATH": REPO + os.pathsep + os.environ.get("PYTHONPATH", ""), "OMP_NUM_THREADS": "1"}
    out = subprocess.run([sys.executable, "-c", PROBE, job, str(folder)], env=env, capture_output=True, text=True, timeout=300, check=True).stdout
    return float(out.split("held")[-1])


@pytest.mark.parametrize("job", ["classifier", "join", "packing", "ids"])
def test_waiting_workers_hold_no_batches(job, tmp_path):
    assert left_over(job, tmp_path) < 12
