"""Shuffle files of a table that is written go with its write."""

import subprocess
import sys

RUN = """
import sys
from pathlib import Path
from pyspark.sql import SparkSession, functions as F
from lexmill.sources.scratch import CLEANUP, materialize
place = Path(sys.argv[1])
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.local.dir", str(place / "local")).config("spark.checkpoint.dir", str(place / "shared")).getOrCreate()
df = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 10).alias("k")).agg(F.collect_list("id").alias("ids"))
before = spark.conf.get(CLEANUP)
held = materialize(df, "held")
left = [*place.glob("local/**/shuffle_*")]
assert not left, left
assert spark.conf.get(CLEANUP) == before
assert held.count() == 10 == df.count() and materialize(df, "again").join(held, "k").count() == 10
"""


def test_no_shuffle_files_are_left(tmp_path):
    subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], check=True, timeout=120)
