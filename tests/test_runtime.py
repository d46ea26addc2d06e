import subprocess
import sys

CODE = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g").getOrCreate()
from sorrel.plans.runtime import spread, width
assert width(spark) == 200, width(spark)
spread(spark.range(3).toDF("x")).count()
spark.conf.set("spark.sql.shuffle.partitions", "3")
assert width(spark) == 3
"""


def test_session_that_sets_no_shuffle_partitions():
    done = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
