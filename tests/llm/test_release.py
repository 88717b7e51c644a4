import time

from pyspark.sql import functions as F

from graphloom.llm.common import cut, release


def test_release_frees_the_step_before(spark):
    held = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    release(spark)
    time.sleep(3)
    before = held.size()
    kept = cut(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count().repartition(3))
    assert held.size() > before
    release(spark)
    for _ in range(30):
        if held.size() <= before:
            break
        time.sleep(0.2)
    assert held.size() <= before and kept.count() == 97
