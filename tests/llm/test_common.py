import time

from pyspark.sql import functions as F

from loomstone.llm import common


def shuffle_files(spark):
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    scratch, before, setting = common.Scratch(spark), shuffle_files(spark), spark.conf.get(common.CLEANUP)
    table = scratch.table(spark.range(20_000).groupBy(F.xxhash64("id").alias("h")).count(), "counted")
    for _ in range(50):  # they are removed by another thread
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 20_000 and spark.conf.get(common.CLEANUP) == setting
    scratch.drop()
