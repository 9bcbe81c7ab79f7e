"""Arrays that many tasks share."""

import resource

import numpy as np
from pyspark.sql import functions as F

from logsluice.llm.counted import dealt
from logsluice.llm.shared_arrays import SharedArrays


def test_more_arrays_than_open_files(tmp_path):
    arrays = SharedArrays(f"file://{tmp_path}/arrays")
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    for k in range(1000):
        arrays.write(f"a-{k}", np.arange(k, dtype=np.uint64))
    resource.setrlimit(resource.RLIMIT_NOFILE, (256, hard))
    try:
        held = [arrays.read(f"a-{k}", np.uint64) for k in range(1000)]
        assert all(len(x) == k and (not k or int(x[-1]) == k - 1) for k, x in enumerate(held))
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    assert arrays.names() == {f"a-{k}" for k in range(1000)}


def test_no_partition_has_two_shards(spark):
    rows = spark.range(4000).select((F.col("id") % 100).cast("int").alias("shard"), "id")
    held = dealt(rows, 100).groupBy(F.spark_partition_id().alias("part")).agg(F.count_distinct("shard").alias("shards"), F.count("*").alias("n"))
    assert [tuple(r)[1:] for r in held.collect()] == [(1, 40)] * 100
