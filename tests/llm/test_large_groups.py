"""Keys stay whole in one task, large blocks take few jobs, and both link what comparing all links."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import bloom, simhash


def jobs(spark, call) -> int:
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        call()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def roots(links, names) -> dict:
    up = {n: n for n in names}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(bytes(a)), root(bytes(b))
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in names}


def test_a_filter_takes_no_job_for_each_partition(spark):
    rows = spark.createDataFrame([(k, np.arange(k, 90, 4, dtype=np.uint64).tobytes()) for k in range(4)], "segment long, hashes binary")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert jobs(spark, lambda: bloom.seen_filter(rows, 4, 1)) < 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_key_is_repartitioned_again_after_a_join_by_it(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("key"), F.col("id").alias("x")).hint("merge").join(spark.range(1).select(F.lit(7).cast("long").alias("key")), "key", "left_anti")
    plan = lambda df: df.mapInArrow(lambda batches: batches, "key long, x long")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan(simhash._together(rows, "key"))


@pytest.mark.parametrize("pair", [2, 5])
def test_pairs_of_shares_link_what_one_block_does(spark, monkeypatch, pair):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    monkeypatch.setattr(simhash, "PAIR", pair)
    monkeypatch.setattr(simhash, "split_links", None)  # not for blocks of this size
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = sorted({int(b) ^ 1 << int(rng.integers(64)) ^ 1 << int(rng.integers(64)) for b in base for _ in range(7)})
    names = [np.array([x], ">u8").tobytes() for x in fps]
    nodes = spark.createDataFrame([(n, [7]) for n in names], "fp binary, keys array<long>")
    found = simhash.near_links(nodes, 1, 4, "shingles").collect()
    every = [(a, b) for a, x in zip(names, fps) for b, y in zip(names, fps) if a < b and (x ^ y).bit_count() <= 4]
    assert roots(found, names) == roots(every, names)


def test_a_block_of_moderate_size_takes_one_pass(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARE", 4)
    monkeypatch.setattr(simhash, "GROUP", 3)
    monkeypatch.setattr(simhash, "components", None)  # is for a second pass
    fps = [3 ** k for k in range(1, 30)]
    names = [np.array([x], ">u8").tobytes() for x in fps]
    rows = spark.createDataFrame([(1, n, n, None) for n in names], "block long, node binary, fp binary, shingles binary")
    found = simhash.split_links(rows, 1, 12).collect()
    every = [(a, b) for a, x in zip(names, fps) for b, y in zip(names, fps) if a < b and (x ^ y).bit_count() <= 12]
    assert roots(found, names) == roots(every, names)
