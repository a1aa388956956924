"""Shards with signals: what moves, and what is written."""

import numpy as np
from pyspark.sql import functions as F

from pulseforge.shared import new_path
from pulseforge.sources import shards


def test_signals_move_once_and_come_padded(spark, tmp_path):
    rng = np.random.default_rng(2)
    exams = [(k, [rng.random(20).tolist() for _ in range(2)]) for k in range(120)]
    df = spark.createDataFrame(exams, "exam_id long, tracing array<array<float>>")
    plan = spark.createDataFrame([(k, "train" if k % 3 else "val", k % 4, 1000 - k, k % 15 + 1, k % 5, f"file{k}") for k in range(110)], "exam_id long, split string, shard_id long, pos long, length int, start_offset int, back string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # any table is above the limit
    try:
        stored = shards.store_signals(df, new_path(spark, "signals"), 8)
        rows = shards.shard_rows(plan, stored, 8)
        executed = rows._jdf.queryExecution().executedPlan().toString()
        assert executed.count("Exchange") == 1 and "hashpartitioning(split" in executed and "ShuffledHashJoin" in executed
        shards.write_shards(plan, stored, 8, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    back = spark.read.parquet(str(tmp_path / "out")).withColumn("file", F.input_file_name()).collect()
    assert sorted(r.exam_id for r in back) == list(range(110))
    assert len({r.file for r in back}) == len({(r.split, r.shard_id) for r in back}) == 8
    of = dict(exams)
    for r in back:
        k = r.exam_id
        width = max(x.length for x in back if (x.split, x.shard_id) == (r.split, r.shard_id))
        assert (r.width, r.back, r.pos) == (width, f"file{k}", 1000 - k)
        part = np.float32(of[k])[:, r.start_offset : r.start_offset + r.length]
        assert np.array_equal(np.float32(r.tracing), np.pad(part, ((0, 0), (0, width - part.shape[1]))))
    again = shards.open_bucketed(spark, stored.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://"), 8)
    assert again.count() == 120
