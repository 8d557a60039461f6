"""Streams give what batches give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantrel import streaming


def test_streams(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i % 3, float(v)) for i, v in enumerate(rng.normal(5, 1, 60))]
    for part in range(2):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], "k long, x double").withColumn("ts", F.timestamp_seconds(F.lit(1000) + F.monotonically_increasing_id() % 50)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: streaming.read_events(spark, str(tmp_path / "in"), "k long, x double, ts timestamp")
    got = streaming.run_once(streaming.running_moments(stream(), "k", "x"), "moments").collect()
    for k in range(3):
        want = np.array([x for kk, x in rows if kk == k])
        last = max((r for r in got if r["k"] == k), key=lambda r: r["n"])
        assert last["n"] == 20 and last["mean"] == pytest.approx(want.mean()) and last["variance"] == pytest.approx(want.var())
    w = streaming.run_once(streaming.windowed_moments(stream(), "ts", "x", "k"), "windows", "complete").collect()
    assert sum(r["n"] for r in w) == 60
    s = streaming.run_once(streaming.compensated_sums(stream(), "k", "x"), "sums").collect()
    assert max(r["total"] for r in s if r["k"] == 0) == pytest.approx(sum(x for k, x in rows if k == 0))
