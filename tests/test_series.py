"""Smoothing as composed maps against the fold over one value after the other."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import forecast

SERIES = "series string, bucket_ts timestamp, value double"
START = dt.datetime(2024, 1, 1)


def fold(values, level, trend, base, alpha=0.3, beta=0.1, slow=0.01):
    for v in values:
        before = level
        level = alpha * v + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        base = slow * v + (1 - slow) * base
    return level, trend, base


def made(spark, seed=1):
    rng = random.Random(seed)
    rows = [(s, START + dt.timedelta(hours=i), rng.uniform(-50, 100)) for s, n in (("one", 1), ("two", 2), ("many", 3000), (None, 5)) for i in range(n)]
    shuffled = rows[:] + [("one", START, None)]
    rng.shuffle(shuffled)
    return {s: [v for x, _, v in rows if x == s] for s in ("one", "two", "many", None)}, spark.createDataFrame(shuffled, SERIES)


@pytest.fixture()
def small_batches(spark):
    """Series are cut into runs of at most 64 values and dealt to several tasks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_states_equal_the_fold(spark, small_batches):
    values, series = made(spark)
    holt = {r["series"]: r for r in forecast.holt_state(series).collect()}
    ses = {r["series"]: r for r in forecast.ses_state(series).collect()}
    assert set(holt) == set(ses) == set(values)
    for s, v in values.items():
        level = v[0]
        for x in v[1:]:
            level = 0.3 * x + 0.7 * level
        assert ses[s]["level"] == pytest.approx(level, abs=1e-9) and ses[s]["n"] == len(v)
        if len(v) == 1:
            assert not holt[s]["fitted"] and holt[s]["level"] == 0
            continue
        want = fold(v[1:], v[0], v[1] - v[0], 0)
        assert (holt[s]["level"], holt[s]["trend"]) == pytest.approx(want[:2], abs=1e-9) and holt[s]["last_value"] == v[-1]


def test_updates_equal_the_fold(spark, small_batches):
    values, series = made(spark, 2)
    stored = spark.createDataFrame([("many", 5.0, 1.0, 2.0), ("gone", 1.0, 2.0, 3.0)], "series string, level double, trend double, baseline double")
    got = {r["series"]: tuple(r)[1:] for r in forecast.update_series(stored, series).collect()}
    assert got["gone"] == (1.0, 2.0, 3.0)
    assert got["many"] == pytest.approx(fold(values["many"], 5.0, 1.0, 2.0), abs=1e-9)
    for s in ("one", "two", None):
        v = values[s]
        assert got[s] == pytest.approx(fold(v[1:], v[0], 0.0, v[0]), abs=1e-9)


def test_one_long_series_is_shared_by_tasks(spark):
    n = 10_000_000
    value = (F.col("id") * 7919 % 1000) / 10 + F.col("id") / 1e6
    series = spark.range(n).select(F.lit("s").alias("series"), F.timestamp_micros(F.col("id")).alias("bucket_ts"), value.alias("value"))
    parts = forecast._composed(series, 0.3, 0.1, 0.01).select(F.size(F.array_distinct(F.transform("slices", lambda m: m["part"])))).first()[0]
    assert parts > 1
    i = np.arange(n)
    x = ((i * 7919 % 1000) / 10 + i / 1e6).tolist()
    want = fold(x[1:], x[0], x[1] - x[0], 0)
    got = forecast.holt_state(series).first()
    assert (got["level"], got["trend"]) == pytest.approx(want[:2], abs=1e-9) and got["n"] == n


def test_empty_series(spark):
    assert forecast.holt(spark.createDataFrame([], SERIES)).collect() == []
    assert forecast.ses(spark.createDataFrame([("a", START, None)], SERIES)).collect() == []
