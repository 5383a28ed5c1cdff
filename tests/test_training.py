"""Tuning of the threat model."""

import datetime as dt
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from logloom.operators import training

SCHEMA = "id long, body_raw string, severity int, timestamp_utc timestamp"


def made(n, seed):
    rng = random.Random(seed)
    calm = ["order done", "page viewed", "cache warm", "job ended; ok"]
    harm = ["sql injection 'select' -- <script>", "access denied for root", "port scan attack", "failed login 'x'"]
    return [(i, rng.choice(harm if rng.random() < 0.3 else calm) + (" denied" if rng.random() < 0.1 else ""), rng.choice([2, 3, 4]), dt.datetime(2024, 1, 1)) for i in range(n)]


def test_threat_tuning_scores_both_sides_and_chooses_by_auc(spark):
    logs = spark.createDataFrame([*made(400, 1), (900, None, 2, None)], SCHEMA)
    table, model = training.tune_threats(logs, strengths=(0.0001, 0.5))
    rows = table.collect()
    assert [r["strength"] for r in rows] == [0.0001, 0.5] and sum(r["chosen"] for r in rows) == 1
    best = max(rows, key=lambda r: (r["validation_auc"], -r["strength"]))
    assert best["chosen"] and best["validation_auc"] > 0.9
    for r in rows:
        assert r["fit"] == training.fit_gap(r["train_accuracy"], r["validation_accuracy"])
    assert len(model.stages) == 3 and model.stages[-1].coefficients.size == 13


def test_auc_equals_the_evaluator(spark):
    rng = random.Random(2)
    scored = spark.createDataFrame([(float(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(500)], "label double, score double")
    want = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(scored)
    assert training.auc_of(scored, "score", "label") == pytest.approx(want, abs=1e-9)
    assert training.auc_of(scored.filter(F.lit(False)), "score", "label") is None


def test_threat_tuning_needs_both_classes(spark):
    with pytest.raises(ValueError):
        training.tune_threats(spark.createDataFrame([(i, "calm", 2, None) for i in range(10)], SCHEMA))
