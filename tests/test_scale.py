"""The distributed helpers against brute force, with one hot key."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logloom import scale
from logloom.operators.logs import rows_holding_terms


@pytest.fixture(scope="module")
def points():
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        key = "hot" if rnd.random() < 0.5 else rnd.choice("abc")
        rows.append((i, key, rnd.randrange(0, 300), rnd.randrange(0, 6)))
    return rows


def frame(spark, points):
    return spark.createDataFrame(points, "id long, k string, at long, item long")


@pytest.mark.parametrize("grain", [7, 50, 1000])
def test_trailing_sums(spark, points, grain):
    df = frame(spark, points).withColumn("n", F.lit(1))
    got = {(r.k, r["at"]): r.n for r in scale.trailing_sums(df, ["k"], "at", ["n"], 20, grain).collect()}
    want = {(k, at): sum(1 for _, k2, a2, _ in points if k2 == k and at - 20 <= a2 <= at) for _, k, at, _ in points}
    assert got == want


@pytest.mark.parametrize("window", [5, 20])
def test_trailing_distinct(spark, points, window):
    out = scale.trailing_distinct(frame(spark, points), ["k"], "item", "at", window, 13, {"low": F.col("item") < 2})
    got = {(r.k, r["at"]): (r.distinct_items, r.low) for r in out.collect()}
    want = {}
    for _, k, at, _ in points:
        seen = {i for _, k2, a2, i in points if k2 == k and at - window <= a2 <= at}
        want[(k, at)] = (len(seen), sum(1 for i in seen if i < 2))
    assert got == want


def test_lagged_and_positions(spark, points):
    df = frame(spark, points)
    bucket = F.floor(F.col("at") / 11)
    got = {r.id: (r.prev_1, r.prev_2) for r in scale.lagged(df, ["k"], ["at", "id"], bucket, F.col("item"), 2).collect()}
    place = {r.id: (r.position, r.total) for r in scale.positions(df, ["k"], ["at", "id"], bucket).collect()}
    for key in {p[1] for p in points}:
        rows = sorted((p for p in points if p[1] == key), key=lambda p: (p[2], p[0]))
        for i, p in enumerate(rows):
            assert got[p[0]] == (rows[i - 1][3] if i > 0 else None, rows[i - 2][3] if i > 1 else None)
            assert place[p[0]] == (i + 1, len(rows))


def test_exact_quantiles(spark, points):
    df = frame(spark, points).withColumn("v", F.col("at") * 1.5)
    got = {r.k: (r.q_0, r.q_1, r.q_2) for r in scale.exact_quantiles(df, ["k"], "v", [0.25, 0.5, 0.95], slices=8).collect()}
    pdf = pd.DataFrame(points, columns=["id", "k", "at", "item"])
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(tuple(np.percentile(g["at"] * 1.5, [25, 50, 95])))
    whole = scale.exact_quantiles(df, [], "v", [0.5]).first()
    assert whole.q_0 == pytest.approx(np.percentile(pdf["at"] * 1.5, 50))


def held(rows, terms):
    return {(i, j) for i, *texts in rows for j, term in terms if term and term.strip() and any(x and term.strip().lower() in x.lower() for x in texts)}


def test_rows_holding_terms_equal_contains(spark):
    words = [f"word{i:03d}" for i in range(60)]
    rows = [(i, f"xx {words[i]} and\t{words[(i * 7) % 60]} yy", f"svc-{i % 5}") for i in range(60)]
    rows += [(100, None, None), (101, "", "Aé日本 x"), (102, "out of memory in worker", "svc-1"), (103, "of memory out", "x" * 20_000 + "end")]
    terms = list(enumerate([*words, "ord01", "d", "OUT of memory", "f mem", "vc-", "日", "é日", "nothing here", "zzz", "", None, "  ", "xend", "and\tword"]))
    frame_ = spark.createDataFrame(rows, "id long, body string, svc string").withColumn("timestamp_utc", F.timestamp_micros("id"))
    found = rows_holding_terms(frame_, ["id", "timestamp_utc"], ["body", "svc"], spark.createDataFrame(terms, "term_id long, term string"))
    got = [(r.id, r.term_id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == held(rows, terms)
    newest = rows_holding_terms(frame_, ["id", "timestamp_utc"], ["body", "svc"], spark.createDataFrame(terms, "term_id long, term string"), 3)
    best = {}
    for i, j in sorted(held(rows, terms), reverse=True):
        best.setdefault(j, []).append(i)
    assert {(r.id, r.term_id) for r in newest.collect()} == {(i, j) for j, ids in best.items() for i in ids[:3]}
