"""Forecasts over bucketed series: columns series, bucket_ts, value (one row per bucket).

The smoothing recurrences are affine in their state, so runs of values are composed to maps in parallel
and only the maps are folded per series."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom import fixed


def hourly_counts(df: DataFrame, ts: str, series: list[str] = (), fill_gaps: bool = False) -> DataFrame:
    """Rows per hour. Empty hours are left out unless `fill_gaps` adds them as 0."""
    counts = df.groupBy(*series, F.date_trunc("hour", ts).alias("bucket_ts")).agg(
        F.count(F.lit(1)).cast("double").alias("value"))
    if not fill_gaps:
        return counts
    spans = counts.groupBy(*series).agg(F.min("bucket_ts").alias("_a"), F.max("bucket_ts").alias("_b"))
    grid = spans.select(*series, F.explode_outer(F.sequence("_a", "_b", F.expr("INTERVAL 1 HOUR"))).alias("bucket_ts"))
    return grid.join(counts, [*series, "bucket_ts"], "left").na.fill(0.0, ["value"])


def _powers(step: np.ndarray, gain: np.ndarray, n: int) -> np.ndarray:
    """step^0 gain, ..., step^(n - 1) gain, by doubling."""
    out, power = gain[None, :], step
    while len(out) < n:
        out, power = np.vstack([out, out @ power.T]), power @ power
    return out[:n]


def _slices(alpha: float, beta: float, slow: float):
    """Each run of one series in a sorted partition, a batch at a time, as the affine map that its values make of a
    state (level, trend), and as those of two plain averages: with all values, and without the first one."""
    step = np.array([[1 - alpha, 1 - alpha], [-alpha * beta, 1 - alpha * beta]])
    gain = np.array([alpha, alpha * beta])
    table = {}

    def composed(x: np.ndarray) -> tuple:
        n = len(x)
        if len(table.get("holt", ())) < n:
            table["holt"] = _powers(step, gain, n)
            for name, rate in (("fast", alpha), ("slow", slow)):
                table[name] = rate * (1 - rate) ** np.arange(n)
        m, v = np.linalg.matrix_power(step, n), table["holt"][:n][::-1].T @ x
        fast, slowly = (float(table[k][:n][::-1] @ x) for k in ("fast", "slow"))
        return (*m.ravel().tolist(), *v.tolist(), (1 - alpha) ** n, fast, (1 - slow) ** n, slowly)

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not len(batch):
                continue
            codes = batch["series"].to_numpy()
            same = np.array([a == b or (a is None and b is None) for a, b in zip(codes[1:], codes[:-1])], bool)
            cuts = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(batch)]]) if len(batch) > 1 else np.array([0, 1])
            values, out = batch["value"].to_numpy(float), []
            for low, high in zip(cuts[:-1], cuts[1:]):
                x = values[low:high]
                second = float(x[1]) if len(x) > 1 else None
                out.append((codes[low], part, seq, len(x), float(x[0]), second, float(x[-1]), *composed(x), *composed(x[1:])))
                seq += 1
            yield pd.DataFrame(out, columns=SLICE)

    return run


MAP = ["a", "b", "c", "d", "e", "f", "fk", "fv", "sk", "sv"]
SLICE = ["series", "part", "seq", "n", "first", "second", "last", *MAP, *[m + "1" for m in MAP]]


def _composed(series: DataFrame, alpha: float, beta: float, slow: float) -> DataFrame:
    """series, n, first, second, last_value, slices: one row per series with its maps in order of time.

    Values are dealt to tasks by ranges of (series, time), so one long series is shared by many tasks; what is
    gathered per series is one map per task and Arrow batch. Rows without a value take no part."""
    rows = series.select("series", "bucket_ts", F.col("value").cast("double").alias("value")).filter("value IS NOT NULL")
    kind = rows.schema["series"].dataType.simpleString()
    dealt = rows.repartitionByRange("series", "bucket_ts", "value").sortWithinPartitions("series", "bucket_ts", "value").select("series", "value")
    types = f"series {kind}, part int, seq long, n long, " + ", ".join(f"{c} double" for c in SLICE[4:])
    maps = dealt.mapInPandas(_slices(alpha, beta, slow), types)
    gathered = maps.groupBy("series").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(*SLICE[1:]))).alias("slices"))
    first = F.element_at("slices", 1)
    return gathered.select("series", "n", "slices", first["first"].alias("first"), F.coalesce(
        first["second"], F.try_element_at("slices", F.lit(2))["first"]).alias("second"), F.element_at("slices", -1)["last"].alias("last_value"))


def _fold(start: Column, skip_first: Column, apply) -> Column:
    """`apply`(state, map) over all slices; the first slice without its first value where `skip_first` holds."""
    def at(m: Column, i: Column) -> Column:
        cut = skip_first & (i == 0)
        return F.struct(*[F.when(cut, m[c + "1"]).otherwise(m[c]).alias(c) for c in MAP])

    return F.aggregate(F.transform("slices", at), start, apply)


def _holt_map(s: Column, m: Column) -> Column:
    return F.struct((m["a"] * s["level"] + m["b"] * s["trend"] + m["e"]).alias("level"),
                    (m["c"] * s["level"] + m["d"] * s["trend"] + m["f"]).alias("trend"))


def ses_state(series: DataFrame, alpha: float = 0.3) -> DataFrame:
    """series, n, level after simple exponential smoothing."""
    level = _fold(F.col("first"), F.lit(True), lambda s, m: m["fk"] * s + m["fv"])
    return _composed(series, alpha, 0.0, 0.0).select("series", "n", level.alias("level"))


def ses(series: DataFrame, alpha: float = 0.3, horizon: int = 1) -> DataFrame:
    """Flat forecast: series, step, forecast."""
    return ses_state(series, alpha).select(
        "series", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), F.col("level").alias("forecast"))


def holt_state(series: DataFrame, alpha: float = 0.3, beta: float = 0.1) -> DataFrame:
    """series, n, level, trend, fitted, last_value. A series of one value is not fitted."""
    start = F.struct(F.col("first").alias("level"), (F.col("second") - F.col("first")).alias("trend"))
    none = F.struct(F.lit(0.0).alias("level"), F.lit(0.0).alias("trend"))
    state = F.when(F.col("n") >= 2, _fold(start, F.lit(True), _holt_map)).otherwise(none)
    return _composed(series, alpha, beta, 0.0).withColumn("_s", state).select(
        "series", "n", "_s.level", "_s.trend", (F.col("n") >= 2).alias("fitted"), "last_value")


def holt(series: DataFrame, alpha: float = 0.3, beta: float = 0.1, horizon: int = 1) -> DataFrame:
    """Linear forecast: series, step, forecast (0 when not fitted)."""
    h = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    return holt_state(series, alpha, beta).withColumn("step", h).select(
        "series", "step", F.when(F.col("fitted"), F.col("level") + F.col("step") * F.col("trend")).otherwise(0.0).alias("forecast"))


def _numbered(series: DataFrame) -> DataFrame:
    w = W.partitionBy("series").orderBy("bucket_ts")
    return series.withColumn("_i", F.row_number().over(w) - 1)


def seasonal(series: DataFrame, period: int = 24) -> DataFrame:
    """series, position, factor: centred mean of each position after a centred moving average is
    taken off. Series shorter than two periods have no rows."""
    half = period // 2
    around = W.partitionBy("series").orderBy("_i").rowsBetween(-half, half)
    rows = (_numbered(series).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("series")))
            .filter(F.col("_n") >= 2 * period)
            .withColumn("_m", F.avg("value").over(around)).withColumn("_c", F.count(F.lit(1)).over(around)))
    detrended = F.when(F.col("_c") == 2 * half + 1, F.col("value") - F.col("_m")).otherwise(0.0)
    means = rows.groupBy("series", (F.col("_i") % period).alias("position")).agg(F.avg(detrended).alias("_f"))
    return means.withColumn("factor", F.col("_f") - F.avg("_f").over(W.partitionBy("series"))).drop("_f")


def seasonal_outliers(series: DataFrame, factors: DataFrame, period: int = 24, threshold: float = 2.0,
                      detrend: bool = False) -> DataFrame:
    """Points whose distance from their seasonal factor is above threshold deviations of the
    factors. `detrend` compares the value less the series mean."""
    spread = factors.groupBy("series").agg(F.stddev_pop("factor").alias("_sd"))
    value = F.col("value") - F.avg("value").over(W.partitionBy("series")) if detrend else F.col("value")
    rows = _numbered(series).withColumn("_v", value).withColumn("position", F.col("_i") % period)
    out = rows.join(factors, ["series", "position"]).join(spread, "series")
    return out.filter(F.abs(F.col("_v") - F.col("factor")) > threshold * F.col("_sd")).select(
        "series", "bucket_ts", F.col("_i").alias("index"), "value", "factor")


def _first_step(level: Column, trend: Column, limit: Column, horizon: int, strict: bool) -> Column:
    """First step h in 1..horizon where level + h * trend passes the limit."""
    steps = F.sequence(F.lit(1), F.lit(horizon))
    passed = F.filter(steps, lambda h: (level + h * trend > limit) if strict else (level + h * trend >= limit))
    return F.try_element_at(passed, F.lit(1))


def failure_forecast(rates: DataFrame, horizon: int = 60, error_threshold: float = 0.1) -> DataFrame:
    """Failure probability, first step over the threshold, trend and confidence per series. Fewer
    than 10 points give an unknown trend."""
    base = rates.groupBy("series").agg(F.avg("value").alias("_mean"), (F.stddev_pop("value") + 1e-8).alias("_std"))
    s = holt_state(rates).join(base, "series")
    p = 1 / (1 + F.exp(-(F.col("last_value") - F.col("_mean")) / F.col("_std")))
    t, known = F.col("trend"), F.col("n") >= 10
    p = F.when(t > 0, F.least(p * 1.2, F.lit(1.0))).otherwise(p)
    return s.select(
        "series", F.col("n").cast("int").alias("n"), F.when(known, p).otherwise(0.5).alias("failure_probability"),
        F.when(known, _first_step(F.col("level"), t, F.lit(error_threshold), horizon, True)).alias("time_to_failure"),
        F.when(known, F.col("level") + horizon * t).alias("predicted_rate"), F.col("last_value").alias("current_rate"),
        F.when(~known, "unknown").when(t > 0.001, "increasing").when(t < -0.001, "decreasing").otherwise("stable").alias("trend"),
        F.when(known, t).otherwise(0.0).alias("trend_value"),
        F.when(~known, 0.0).when(F.col("n") > 100, 0.8).otherwise(0.5).alias("confidence"))


def capacity_forecast(metrics: DataFrame, limits: dict[str, float] | None = None, horizon: int = 24) -> DataFrame:
    """Utilisation now and at the horizon, and the first step at the limit, per metric (series).
    A metric without a limit is never exhausted."""
    named = F.create_map(*[F.lit(x) for kv in (limits or fixed.CAPACITY_LIMITS).items() for x in kv])
    s = holt_state(metrics).withColumn("capacity_limit", F.try_element_at(named, F.col("series")))
    lim, later = F.col("capacity_limit"), F.col("level") + horizon * F.col("trend")
    return s.select(
        F.col("series").alias("metric"), F.when(F.col("fitted"), "ok").otherwise("no_data").alias("status"),
        F.col("last_value").alias("current_value"), F.coalesce(F.col("last_value") / lim, F.lit(0.0)).alias("current_utilization"),
        later.alias("predicted_value"), F.coalesce(later / lim, F.lit(0.0)).alias("predicted_utilization"), "capacity_limit",
        F.when(F.col("fitted"), _first_step(F.col("level"), F.col("trend"), lim, horizon, False)).alias("hours_to_exhaustion"),
        F.when(F.col("trend") > 0, "increasing").otherwise("stable").alias("trend"), F.col("trend").alias("growth_rate"))


def recent_alerts(alerts: DataFrame, now: dt.datetime, hours: int = 168) -> DataFrame:
    return alerts.filter(F.col("ts") > F.lit(now - dt.timedelta(hours=hours)).cast("timestamp"))


def alert_forecast(alerts: DataFrame, now: dt.datetime, horizon: int = 24) -> dict[str, DataFrame]:
    """by_type: expected alerts from the last-24-hour rate; total; peak_hours: top 3 positions;
    hourly: seasonal factor of each coming hour. Input columns: type, ts."""
    kept = recent_alerts(alerts, now)
    day = F.col("ts") > F.lit(now - dt.timedelta(hours=24)).cast("timestamp")
    by_type = kept.groupBy("type").agg((F.count_if(day) / 24.0).alias("recent_rate")).withColumn(
        "expected_count", F.col("recent_rate") * horizon)
    series = hourly_counts(kept, "ts").withColumn("series", F.lit("alerts"))
    factors = seasonal(series, 24)
    peaks = factors.orderBy(F.col("factor").desc(), "position").limit(3)
    coming = alerts.sparkSession.range(horizon).select(
        (F.col("id") + 1).cast("int").alias("step"), F.pmod(F.lit(now.hour) + F.col("id"), F.lit(24)).cast("int").alias("position"))
    hourly = coming.join(factors.select("position", "factor"), "position", "left").select(
        "step", "position", F.coalesce("factor", F.lit(0.0)).alias("expected"))
    return {"by_type": by_type, "total": by_type.agg(F.sum("expected_count").alias("total_expected_alerts")),
            "peak_hours": peaks, "hourly": hourly}


FACTOR_WEIGHTS = {"critical": 1.0, "high": 0.7, "medium": 0.4, "low": 0.2}


def risk_factors(failure: DataFrame, capacity: DataFrame) -> DataFrame:
    """factor, severity, value rows from the failure and capacity forecasts."""
    high = F.col("failure_probability") > 0.7
    a = failure.filter(high | (F.col("trend") == "increasing")).select(
        F.when(high, "high_failure_probability").otherwise("increasing_error_trend").alias("factor"),
        F.when(high, "critical").otherwise("medium").alias("severity"),
        F.when(high, F.col("failure_probability")).otherwise(F.col("trend_value")).alias("value"))
    soon = F.coalesce(F.col("hours_to_exhaustion") < 24, F.lit(False))
    b = capacity.filter(soon | (F.col("predicted_utilization") > 0.8)).select(
        F.concat("metric", F.when(soon, "_exhaustion").otherwise("_high_utilization")).alias("factor"),
        F.when(soon, "high").otherwise("medium").alias("severity"),
        F.when(soon, F.col("hours_to_exhaustion").cast("double")).otherwise(F.col("predicted_utilization")).alias("value"))
    return a.unionByName(b)


def overall_risk(factors: DataFrame) -> DataFrame:
    """One row: score, level, number of factors, at most 5 sorted recommendation codes."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in FACTOR_WEIGHTS.items() for x in kv]), F.col("severity"))
    f = F.col("factor")
    metric = F.regexp_replace(f, "_exhaustion$", "")
    codes = (F.when(f.contains("failure_probability"), F.array(F.lit("review_error_logs"), F.lit("scale_up")))
             .when(f.contains("exhaustion"), F.array(F.concat(F.lit("increase_"), metric), F.concat(F.lit("clean_up_"), metric)))
             .when(f.contains("utilization"), F.array(F.lit("monitor_utilization"), F.lit("plan_expansion")))
             .otherwise(F.array(F.lit("investigate_errors"), F.lit("review_deployments"))))
    per = factors.select(weight.alias("w"), "factor", codes.alias("c"))
    score = per.agg(F.coalesce(F.max("w"), F.lit(0.0)).alias("risk_score"), F.count(F.lit(1)).alias("factors")).withColumn("_k", F.lit(1))
    best = (per.select(F.explode_outer("c").alias("code")).filter("code IS NOT NULL").distinct().orderBy("code").limit(5)
            .agg(F.sort_array(F.collect_list("code")).alias("recommendations")).withColumn("_k", F.lit(1)))
    s = F.col("risk_score")
    return score.join(best, "_k").drop("_k").withColumn(
        "risk_level", F.when(s >= 0.9, "critical").when(s >= 0.6, "high").when(s >= 0.3, "medium").when(s > 0, "low").otherwise("none"))


def update_series(state: DataFrame, new: DataFrame, alpha: float = 0.3, beta: float = 0.1, slow: float = 0.01) -> DataFrame:
    """Folds new points onto a stored state (series, level, trend, baseline). An unknown series
    starts at its first new value with trend 0 and that value as baseline."""
    known = F.col("level").isNotNull()
    joined = _composed(new, alpha, beta, slow).join(state, "series", "left")
    start = F.when(known, F.struct("level", "trend")).otherwise(F.struct(F.col("first").alias("level"), F.lit(0.0).alias("trend")))
    base = _fold(F.when(known, F.col("baseline")).otherwise(F.col("first")), ~known, lambda s, m: m["sk"] * s + m["sv"])
    out = joined.select("series", _fold(start, ~known, _holt_map).alias("_s"), base.alias("baseline")).select(
        "series", "_s.level", "_s.trend", "baseline")
    return out.unionByName(state.join(new.select("series").distinct(), "series", "left_anti")
                           .select("series", "level", "trend", "baseline"))
