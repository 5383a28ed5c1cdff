"""Anomaly features, statistical and temporal baselines, heuristics and window rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import fixed
from logloom.functions.text import contains_any, count_contained
from logloom.scale import bucket_of, exact_quantiles, lagged

HIGH = ("ERROR", "CRITICAL", "FATAL")


#: What the isolation forest looks at.
FOREST_COLUMNS = ["count", "frequency", "severity_level", "message_length", "template_bucket"]


def frequency_features(logs: DataFrame) -> DataFrame:
    """id with count, frequency (share of the service's rows), severity level, message length and
    template id mod 1000. Counts come from the template groups."""
    groups = logs.groupBy("service_name", "template_hash").agg(F.count(F.lit(1)).alias("count"))
    totals = groups.groupBy("service_name").agg(F.sum("count").alias("_all"))
    stats = groups.join(totals, "service_name").withColumn("frequency", F.col("count") / F.col("_all")).drop("_all")
    return logs.join(stats, ["service_name", "template_hash"]).select(
        "id", F.col("count").cast("double").alias("count"), "frequency",
        F.col("severity").cast("double").alias("severity_level"),
        F.length("body_raw").cast("double").alias("message_length"),
        F.pmod("template_hash", F.lit(1000)).cast("double").alias("template_bucket"))


def severity_ratios(logs: DataFrame, by: list[str]) -> DataFrame:
    """Share of error (4), warning (3), critical (5), info (2) and debug (0 and 1) rows per group."""
    def share(cond: Column) -> Column:
        return F.avg(cond.cast("double"))

    sev = F.col("severity")
    return logs.groupBy(*by).agg(share(sev == 4).alias("error_ratio"), share(sev == 3).alias("warning_ratio"),
                                 share(sev == 5).alias("critical_ratio"), share(sev == 2).alias("info_ratio"),
                                 share(sev < 2).alias("debug_ratio"))


def template_mix(logs: DataFrame, by: list[str]) -> DataFrame:
    """Unique-template ratio, entropy of the template shares (bits), share of the top template."""
    counts = logs.groupBy(*by, "template_hash").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    p = F.col("_n") / F.col("_all")
    return counts.join(totals, by).groupBy(*by).agg(
        (F.count(F.lit(1)) / F.max("_all")).alias("unique_template_ratio"),
        (-F.sum(p * F.log2(p + 1e-10))).alias("template_entropy"), F.max(p).alias("top_template_concentration"))


def arrival_features(logs: DataFrame, by: list[str]) -> DataFrame:
    """Mean and deviation of the seconds between rows, and the share below max(mean / 10, 1 s).
    Gaps of a hot group are taken in slots of ten seconds with the last row before the slot carried in."""
    rows = logs.select(*by, "timestamp_utc", "id", F.unix_micros("timestamp_utc").alias("_us"))
    seq = lagged(rows, by, ["timestamp_utc", "id"], bucket_of(F.col("_us"), 10_000_000), F.col("_us"), 1)
    gaps = seq.filter(F.col("prev_1").isNotNull()).select(*by, ((F.col("_us") - F.col("prev_1")) / 1e6).alias("_gap"))
    stats = gaps.groupBy(*by).agg(F.avg("_gap").alias("inter_arrival_mean"), F.stddev_pop("_gap").alias("inter_arrival_std"))
    short = F.col("_gap") < F.greatest(F.col("inter_arrival_mean") * 0.1, F.lit(1.0))
    burst = gaps.join(stats, by).groupBy(*by).agg(F.avg(short.cast("double")).alias("burst_score"))
    out = logs.select(*by).distinct().join(stats, by, "left").join(burst, by, "left")
    return out.na.fill(0.0, ["inter_arrival_mean", "inter_arrival_std", "burst_score"])


def stat_baseline(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, std, median, mad, q1, q3, iqr, min, max, sample_count per group; quantiles are exact."""
    basic = df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_pop(value) + 1e-8).alias("std"),
                                F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"),
                                F.count(value).alias("sample_count"))
    q = exact_quantiles(df, by, value, [0.25, 0.5, 0.75])
    deviations = (df.select(*by, value).join(q.select(*by, "q_1"), by)
                  .withColumn("_dev", F.abs(F.col(value) - F.col("q_1"))))
    mad = exact_quantiles(deviations, by, "_dev", [0.5]).withColumnRenamed("q_0", "_mad")
    return basic.join(q, by).join(mad, by).select(
        *by, "mean", "std", F.col("q_1").alias("median"), (F.col("_mad") + 1e-8).alias("mad"),
        F.col("q_0").alias("q1"), F.col("q_2").alias("q3"), (F.col("q_2") - F.col("q_0")).alias("iqr"),
        "min", "max", "sample_count")


def stat_detect(df: DataFrame, baseline: DataFrame, by: list[str], value: str, z_threshold: float = 3.0,
                iqr_multiplier: float = 1.5) -> DataFrame:
    """Adds z_score, modified_z_score, iqr_deviation, anomaly_confidence and is_anomaly (2 votes
    of 3). A group without a baseline is not anomalous."""
    v = F.col(value)
    b = baseline.select(*by, *[F.col(c).alias(f"_{c}") for c in ("mean", "std", "median", "mad", "q1", "q3", "iqr")])
    out = df.join(b, by, "left")
    out = (out.withColumn("z_score", F.abs(v - F.col("_mean")) / F.col("_std"))
           .withColumn("modified_z_score", 0.6745 * F.abs(v - F.col("_median")) / F.col("_mad"))
           .withColumn("_below", F.col("_q1") - iqr_multiplier * F.col("_iqr") - v)
           .withColumn("_above", v - F.col("_q3") - iqr_multiplier * F.col("_iqr")))
    votes = ((F.col("z_score") > z_threshold).cast("int") + (F.col("modified_z_score") > z_threshold).cast("int")
             + ((F.col("_below") > 0) | (F.col("_above") > 0)).cast("int"))
    out = (out.withColumn("iqr_deviation", F.greatest(F.col("_below"), F.col("_above"), F.lit(0.0)) / (F.col("_iqr") + 1e-8))
           .withColumn("_votes", F.coalesce(votes, F.lit(0)))
           .withColumn("anomaly_confidence", F.col("_votes") / 3.0).withColumn("is_anomaly", F.col("_votes") >= 2))
    return out.drop("_mean", "_std", "_median", "_mad", "_q1", "_q3", "_iqr", "_below", "_above", "_votes")


def temporal_baseline(counts: DataFrame, ts: str = "bucket_ts", value: str = "value") -> DataFrame:
    """kind (hour or weekday, Monday = 0), slot, mean, std, median, p95 over bucket counts."""
    slots = F.array(F.struct(F.lit("hour").alias("kind"), F.hour(ts).alias("slot")),
                    F.struct(F.lit("weekday").alias("kind"), F.weekday(ts).alias("slot")))
    rows = counts.select(F.explode(slots).alias("s"), F.col(value).cast("double").alias("v")).select("s.kind", "s.slot", "v")
    basic = rows.groupBy("kind", "slot").agg(F.avg("v").alias("mean"), (F.stddev_pop("v") + 1e-8).alias("std"))
    q = exact_quantiles(rows, ["kind", "slot"], "v", [0.5, 0.95])
    return basic.join(q, ["kind", "slot"]).select("kind", "slot", "mean", "std", F.col("q_0").alias("median"),
                                                  F.col("q_1").alias("p95"))


def temporal_detect(counts: DataFrame, baseline: DataFrame, ts: str = "bucket_ts", value: str = "value",
                    sensitivity: float = 2.0) -> DataFrame:
    """Adds hourly_deviation, daily_deviation, is_anomaly and anomaly_type (spike or drop)."""
    def side(kind, name):
        b = baseline.filter(F.col("kind") == kind)
        return b.select(F.col("slot").alias(f"_{name}"), F.col("mean").alias(f"_{name}_mean"), F.col("std").alias(f"_{name}_std"))

    v = F.col(value)
    out = (counts.withColumn("_h", F.hour(ts)).withColumn("_d", F.weekday(ts))
           .join(F.broadcast(side("hour", "h")), "_h", "left")        # at most 24 rows
           .join(F.broadcast(side("weekday", "d")), "_d", "left"))    # at most 7 rows

    def deviation(n):
        return F.coalesce(F.abs(v - F.col(f"_{n}_mean")) / F.col(f"_{n}_std"), F.lit(0.0))

    out = out.withColumn("hourly_deviation", deviation("h")).withColumn("daily_deviation", deviation("d"))
    spike = v > F.coalesce(F.col("_h_mean"), v)
    return (out.withColumn("expected_hourly", F.coalesce("_h_mean", v)).withColumn("expected_daily", F.coalesce("_d_mean", v))
            .withColumn("is_anomaly", (F.col("hourly_deviation") > sensitivity) | (F.col("daily_deviation") > sensitivity))
            .withColumn("anomaly_type", F.when(spike, "spike").otherwise("drop"))
            .drop("_h", "_d", "_h_mean", "_h_std", "_d_mean", "_d_std"))


# --- rows -------------------------------------------------------------------------------
def heuristic_anomaly(logs: DataFrame, severity_name: str, message: str = "body_raw") -> DataFrame:
    """Adds is_anomaly, anomaly_type, anomaly_score by severity name, else by error words."""
    sev = F.upper(F.coalesce(F.col(severity_name), F.lit("INFO")))
    high = sev.isin(*HIGH)
    out = logs.withColumn("_low", F.lower(F.col(message))).withColumn("_m", count_contained(F.col("_low"), fixed.ANOMALY_WORDS))
    score = (F.when(sev == "ERROR", 0.7).when(high, 0.9)
             .when(F.col("_m") > 0, F.least(0.5 + 0.1 * F.col("_m"), F.lit(1.0))).otherwise(0.0))
    kind = F.when(high, "severity").when(F.col("_m") > 0, "pattern").otherwise("normal")
    return (out.withColumn("is_anomaly", high | (F.col("_m") > 0)).withColumn("anomaly_type", kind)
            .withColumn("anomaly_score", score).drop("_low", "_m"))


def boost_anomaly(df: DataFrame, score: str, flagged: str, severity_name: str, message: str = "body_raw") -> DataFrame:
    """Raises a base score for high severity (+0.2, flag above 0.5) and error words (+0.15, flag
    above 0.55); a score above 0.65 is flagged at once."""
    high = F.upper(F.col(severity_name)).isin(*HIGH)
    words = contains_any(F.lower(F.col(message)), fixed.BOOST_WORDS)
    one = F.lit(1.0)
    out = df.withColumn("_a", F.when(high, F.least(F.col(score) + 0.2, one)).otherwise(F.col(score)))
    out = out.withColumn("_b", F.when(words, F.least(F.col("_a") + 0.15, one)).otherwise(F.col("_a")))
    flag = (F.col(flagged) | (F.col(score) > 0.65) | (high & (F.col("_a") > 0.5)) | (words & (F.col("_b") > 0.55)))
    return out.withColumn("boosted_score", F.col("_b")).withColumn("boosted_anomaly", flag).drop("_a", "_b")


def anomaly_type(severity_name: Column, message: Column) -> Column:
    low = F.lower(message)
    return (F.when(F.upper(severity_name).isin(*HIGH), "severity").when(contains_any(low, fixed.FREQUENCY_WORDS), "frequency")
            .when(contains_any(low, fixed.NOVELTY_WORDS), "pattern").otherwise("statistical"))


def contributing_factors(severity_name: Column, message: Column, template: Column) -> Column:
    def factor(name, value, weight):
        return F.struct(F.lit(name).alias("factor"), value.alias("value"), F.lit(weight).alias("contribution"))

    return F.array_compact(F.array(
        F.when(F.upper(severity_name).isin(*HIGH), factor("severity", F.upper(severity_name), 0.4)),
        F.when(F.length(message) > 500, factor("message_length", F.length(message).cast("string"), 0.2)),
        F.when(template != "", factor("template", F.substring(template, 1, 100), 0.3))))


# --- window rules -----------------------------------------------------------------------
def rule_anomalies(logs: DataFrame, templates: DataFrame) -> DataFrame:
    """Rule findings (rule, kind, severity, affected, confidence) for the rows given, most severe
    first; one healthy row when no rule fires."""
    keys = ["tenant_id", "service_name", "template_hash"]
    per = logs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") >= 4).alias("errors"),
        F.count_if(F.col("severity") == 3).alias("warnings"))
    text = templates.select(*keys, F.lower("template_text").alias("low"))
    per = per.join(text, keys, "left")
    low = F.coalesce(F.col("low"), F.lit(""))
    groups = {"error": ["error", "exception", "fatal"], "fail": ["fail", "denied", "refused"],
              "timeout": ["timeout", "timed out"]}
    aggs = []
    for name, words in groups.items():
        hit = contains_any(low, words)
        aggs += [F.count_if(hit).alias(f"{name}_k"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(f"{name}_n")]
    stats = per.agg(F.sum("n").alias("total"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"),
                    F.count(F.lit(1)).alias("kinds"), F.max("n").alias("top"), *aggs).withColumn("_k", F.lit(1))
    five = per.orderBy(F.col("n").desc(), *keys).limit(5).agg(F.sum("n").alias("top5")).withColumn("_k", F.lit(1))
    s = stats.join(five, "_k").na.fill(0)

    def pct(c):
        return F.when(F.col("total") > 0, F.col(c) / F.col("total") * 100).otherwise(0.0)

    def level(value, steps, last):
        out = F.when(F.lit(False), "")
        for limit, name in steps:
            out = out.when(value > limit, name)
        return out.otherwise(last)

    def found(cond, rule, kind, severity, affected, confidence):
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), severity.alias("severity"),
                                     F.col(affected).cast("bigint").alias("affected"),
                                     confidence.cast("double").alias("confidence")))

    err, warn, top, five_pct = pct("errors"), pct("warnings"), pct("top"), pct("top5")
    c = F.col
    rules = [
        found(c("errors") > 0, "error_rate", "error_burst", level(err, [(15, "critical"), (8, "high"), (3, "medium")], "low"),
              "errors", F.least(F.lit(98.0), 75 + err * 1.5)),
        found(c("warnings") > 100, "warning_rate", "frequency", level(warn, [(25, "high"), (15, "medium")], "low"),
              "warnings", F.lit(82)),
        found(top > 30, "dominant_template", "spike", level(top, [(60, "critical"), (45, "high")], "medium"), "top", F.lit(92)),
        found((five_pct > 80) & (c("kinds") > 5), "concentration", "frequency", F.lit("medium"), "top5", F.lit(78)),
        found(c("error_k") > 0, "error_templates", "new_pattern", level(c("error_n"), [(5000, "critical"), (1000, "high")], "medium"),
              "error_n", F.lit(94)),
        found(c("fail_k") > 0, "failure_templates", "new_pattern", level(c("fail_n"), [(2000, "high"), (500, "medium")], "low"),
              "fail_n", F.lit(88)),
        found(c("timeout_k") > 0, "timeout_templates", "drop", level(c("timeout_n"), [(1000, "high"), (200, "medium")], "low"),
              "timeout_n", F.lit(86)),
        found(c("total") > 10000, "volume", "spike", level(c("total"), [(5000000, "high"), (1000000, "medium")], "low"),
              "total", F.lit(99)),
        found((c("kinds") == 1) & (c("total") > 100), "low_diversity", "drop", F.lit("medium"), "total", F.lit(85)),
        found(c("kinds") > 500, "high_diversity", "frequency", F.lit("low"), "total", F.lit(72)),
    ]
    healthy = F.array(F.struct(F.lit("healthy").alias("rule"), F.lit("frequency").alias("kind"), F.lit("low").alias("severity"),
                               F.lit(0).cast("bigint").alias("affected"), F.lit(95.0).alias("confidence")))
    out = s.withColumn("_f", F.array_compact(F.array(*rules)))
    out = out.select(F.explode_outer(F.when(F.size("_f") > 0, F.col("_f")).otherwise(healthy)).alias("f")).select("f.*")
    order = F.array_position(F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low")]), F.col("severity"))
    return out.orderBy(order, "rule")
