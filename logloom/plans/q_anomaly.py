"""Registered queries: anomaly features, baselines, rules and the isolation forest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from logloom import fixed
from logloom.functions.labels import model_severity_name
from logloom.operators import anomaly as A
from logloom.operators import forest
from logloom.plans.logview import ISO_SQL, TEMPLATES_SQL, more, ts_text, with_logs
from logloom.plans.q_functions import sql_any
from logloom.plans.registry import query
from logloom.session import materialize

SVC = ["service_name"]
NAME_SQL = "CASE severity WHEN 5 THEN 'CRITICAL' WHEN 4 THEN 'ERROR' WHEN 3 THEN 'WARNING' WHEN 2 THEN 'INFO' ELSE 'DEBUG' END"


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("frequency_features", with_logs("""
SELECT id, count(*) OVER (PARTITION BY service_name, masked)::DOUBLE AS count,
  round(count(*) OVER (PARTITION BY service_name, masked) / count(*) OVER (PARTITION BY service_name), 6) AS frequency,
  severity::DOUBLE AS severity_level, length(body_raw)::DOUBLE AS message_length FROM logs"""))
def _(t):
    return rounded(A.frequency_features(t.logs).drop("template_bucket"), "frequency")


@query("severity_ratios", with_logs("SELECT service_name, " + ", ".join(
    f"round(avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS {n}_ratio" for n, c in (
        ("error", "severity = 4"), ("warning", "severity = 3"), ("critical", "severity = 5"), ("info", "severity = 2"),
        ("debug", "severity < 2"))) + " FROM logs GROUP BY service_name"))
def _(t):
    return rounded(A.severity_ratios(t.logs, SVC), *[f"{n}_ratio" for n in ("error", "warning", "critical", "info", "debug")])


@query("template_mix", with_logs("""
SELECT service_name, round(count(*) / max(total), 6) AS unique_template_ratio, round(-sum(n / total * log2(n / total + 1e-10)), 6) AS template_entropy,
  round(max(n / total), 6) AS top_template_concentration FROM (SELECT service_name, masked, count(*) AS n, sum(count(*)) OVER (PARTITION BY service_name) AS total
  FROM logs GROUP BY service_name, masked) GROUP BY service_name"""))
def _(t):
    return rounded(A.template_mix(t.logs, SVC), "unique_template_ratio", "template_entropy", "top_template_concentration")


@query("arrival_features", more("""gaps AS (SELECT service_name, (epoch_us(timestamp_utc) - lag(epoch_us(timestamp_utc)) OVER
  (PARTITION BY service_name ORDER BY timestamp_utc, id)) / 1e6::DOUBLE AS gap FROM logs)""",
 "st AS (SELECT service_name, avg(gap) AS m, stddev_pop(gap) AS s FROM gaps WHERE gap IS NOT NULL GROUP BY service_name)") + """
SELECT service_name, round(any_value(m), 4) AS inter_arrival_mean, round(any_value(s), 4) AS inter_arrival_std,
  round(avg(CASE WHEN gap < greatest(m * 0.1::DOUBLE, 1.0::DOUBLE) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS burst_score
FROM gaps JOIN st USING (service_name) WHERE gap IS NOT NULL GROUP BY service_name""")
def _(t):
    out = A.arrival_features(t.logs, SVC)
    return rounded(rounded(out, "burst_score"), "inter_arrival_mean", "inter_arrival_std", digits=4)


BASE_SQL = """sb AS (SELECT service_name, avg(v) AS mean, stddev_pop(v) + 1e-8::DOUBLE AS std, quantile_cont(v, 0.5) AS median,
  quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, min(v) AS min, max(v) AS max, count(*) AS n FROM lv GROUP BY service_name)"""
LV = "lv AS (SELECT id, service_name, length(body_raw)::DOUBLE + (id % 17)::DOUBLE / 8 AS v FROM logs)"
MAD_SQL = "md AS (SELECT service_name, quantile_cont(abs(v - median), 0.5) + 1e-8::DOUBLE AS mad FROM lv JOIN sb USING (service_name) GROUP BY service_name)"


def _values(t):
    return t.logs.select("id", "service_name", (F.length("body_raw") + (F.col("id") % 17) / 8).cast("double").alias("v"))


@query("stat_baseline", more(LV, BASE_SQL, MAD_SQL) + """
SELECT service_name, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median, round(mad, 6) AS mad, round(q1, 6) AS q1,
  round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, min, max, n AS sample_count FROM sb JOIN md USING (service_name)""")
def _(t):
    return rounded(A.stat_baseline(_values(t), SVC, "v"), "mean", "std", "median", "mad", "q1", "q3", "iqr")


@query("stat_detect", more(LV, BASE_SQL, MAD_SQL, """z AS (SELECT *, abs(v - mean) / std AS z, 0.6745::DOUBLE * abs(v - median) / mad AS mz,
  v < q1 - 1.5::DOUBLE * (q3 - q1) OR v > q3 + 1.5::DOUBLE * (q3 - q1) AS io FROM lv JOIN sb USING (service_name) JOIN md USING (service_name))""") + """
SELECT id, round(z, 4) AS z_score, round(mz, 4) AS modified_z_score, (z > 3)::INT + (mz > 3)::INT + io::INT >= 2 AS is_anomaly,
  round(((z > 3)::INT + (mz > 3)::INT + io::INT) / 3, 6) AS anomaly_confidence FROM z""")
def _(t):
    v = _values(t)
    out = A.stat_detect(v, A.stat_baseline(v, SVC, "v"), SVC, "v")
    out = rounded(rounded(out, "anomaly_confidence"), "z_score", "modified_z_score", digits=4)
    return out.select("id", "z_score", "modified_z_score", "is_anomaly", "anomaly_confidence")


HC = "hc AS (SELECT date_trunc('hour', timestamp_utc) AS b, count(*)::DOUBLE AS v FROM logs GROUP BY 1)"
TB = """tb AS (SELECT 'hour' AS kind, CAST(hour(b) AS INT) AS slot, v FROM hc UNION ALL SELECT 'weekday', CAST(isodow(b) - 1 AS INT), v FROM hc)"""


def _hours(t):
    return t.logs.groupBy(F.date_trunc("hour", "timestamp_utc").alias("bucket_ts")).agg(
        F.count(F.lit(1)).cast("double").alias("value"))


@query("temporal_baseline", more(HC, TB) + """
SELECT kind, slot, round(avg(v), 6) AS mean, round(stddev_pop(v) + 1e-8::DOUBLE, 6) AS std, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.95), 6) AS p95 FROM tb GROUP BY kind, slot""")
def _(t):
    return rounded(A.temporal_baseline(_hours(t)), "mean", "std", "median", "p95")


@query("temporal_detect", more(HC, TB, "b2 AS (SELECT kind, slot, avg(v) AS m, stddev_pop(v) + 1e-8::DOUBLE AS s FROM tb GROUP BY kind, slot)") + f"""
SELECT strftime(b, {ISO_SQL}) AS bucket, v AS value, round(abs(v - h.m) / h.s, 4) AS hourly_deviation, round(abs(v - d.m) / d.s, 4) AS daily_deviation,
  abs(v - h.m) / h.s > 2 OR abs(v - d.m) / d.s > 2 AS is_anomaly, CASE WHEN v > h.m THEN 'spike' ELSE 'drop' END AS anomaly_type
FROM hc JOIN b2 h ON h.kind = 'hour' AND h.slot = hour(b) JOIN b2 d ON d.kind = 'weekday' AND d.slot = isodow(b) - 1""")
def _(t):
    h = _hours(t)
    out = rounded(A.temporal_detect(h, A.temporal_baseline(h)), "hourly_deviation", "daily_deviation", digits=4)
    return out.select(ts_text("bucket_ts").alias("bucket"), "value", "hourly_deviation", "daily_deviation", "is_anomaly", "anomaly_type")


MATCHES = " + ".join(f"contains(lower(body_raw), '{w}')::INT" for w in fixed.ANOMALY_WORDS)
HEUR = f"""heur AS (SELECT id, body_raw, name, name IN ('ERROR', 'CRITICAL') OR m > 0 AS is_anomaly,
  CASE WHEN name IN ('ERROR', 'CRITICAL') THEN 'severity' WHEN m > 0 THEN 'pattern' ELSE 'normal' END AS anomaly_type,
  CASE WHEN name = 'ERROR' THEN 0.7::DOUBLE WHEN name = 'CRITICAL' THEN 0.9::DOUBLE WHEN m > 0 THEN least(0.5::DOUBLE + 0.1::DOUBLE * m, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS score
 FROM (SELECT *, {NAME_SQL} AS name, {MATCHES} AS m FROM logs))"""


def _heuristic(t):
    return A.heuristic_anomaly(t.logs.withColumn("name", model_severity_name(F.col("severity"))), "name")


@query("heuristic_anomaly", more(HEUR) + "SELECT id, is_anomaly, anomaly_type, round(score, 6) AS anomaly_score FROM heur")
def _(t):
    return _heuristic(t).select("id", "is_anomaly", "anomaly_type", F.round("anomaly_score", 6).alias("anomaly_score"))


@query("boost_anomaly", more(HEUR, f"""bo AS (SELECT *, CASE WHEN name IN ('ERROR', 'CRITICAL') THEN least(score + 0.2::DOUBLE, 1.0::DOUBLE) ELSE score END AS a,
  {sql_any('lower(body_raw)', fixed.BOOST_WORDS)} AS w FROM heur)""") + """
SELECT id, round(CASE WHEN w THEN least(a + 0.15::DOUBLE, 1.0::DOUBLE) ELSE a END, 6) AS boosted_score,
  is_anomaly OR score > 0.65 OR (name IN ('ERROR', 'CRITICAL') AND a > 0.5) OR (w AND CASE WHEN w THEN least(a + 0.15::DOUBLE, 1.0::DOUBLE) ELSE a END > 0.55) AS boosted_anomaly
FROM bo""")
def _(t):
    return A.boost_anomaly(_heuristic(t), "anomaly_score", "is_anomaly", "name").select(
        "id", F.round("boosted_score", 6).alias("boosted_score"), "boosted_anomaly")


@query("rule_anomalies", more("""p AS (SELECT tenant_id, service_name, masked, any_value(lower(template_text)) AS low, count(*) AS n,
  count_if(severity >= 4) AS e, count_if(severity = 3) AS w FROM logs GROUP BY ALL)""",
 """s AS (SELECT sum(n)::BIGINT AS total, sum(e)::BIGINT AS errors, sum(w)::BIGINT AS warnings, count(*) AS kinds, max(n) AS top,
  (SELECT sum(n)::BIGINT FROM (SELECT n FROM p ORDER BY n DESC LIMIT 5)) AS top5,
  coalesce(sum(n) FILTER (contains(low, 'error') OR contains(low, 'exception') OR contains(low, 'fatal')), 0)::BIGINT AS en,
  coalesce(sum(n) FILTER (contains(low, 'fail') OR contains(low, 'denied') OR contains(low, 'refused')), 0)::BIGINT AS fn,
  coalesce(sum(n) FILTER (contains(low, 'timeout') OR contains(low, 'timed out')), 0)::BIGINT AS tn FROM p)""",
 """r AS (SELECT 'error_rate' AS rule, 'error_burst' AS kind, CASE WHEN errors / total * 100 > 15 THEN 'critical' WHEN errors / total * 100 > 8 THEN 'high' WHEN errors / total * 100 > 3 THEN 'medium' ELSE 'low' END AS severity,
   errors AS affected, least(98.0::DOUBLE, 75 + errors / total * 100 * 1.5::DOUBLE) AS confidence FROM s WHERE errors > 0
 UNION ALL SELECT 'warning_rate', 'frequency', CASE WHEN warnings / total * 100 > 25 THEN 'high' WHEN warnings / total * 100 > 15 THEN 'medium' ELSE 'low' END, warnings, 82 FROM s WHERE warnings > 100
 UNION ALL SELECT 'dominant_template', 'spike', CASE WHEN top / total * 100 > 60 THEN 'critical' WHEN top / total * 100 > 45 THEN 'high' ELSE 'medium' END, top, 92 FROM s WHERE top / total * 100 > 30
 UNION ALL SELECT 'concentration', 'frequency', 'medium', top5, 78 FROM s WHERE top5 / total * 100 > 80 AND kinds > 5
 UNION ALL SELECT 'error_templates', 'new_pattern', CASE WHEN en > 5000 THEN 'critical' WHEN en > 1000 THEN 'high' ELSE 'medium' END, en, 94 FROM s WHERE en > 0
 UNION ALL SELECT 'failure_templates', 'new_pattern', CASE WHEN fn > 2000 THEN 'high' WHEN fn > 500 THEN 'medium' ELSE 'low' END, fn, 88 FROM s WHERE fn > 0
 UNION ALL SELECT 'timeout_templates', 'drop', CASE WHEN tn > 1000 THEN 'high' WHEN tn > 200 THEN 'medium' ELSE 'low' END, tn, 86 FROM s WHERE tn > 0
 UNION ALL SELECT 'volume', 'spike', CASE WHEN total > 5000000 THEN 'high' WHEN total > 1000000 THEN 'medium' ELSE 'low' END, total, 99 FROM s WHERE total > 10000
 UNION ALL SELECT 'low_diversity', 'drop', 'medium', total, 85 FROM s WHERE kinds = 1 AND total > 100
 UNION ALL SELECT 'high_diversity', 'frequency', 'low', total, 72 FROM s WHERE kinds > 500)""") + """
SELECT rule, kind, severity, affected, round(confidence, 4)::DOUBLE AS confidence FROM r""")
def _(t):
    return A.rule_anomalies(t.logs, t.templates).withColumn("confidence", F.round("confidence", 4))


def _forest(t):
    f = materialize(A.frequency_features(t.wide_logs), "features")  # read by the fit and the scoring
    return f, forest.forest_fit(f, A.FOREST_COLUMNS)


def _scored(t):
    f = materialize(A.frequency_features(t.wide_logs), "features")
    return forest.forest_fit_score(f, A.FOREST_COLUMNS)[1]


@query("forest_score")
def _(t):
    return _scored(t).select("id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@query("detect_anomalies")
def _(t):
    return forest.explained(t.logs, _scored(t)).select(
        "id", "is_anomaly", F.round("anomaly_score", 6).alias("anomaly_score"), "anomaly_type",
        F.round("anomaly_confidence", 6).alias("anomaly_confidence"), F.size("factors").alias("factors"))


#: Two small trees over severity and length of the message: tree, node, feature, threshold, left, right, size, depth.
GIVEN_TREES = [(0, 0, 0, 2.5, 1, 2, 256, 0), (0, 1, -1, 0.0, -1, -1, 120, 1), (0, 2, 1, 60.0, 3, 4, 136, 1), (0, 3, -1, 0.0, -1, -1, 30, 2),
               (0, 4, -1, 0.0, -1, -1, 1, 2), (1, 0, 1, 40.0, 1, 2, 256, 0), (1, 1, 0, 1.0, 3, 4, 166, 1), (1, 2, -1, 0.0, -1, -1, 90, 1),
               (1, 3, -1, 0.0, -1, -1, 64, 2), (1, 4, -1, 0.0, -1, -1, 2, 2)]
GIVEN_SQL = ["gn AS (SELECT * FROM (VALUES " + ", ".join(map(str, GIVEN_TREES)) + ") v(tree, node, feature, threshold, l, r, size, depth))",
             """wk AS (SELECT id, tree, 0 AS node, severity, length(body_raw) AS n FROM logs, (SELECT DISTINCT tree FROM gn)
 UNION ALL SELECT id, wk.tree, CASE WHEN CASE feature WHEN 0 THEN severity ELSE n END < threshold THEN l ELSE r END, severity, n
 FROM wk JOIN gn ON gn.tree = wk.tree AND gn.node = wk.node WHERE feature >= 0)""",
             "pl AS (SELECT s, CASE WHEN s <= 1 THEN 0 ELSE 2 * (ln(greatest(s, 2) - 1) + 0.5772156649::DOUBLE) - 2 * (greatest(s, 2) - 1) / greatest(s, 2)::DOUBLE END AS c FROM (SELECT size AS s FROM gn UNION SELECT 256))",
             """gs AS (SELECT id, power(2, -avg(depth + c) / (SELECT c FROM pl WHERE s = 256)) AS score FROM wk JOIN gn ON gn.tree = wk.tree AND gn.node = wk.node
 JOIN pl ON pl.s = size WHERE feature < 0 GROUP BY id)"""]


@query("forest_score_given", more(*GIVEN_SQL) + "SELECT id, round(score, 6) AS anomaly_score, score > 0.45 AS is_anomaly FROM gs")
def _(t):
    nodes = pd.DataFrame(GIVEN_TREES, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])
    model = forest.ForestModel(nodes, ["severity", "_len"], np.zeros(2), np.ones(2), 256, 0.45)
    rows = t.wide_logs.withColumn("_len", F.length("body_raw"))
    return forest.forest_score(rows, model).select("id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")
