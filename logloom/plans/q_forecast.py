"""Registered queries: series and forecasts. Series: orders per day by status, log rows per hour
by service, error share per hour by service."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from logloom.operators import forecast as K
from logloom.plans.logview import ISO_SQL, more, ts_text, with_logs
from logloom.plans.q_anomaly import rounded
from logloom.plans.registry import query

DAILY = """d AS (SELECT o_orderstatus AS series, date_trunc('day', o_orderdate) AS b, sum(o_totalprice) / 1000 AS v FROM orders GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY b) AS i, count(*) OVER (PARTITION BY series) AS c FROM d)"""
SES_SQL = """s AS (SELECT series, i, c, v AS level FROM n WHERE i = 1 UNION ALL
 SELECT n.series, n.i, n.c, 0.3::DOUBLE * n.v + 0.7::DOUBLE * s.level FROM s JOIN n ON n.series = s.series AND n.i = s.i + 1)"""


def holt_sql(src="n", name="h"):
    return f"""{name} AS (SELECT a.series, a.i, a.c, a.v AS level, b.v - a.v AS trend, a.v AS last FROM {src} a JOIN {src} b ON a.series = b.series AND b.i = 2 WHERE a.i = 1
 UNION ALL SELECT x.series, x.i, x.c, 0.3::DOUBLE * x.v + 0.7::DOUBLE * ({name}.level + {name}.trend),
  0.1::DOUBLE * (0.3::DOUBLE * x.v + 0.7::DOUBLE * ({name}.level + {name}.trend) - {name}.level) + 0.9::DOUBLE * {name}.trend, x.v
 FROM {name} JOIN {src} x ON x.series = {name}.series AND x.i = {name}.i + 1)"""


def _daily(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("series"), F.date_trunc("day", "o_orderdate").cast("timestamp").alias("bucket_ts")).agg(
        (F.sum("o_totalprice") / 1000).alias("value"))


@query("ses_forecast", f"WITH RECURSIVE {DAILY}, {SES_SQL} SELECT series, CAST(unnest([1, 2, 3]) AS INT) AS step, round(level, 3) AS forecast FROM s WHERE i = c")
def _(t):
    return rounded(K.ses(_daily(t), horizon=3), "forecast", digits=3)


@query("holt_forecast", f"""WITH RECURSIVE {DAILY}, {holt_sql()}
SELECT series, k AS step, round(level + k * trend, 3) AS forecast FROM h, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INT) AS k) WHERE i = c""")
def _(t):
    return rounded(K.holt(_daily(t), horizon=5), "forecast", digits=3)


HOURLY = """hs AS (SELECT service_name AS series, date_trunc('hour', timestamp_utc) AS b, count(*)::DOUBLE AS v, avg(CASE WHEN severity >= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS er
 FROM logs GROUP BY ALL), hn AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY b) AS i, count(*) OVER (PARTITION BY series) AS c FROM hs)"""
FACTORS = """fa AS (SELECT series, position, f - avg(f) OVER (PARTITION BY series) AS factor FROM (SELECT series, CAST((i - 1) % 24 AS INT) AS position, avg(CASE WHEN k = 25 THEN v - m ELSE 0 END) AS f
 FROM (SELECT *, avg(v) OVER w AS m, count(*) OVER w AS k FROM hn WHERE c >= 48 WINDOW w AS (PARTITION BY series ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)) GROUP BY 1, 2))"""


def _hourly(t):
    return K.hourly_counts(t.logs.withColumnRenamed("service_name", "series"), "timestamp_utc", ["series"])


@query("hourly_counts", more(HOURLY) + f"SELECT series, strftime(b, {ISO_SQL}) AS bucket, v AS value FROM hs")
def _(t):
    return _hourly(t).select("series", ts_text("bucket_ts").alias("bucket"), "value")


@query("hourly_counts_filled", more(HOURLY) + """
SELECT series, count(*) AS hours, count(v)::BIGINT AS busy, sum(v) AS total FROM (SELECT g.series, g.b, h.v FROM
 (SELECT series, unnest(generate_series(min(b), max(b), INTERVAL 1 HOUR)) AS b FROM hs GROUP BY series) g LEFT JOIN hs h ON h.series = g.series AND h.b = g.b) GROUP BY series""")
def _(t):
    filled = K.hourly_counts(t.logs.withColumnRenamed("service_name", "series"), "timestamp_utc", ["series"], True)
    return filled.groupBy("series").agg(F.count(F.lit(1)).alias("hours"), F.count_if(F.col("value") > 0).alias("busy"),
                                        F.sum("value").alias("total"))


@query("seasonal_factors", more(HOURLY, FACTORS) + "SELECT series, position, round(factor, 6) AS factor FROM fa")
def _(t):
    return rounded(K.seasonal(_hourly(t)), "factor")


@query("seasonal_outliers", more(HOURLY, FACTORS) + f"""
SELECT hn.series, strftime(b, {ISO_SQL}) AS bucket, v AS value, round(factor, 6) AS factor FROM hn JOIN fa ON fa.series = hn.series AND fa.position = (i - 1) % 24
 JOIN (SELECT series, stddev_pop(factor) AS sd FROM fa GROUP BY series) x ON x.series = hn.series WHERE abs(v - factor) > 2 * sd""")
def _(t):
    h = _hourly(t)
    return rounded(K.seasonal_outliers(h, K.seasonal(h)), "factor").select("series", ts_text("bucket_ts").alias("bucket"), "value", "factor")


RATE = "rn AS (SELECT series, b, i, c, er AS v FROM hn)"
FAIL = f"""fl AS (SELECT h.series, c AS n, level, trend, last, 1 / (1 + exp(-(last - mean) / std)) AS p FROM h JOIN
 (SELECT series, avg(v) AS mean, stddev_pop(v) + 1e-8::DOUBLE AS std FROM rn GROUP BY series) USING (series) WHERE i = c),
fp AS (SELECT *, CASE WHEN trend > 0 THEN least(p * 1.2::DOUBLE, 1.0::DOUBLE) ELSE p END AS fpr,
 CASE WHEN trend > 0.001 THEN 'increasing' WHEN trend < -0.001 THEN 'decreasing' ELSE 'stable' END AS tr FROM fl)"""


def _rates(t):
    return t.logs.groupBy(F.col("service_name").alias("series"), F.date_trunc("hour", "timestamp_utc").alias("bucket_ts")).agg(
        F.avg((F.col("severity") >= 4).cast("double")).alias("value"))


@query("failure_forecast", more(HOURLY, RATE, holt_sql("rn"), FAIL) + """
SELECT series, CAST(n AS INT) AS n, round(fpr, 6) AS failure_probability,
 (SELECT CAST(min(k) AS INT) FROM range(1, 61) r(k) WHERE level + k * trend > 0.1) AS time_to_failure,
 round(level + 60 * trend, 6) AS predicted_rate, round(last, 6) AS current_rate, tr AS trend, round(trend, 6) AS trend_value,
 CASE WHEN n > 100 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM fp""")
def _(t):
    return rounded(K.failure_forecast(_rates(t)), "failure_probability", "predicted_rate", "current_rate", "trend_value")


CAP = "cn AS (SELECT series, b, i, c, sum(v) OVER (PARTITION BY series ORDER BY i) AS v FROM hn)"
CAP_OUT = """cp AS (SELECT series AS metric, last, level, trend, lim, level + 24 * trend AS later,
 (SELECT CAST(min(k) AS INT) FROM range(1, 25) r(k) WHERE level + k * trend >= lim) AS hours FROM h2 JOIN (VALUES ('sshd', 2010.0::DOUBLE), ('nginx', 2500.0::DOUBLE), ('mysql', 2030.0::DOUBLE), ('kernel', 2200.0::DOUBLE), ('app', 3000.0::DOUBLE)) l(series, lim) USING (series) WHERE i = c)"""
CAP_LIMITS = {"sshd": 2010.0, "nginx": 2500.0, "mysql": 2030.0, "kernel": 2200.0, "app": 3000.0}


def _volumes(t):
    from pyspark.sql import Window as W
    h = _hourly(t)
    return h.withColumn("value", F.sum("value").over(W.partitionBy("series").orderBy("bucket_ts").rowsBetween(W.unboundedPreceding, 0)))


@query("capacity_forecast", more(HOURLY, CAP, holt_sql("cn", "h2"), CAP_OUT) + """
SELECT metric, round(last, 4) AS current_value, round(last / lim, 6) AS current_utilization, round(later, 4) AS predicted_value,
 round(later / lim, 6) AS predicted_utilization, lim AS capacity_limit, hours AS hours_to_exhaustion,
 CASE WHEN trend > 0 THEN 'increasing' ELSE 'stable' END AS trend FROM cp""")
def _(t):
    out = K.capacity_forecast(_volumes(t), CAP_LIMITS)
    out = rounded(rounded(out, "current_utilization", "predicted_utilization"), "current_value", "predicted_value", digits=4)
    return out.select("metric", "current_value", "current_utilization", "predicted_value", "predicted_utilization",
                      "capacity_limit", "hours_to_exhaustion", "trend")


NOW = dt.datetime(2024, 1, 30, 12, 0, 0)
ALERTS = "al AS (SELECT event_type AS type, ts FROM events WHERE ts > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 168 HOUR)"
ALERT_N = """hn AS (SELECT 'alerts' AS series, b, v, row_number() OVER (ORDER BY b) AS i, count(*) OVER () AS c FROM
 (SELECT date_trunc('hour', ts) AS b, count(*)::DOUBLE AS v FROM al GROUP BY 1))"""


def _alerts(t):
    return K.alert_forecast(t.events.select(F.col("event_type").alias("type"), F.col("ts").cast("timestamp").alias("ts")), NOW)


@query("alert_forecast", f"""WITH {ALERTS} SELECT type, round(count_if(ts > TIMESTAMP '2024-01-29 12:00:00') / 24, 6) AS recent_rate,
 round(count_if(ts > TIMESTAMP '2024-01-29 12:00:00') / 24 * 24, 6) AS expected_count FROM al GROUP BY type""")
def _(t):
    return rounded(_alerts(t)["by_type"], "recent_rate", "expected_count")


@query("alert_peak_hours", f"WITH {ALERTS}, {ALERT_N}, {FACTORS} SELECT position, round(factor, 6) AS factor FROM fa ORDER BY fa.factor DESC, position LIMIT 3")
def _(t):
    return rounded(_alerts(t)["peak_hours"].select("position", "factor"), "factor")


@query("alert_hourly_forecast", f"""WITH {ALERTS}, {ALERT_N}, {FACTORS}
SELECT CAST(k AS INT) AS step, CAST((12 + k - 1) % 24 AS INT) AS position, round(factor, 6) AS expected FROM range(1, 25) r(k) JOIN fa ON position = (12 + k - 1) % 24""")
def _(t):
    return rounded(_alerts(t)["hourly"], "expected")


FACTOR_SQL = """rf AS (SELECT CASE WHEN fpr > 0.7 THEN 'high_failure_probability' ELSE 'increasing_error_trend' END AS factor,
 CASE WHEN fpr > 0.7 THEN 'critical' ELSE 'medium' END AS severity FROM fp WHERE fpr > 0.7 OR tr = 'increasing'
 UNION ALL SELECT concat(metric, CASE WHEN coalesce(hours < 24, false) THEN '_exhaustion' ELSE '_high_utilization' END),
 CASE WHEN coalesce(hours < 24, false) THEN 'high' ELSE 'medium' END FROM cp WHERE coalesce(hours < 24, false) OR later / lim > 0.8)"""


def _factors(t):
    return K.risk_factors(K.failure_forecast(_rates(t)), K.capacity_forecast(_volumes(t), CAP_LIMITS))


@query("risk_factors", more(HOURLY, RATE, holt_sql("rn"), FAIL, CAP, holt_sql("cn", "h2"), CAP_OUT, FACTOR_SQL) + "SELECT factor, severity FROM rf")
def _(t):
    return _factors(t).select("factor", "severity")


@query("overall_risk", more(HOURLY, RATE, holt_sql("rn"), FAIL, CAP, holt_sql("cn", "h2"), CAP_OUT, FACTOR_SQL, """
rc AS (SELECT DISTINCT unnest(CASE WHEN contains(factor, 'failure_probability') THEN ['review_error_logs', 'scale_up']
 WHEN contains(factor, 'exhaustion') THEN ['increase_' || replace(factor, '_exhaustion', ''), 'clean_up_' || replace(factor, '_exhaustion', '')]
 WHEN contains(factor, 'utilization') THEN ['monitor_utilization', 'plan_expansion'] ELSE ['investigate_errors', 'review_deployments'] END) AS code FROM rf)""") + """
SELECT *, CASE WHEN risk_score >= 0.9 THEN 'critical' WHEN risk_score >= 0.6 THEN 'high' WHEN risk_score >= 0.3 THEN 'medium' WHEN risk_score > 0 THEN 'low' ELSE 'none' END AS risk_level,
 (SELECT coalesce(string_agg(code, ',' ORDER BY code), '') FROM (SELECT code FROM rc ORDER BY code LIMIT 5)) AS recommendations
FROM (SELECT coalesce(max(CASE severity WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN 0.7::DOUBLE WHEN 'medium' THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END), 0.0::DOUBLE) AS risk_score, count(*) AS factors FROM rf)""")
def _(t):
    return K.overall_risk(_factors(t)).withColumn("recommendations", F.array_join("recommendations", ","))


@query("update_series", f"""WITH RECURSIVE {DAILY}, {holt_sql()} SELECT series, round(level, 3) AS level, round(trend, 6) AS trend FROM h WHERE i = c""")
def _(t):
    from pyspark.sql import Window as W
    d = _daily(t).withColumn("_i", F.row_number().over(W.partitionBy("series").orderBy("bucket_ts")))
    old, new = d.filter("_i <= 100").drop("_i"), d.filter("_i > 100").drop("_i")
    state = K.holt_state(old).select("series", "level", "trend", F.lit(0.0).alias("baseline"))
    return K.update_series(state, new).select("series", F.round("level", 3).alias("level"), F.round("trend", 6).alias("trend"))
