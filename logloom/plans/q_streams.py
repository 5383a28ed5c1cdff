"""Registered queries: ingest of rows into tables, and streams over the events file."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from logloom.operators import forecast
from logloom.plans.logview import ISO_SQL, log_view, more, ts_text, with_logs
from logloom.plans.q_functions import FAILURE_SQL, SOURCE_SQL, TARGET_SQL
from logloom.plans.q_templates import MINED
from logloom.plans.registry import query
from logloom.session import scratch_path
from logloom.sources import ingest, parsers, tables
from logloom.streaming import jobs

NOW = dt.datetime(2024, 2, 1)
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def _stream(t):
    spark = t.spark
    schema = t.events.schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return log_view(raw)


def _run(t, stream, keys):
    path, check = scratch_path(t.spark, "stream"), scratch_path(t.spark, "check")
    jobs.run_to_table(stream, keys, path, check)
    return jobs.read_latest(t.spark, keys, path)


@query("stream_trend", with_logs(f"""
SELECT strftime(date_trunc('hour', timestamp_utc), {ISO_SQL}) AS hour, count(*) AS count, count_if(severity >= 4)::BIGINT AS errors FROM logs GROUP BY 1"""))
def _(t):
    return _run(t, jobs.stream_trend(_stream(t)), ["hour"]).withColumn("hour", ts_text("hour"))


@query("stream_health", with_logs(f"""
SELECT strftime(date_trunc('hour', timestamp_utc), {ISO_SQL}) AS hour, service_name, count(*) AS total_logs, count_if(severity >= 4)::BIGINT AS errors,
 count_if(severity = 3)::BIGINT AS warnings FROM logs GROUP BY 1, 2"""))
def _(t):
    return _run(t, jobs.stream_health(_stream(t)), ["hour", "service_name"]).withColumn("hour", ts_text("hour"))


def _slides(minutes, step):
    return f"unnest(generate_series(time_bucket(INTERVAL {step} MINUTE, timestamp_utc) - INTERVAL {minutes - step} MINUTE, time_bucket(INTERVAL {step} MINUTE, timestamp_utc), INTERVAL {step} MINUTE))"


@query("stream_bruteforce", more(f"f AS (SELECT {SOURCE_SQL} AS source, {_slides(360, 120)} AS ws FROM logs WHERE {FAILURE_SQL})") + f"""
SELECT strftime(ws, {ISO_SQL}) AS window_start, source, count(*) AS failure_count, count(*) > 2 AS is_brute_force FROM f GROUP BY ws, source""")
def _(t):
    s = jobs.stream_bruteforce(_stream(t), "6 hours", "2 hours", 2)
    return _run(t, s, ["window_start", "source"]).withColumn("window_start", ts_text("window_start"))


@query("stream_recon", more(f"f AS (SELECT {SOURCE_SQL} AS source, {TARGET_SQL} AS target, {_slides(720, 360)} AS ws FROM logs)") + f"""
SELECT strftime(ws, {ISO_SQL}) AS window_start, source, count(DISTINCT target) AS unique_targets, count(DISTINCT target) >= 3 AS is_recon
FROM f WHERE target IS NOT NULL GROUP BY ws, source""")
def _(t):
    s = jobs.stream_recon(_stream(t), "12 hours", "6 hours", 3)
    return _run(t, s, ["window_start", "source"]).withColumn("window_start", ts_text("window_start"))


def _ticked(t, days=400):
    """The stream with one row of a source of its own far behind the others, which lets the watermark pass them all."""
    tick = t.logs.limit(1).withColumn("timestamp_utc", F.expr(f"timestamp_utc + INTERVAL {days} DAYS")).withColumn("service_name", F.lit("tick"))
    bodies = F.explode(F.array(F.lit("Failed password for tick"), F.lit("GET /tick")))
    tick = tick.withColumn("body_raw", bodies)
    path = scratch_path(t.spark, "tick")
    tick.write.parquet(path)
    return _stream(t).unionByName(t.spark.readStream.schema(tick.schema).parquet(path))


@query("stream_bruteforce_events", more(f"f AS (SELECT {SOURCE_SQL} AS source, timestamp_utc AS ts FROM logs WHERE {FAILURE_SQL} AND {SOURCE_SQL} IS NOT NULL)") + """
SELECT source, epoch_us(ts) AS "at", (SELECT count(*) FROM f g WHERE g.source = f.source AND g.ts <= f.ts AND g.ts >= f.ts - INTERVAL 6 HOUR) AS failure_count
FROM (SELECT DISTINCT source, ts FROM f) f""")
def _(t):
    return _run(t, jobs.stream_bruteforce_events(_ticked(t), 6 * 3600), ["source", "at"]).filter("source <> 'tick'")


@query("stream_recon_events", more(f"f AS (SELECT {SOURCE_SQL} AS source, {TARGET_SQL} AS target, timestamp_utc AS ts FROM logs WHERE {TARGET_SQL} IS NOT NULL)") + """
SELECT f.source, epoch_us(f.ts) AS "at", count(DISTINCT g.target) AS unique_targets, count(DISTINCT CASE WHEN starts_with(g.target, 'port:') THEN g.target END) AS port,
 count(DISTINCT CASE WHEN starts_with(g.target, 'path:') THEN g.target END) AS path, count(DISTINCT CASE WHEN starts_with(g.target, 'user:') THEN g.target END) AS user
FROM (SELECT DISTINCT source, ts FROM f) f JOIN f g ON g.source = f.source AND g.ts <= f.ts AND g.ts >= f.ts - INTERVAL 12 HOUR GROUP BY ALL""")
def _(t):
    return _run(t, jobs.stream_recon_events(_ticked(t), 12 * 3600), ["source", "at"]).filter("source <> 'tick'")


@query("stream_templates", more(*MINED, """mp AS (SELECT l.tenant_id, l.service_name, mt.template_text, l.timestamp_utc FROM sh JOIN logs l USING (id) JOIN mt ON mt.service_name = l.service_name
 AND mt.text = array_to_string(list_transform(tk, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' '))""") + f"""
SELECT tenant_id, service_name, template_text, strftime(min(timestamp_utc), {ISO_SQL}) AS first_seen, strftime(max(timestamp_utc), {ISO_SQL}) AS last_seen, count(*) AS rows
FROM mp GROUP BY ALL""")
def _(t):
    path = scratch_path(t.spark, "templates")
    jobs.stream_templates(_stream(t), path, scratch_path(t.spark, "check")).start().awaitTermination()
    return jobs.read_templates(t.spark, path).select("tenant_id", "service_name", "template_text", ts_text("first_seen_utc").alias("first_seen"),
                                                     ts_text("last_seen_utc").alias("last_seen"), "rows")


RUNNING = ["h AS (SELECT service_name AS series, date_trunc('hour', timestamp_utc) AS b, count(*)::DOUBLE AS v FROM logs GROUP BY ALL)",
           "n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY b) AS i, count(*) OVER (PARTITION BY series) AS c FROM h)",
           """s AS (SELECT series, i, c, v AS level, 0::DOUBLE AS trend, v AS baseline FROM n WHERE i = 1 UNION ALL
 SELECT n.series, n.i, n.c, 0.3::DOUBLE * n.v + 0.7::DOUBLE * (s.level + s.trend),
  0.1::DOUBLE * (0.3::DOUBLE * n.v + 0.7::DOUBLE * (s.level + s.trend) - s.level) + 0.9::DOUBLE * s.trend, 0.01::DOUBLE * n.v + 0.99::DOUBLE * s.baseline
 FROM s JOIN n ON n.series = s.series AND n.i = s.i + 1)"""]


@query("stream_update", more(*RUNNING) + """
SELECT series, i AS n, round(level, 6) AS level, round(trend, 6) AS trend, round(baseline, 6) AS baseline FROM s WHERE i = c""")
def _(t):
    """Three batches whose hours are interleaved, so every batch brings rows that belong before those already there."""
    hourly = forecast.hourly_counts(t.logs.withColumnRenamed("service_name", "series"), "timestamp_utc", ["series"])
    path, width = scratch_path(t.spark, "hourly"), "bucket_ts"
    for i in range(3):
        hourly.filter(F.pmod(F.hour(width), F.lit(3)) == i).coalesce(1).write.parquet(f"{path}/part={i}")
    hourly.limit(1).withColumn("series", F.lit("tick")).withColumn(width, F.expr("bucket_ts + INTERVAL 4000 DAYS")).write.parquet(f"{path}/part=9")
    stream = t.spark.readStream.schema(hourly.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").parquet(path)
    out = _run(t, jobs.stream_update(stream, watermark="1000 days"), ["series"]).filter("series <> 'tick'")
    return out.select("series", "n", *[F.round(c, 6).alias(c) for c in ("level", "trend", "baseline")])


@query("ingest_events", with_logs("""
SELECT (SELECT count(*) FROM logs) AS events, (SELECT count(*) FROM (SELECT DISTINCT tenant_id, service_name, masked FROM logs)) AS new_templates"""))
def _(t):
    store = ingest.Store(t.spark, scratch_path(t.spark, "store"))
    return ingest.ingest_events(t.logs, store, NOW).select("events", "new_templates")


def _log_folder(t):
    """The log rows as text files, one folder per service."""
    path = scratch_path(t.spark, "folder")
    line = F.concat_ws(" ", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss"), "body_raw")
    t.logs.select(line.alias("value"), "service_name").write.partitionBy("service_name").text(path)
    return path


FOLDER_SQL = with_logs("""SELECT concat('service_name=', service_name) AS service_name, count(*) AS rows, count(DISTINCT masked2) AS templates,
 strftime(date_trunc('second', min(timestamp_utc)), '%Y-%m-%d %H:%M:%S') AS first_seen
 FROM (SELECT *, concat('<NUM>-<NUM>-<NUM> <NUM>:<NUM>:<NUM> ', masked) AS masked2 FROM logs) GROUP BY service_name""")


def _stored(t, store):
    return store.logs().groupBy("service_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("template_hash").alias("templates"),
        F.date_format(F.min("timestamp_utc"), "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@query("ingest_folder", FOLDER_SQL)
def _(t):
    store = ingest.Store(t.spark, scratch_path(t.spark, "store"))
    ingest.ingest_folder(t.spark, _log_folder(t), store, NOW, "org-1", "fast")
    return _stored(t, store)


@query("stream_ingest", FOLDER_SQL)
def _(t):
    store = ingest.Store(t.spark, scratch_path(t.spark, "store"))
    jobs.stream_ingest(t.spark, _log_folder(t), store, scratch_path(t.spark, "check"), NOW, "org-1", "fast").start().awaitTermination()
    return _stored(t, store)


@query("ledger_of_folder", with_logs("SELECT CAST(count(*) AS BIGINT) AS events FROM logs"))
def _(t):
    store = ingest.Store(t.spark, scratch_path(t.spark, "store"))
    ingest.ingest_folder(t.spark, _log_folder(t), store, NOW, "org-1")
    return tables.ledger_list(store.ledger(), "org-1").agg(F.sum("events_inserted").alias("events"))


@query("ingest_statistics", with_logs("""
SELECT run, CASE run WHEN 1 THEN 5 + 2 ELSE 5 + 2 END::BIGINT AS files, CASE run WHEN 1 THEN 1 ELSE 7 END::BIGINT AS skipped, CASE run WHEN 1 THEN a + b ELSE 0 END::BIGINT AS lines,
 CASE run WHEN 1 THEN a + b - r ELSE 0 END::BIGINT AS events, 0::BIGINT AS errors, CASE run WHEN 1 THEN r ELSE 0 END::BIGINT AS rejected
FROM (SELECT count(*) AS a, count(*) FILTER (severity >= 4) AS b, count(*) FILTER (severity >= 4 AND id % 10 = 3) AS r FROM logs), (VALUES (1), (2)) v(run)"""))
def _(t):
    """Five text files, a JSON-lines file with some lines that hold no object, a copy of it; and a second run."""
    path = scratch_path(t.spark, "folder")
    line = F.concat_ws(" ", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss"), "body_raw")
    before = t.spark.conf.get(OPEN_FILES)
    t.spark.conf.set(OPEN_FILES, "16")  # rows go to their files as they come; else a task sorts all that it writes
    try:
        t.logs.select(line.alias("value"), "service_name").repartition("service_name").write.partitionBy("service_name").text(f"{path}/text")
    finally:
        t.spark.conf.set(OPEN_FILES, before)
    obj = F.to_json(F.struct(F.col("body_raw").alias("msg"), F.col("severity").alias("Level"), "id"))
    bad = t.logs.filter("severity >= 4").select(F.when(F.col("id") % 10 == 3, "[1, 2]").otherwise(obj).alias("value")).coalesce(1)
    for copy in ("one", "two"):
        bad.write.text(f"{path}/{copy}")
    fs = t.spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(t.spark._jsc.hadoopConfiguration())
    for copy in ("one", "two"):
        for f in fs.listStatus(t.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{copy}")):
            if f.getPath().getName().endswith(".txt"):
                fs.rename(f.getPath(), t.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{copy}/part.jsonl"))
    store = ingest.Store(t.spark, scratch_path(t.spark, "store"))
    runs = [ingest.ingest_folder(t.spark, path, store, NOW, "org-1", "fast", max_bytes=0).withColumn("run", F.lit(i)) for i in (1, 2)]
    return runs[0].unionByName(runs[1]).select("run", "files", "skipped", "lines", "events", "errors", "rejected")


@query("write_and_read_logs", with_logs("SELECT CAST(timestamp_utc AS DATE)::VARCHAR AS event_date, count(*) AS rows FROM logs GROUP BY 1"))
def _(t):
    path = scratch_path(t.spark, "logs")
    tables.write_logs(t.logs, path)
    return tables.read_logs(t.spark, path).groupBy(F.col("event_date").cast("string").alias("event_date")).agg(F.count(F.lit(1)).alias("rows"))


@query("normalize_rows", with_logs("""
SELECT id, severity, 'prod' AS environment, CASE WHEN id % 5 = 0 THEN 'unknown' ELSE service_name END AS service_name, id % 7 = 0 AS ts_inferred FROM logs"""))
def _(t):
    rows = t.logs.withColumn("service_name", F.when(F.col("id") % 5 == 0, "").otherwise(F.col("service_name"))).withColumn(
        "timestamp_utc", F.when(F.col("id") % 7 != 0, F.col("timestamp_utc")))
    return parsers.normalize(rows, NOW).select("id", "severity", "environment", "service_name", "ts_inferred")


@query("parse_jsonl", with_logs("""
SELECT id, severity, service_name, host, body_raw AS message, trace_id AS extra FROM logs WHERE id % 10 <> 3"""))
def _(t):
    obj = F.to_json(F.struct(F.col("id").cast("string").alias("Request_ID"), F.col("severity").alias("Level"), F.col("service_name").alias("app"),
                             F.col("host").alias("hostname"), F.col("body_raw").alias("msg"), F.col("trace_id").alias("extra")))
    lines = t.logs.select(F.when(F.col("id") % 10 == 3, "[1, 2]").otherwise(obj).alias("value"))
    return parsers.parse_jsonl(lines).select(F.col("trace_id").cast("bigint").alias("id"), "severity", "service_name", "host", "message",
                                             F.try_element_at("attributes", F.lit("extra")).alias("extra"))


@query("parse_csv", with_logs("""
SELECT id, CAST(CASE WHEN id % 2 = 0 THEN severity ELSE CASE lower(regexp_extract(body_raw, '(?i)\\b(DEBUG|INFO|WARN|ERROR|FATAL)\\b', 1)) WHEN 'debug' THEN 1 WHEN 'warn' THEN 3
 WHEN 'error' THEN 4 WHEN 'fatal' THEN 5 ELSE 2 END END AS INT) AS severity, service_name, host, body_raw AS message, strftime(date_trunc('second', timestamp_utc), '%Y-%m-%d %H:%M:%S') AS at FROM logs"""))
def _(t):
    names = ["LineId", "Date", "Time", "Level", "Component", "Node", "Content", "EventId", "Key"]
    level = F.when(F.col("id") % 2 == 0, F.col("severity").cast("string")).otherwise("")
    cols = [F.col("id").cast("string"), F.date_format("timestamp_utc", "yyyy-MM-dd"), F.date_format("timestamp_utc", "HH:mm:ss"), level,
            F.col("service_name"), F.col("host"), F.col("body_raw"), F.lit("E1"), F.col("id").cast("string")]
    rows = t.logs.select(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*cols)).alias("fields"))
    return parsers.parse_csv(rows).select(F.try_element_at("attributes", F.lit("Key")).cast("bigint").alias("id"), "severity", "service_name", "host",
                                          "message", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("parse_text", with_logs("""
SELECT id, message, strftime(date_trunc('second', timestamp_utc), '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT id, body_raw AS message, timestamp_utc FROM logs)"""))
def _(t):
    lines = t.logs.select("id", F.concat_ws(" ", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss"), "body_raw").alias("value"))
    return parsers.parse_text(lines).select("id", "message", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss").alias("at"))
