"""Lines and rows to the canonical log columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import fixed
from logloom.functions.labels import clamp_severity, map_severity, severity_from_text, severity_of_word, severity_word
from logloom.functions.text import first_field, lower_keys, residual_map
from logloom.functions.times import first_ts, parse_ts, without_ts
from logloom.schema import DEFAULT_TENANT

PARSED = ["timestamp_utc", "severity", "message", "service_name", "host", "trace_id", "span_id",
          "attributes", "body_raw"]
_NO_ATTRIBUTES = "cast(map() as map<string,string>)"
_KNOWN_JSON = (fixed.TIMESTAMP_FIELDS + fixed.SEVERITY_FIELDS + fixed.MESSAGE_FIELDS + fixed.SERVICE_FIELDS
               + fixed.HOST_FIELDS + fixed.TRACE_FIELDS + fixed.SPAN_FIELDS)


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def parse_text(lines: DataFrame, default_year: int | None = None) -> DataFrame:
    """value (+ any service_name and other columns) to the parsed columns. timestamp_utc is null
    when the line holds none. Each pattern runs once a line: what is used more than once is a column first."""
    out = (lines.withColumn("_e_ts", first_ts(F.col("value"))).withColumn("_e_rest", without_ts(F.col("value"), F.col("_e_ts")))
           .withColumn("_e_word", severity_word(F.col("_e_rest"))))
    rest = F.trim("_e_rest")
    kept = [c for c in lines.columns if c not in PARSED and c != "value"]
    service = F.col("service_name") if "service_name" in lines.columns else F.lit("unknown")
    return out.select(
        *kept, parse_ts(F.col("_e_ts"), default_year).alias("timestamp_utc"),
        severity_of_word(F.col("_e_word")).alias("severity"),
        F.when(rest == "", F.col("value")).otherwise(rest).alias("message"), service.alias("service_name"),
        F.lit("").alias("host"), F.lit("").alias("trace_id"), F.lit("").alias("span_id"),
        F.expr(_NO_ATTRIBUTES).alias("attributes"), F.col("value").alias("body_raw"))


def _json_map(value: Column) -> Column:
    return F.when(F.trim(value).startswith("{"), F.from_json(value, "map<string,string>"))


def parse_jsonl(lines: DataFrame, default_year: int | None = None) -> DataFrame:
    """JSON object lines to the parsed columns; other lines are dropped (see json_rejects)."""
    df = lines.withColumn("_m", _json_map(F.col("value"))).filter(F.col("_m").isNotNull())
    df = df.withColumn("_low", lower_keys(F.col("_m")))

    def get(names):
        return first_field(F.col("_m"), names, F.col("_low"))

    def named(names):
        return F.nullif(get(names), F.lit(""))

    kept = [c for c in lines.columns if c not in PARSED and c != "value"]
    default = F.col("service_name") if "service_name" in lines.columns else F.lit("unknown")
    return df.select(
        *kept, parse_ts(get(fixed.TIMESTAMP_FIELDS), default_year).alias("timestamp_utc"),
        map_severity(get(fixed.SEVERITY_FIELDS)).alias("severity"),
        F.coalesce(get(fixed.MESSAGE_FIELDS), F.col("value")).alias("message"),
        F.coalesce(named(fixed.SERVICE_FIELDS), default).alias("service_name"),
        _or_empty(get(fixed.HOST_FIELDS)).alias("host"), _or_empty(get(fixed.TRACE_FIELDS)).alias("trace_id"),
        _or_empty(get(fixed.SPAN_FIELDS)).alias("span_id"),
        residual_map(F.col("_m"), _KNOWN_JSON).alias("attributes"), F.col("value").alias("body_raw"))


def json_rejects(lines: DataFrame) -> DataFrame:
    return lines.filter(_json_map(F.col("value")).isNull())


def csv_rejects(rows: DataFrame) -> DataFrame:
    """CSV rows without content."""
    found = F.coalesce(*[F.nullif(F.try_element_at(F.col("fields"), F.lit(n)), F.lit("")) for n in fixed.CSV_MESSAGE])
    return rows.filter(found.isNull())


def parse_csv(rows: DataFrame, default_year: int | None = None) -> DataFrame:
    """fields (map header -> text) to the parsed columns; rows without content are dropped."""
    def get(names):
        return F.coalesce(*[F.nullif(F.try_element_at(F.col("fields"), F.lit(n)), F.lit("")) for n in names])

    date, time = get(fixed.CSV_DATE), get(fixed.CSV_TIME)
    level = get(fixed.CSV_LEVEL)
    default = F.col("service_name") if "service_name" in rows.columns else F.lit("unknown")
    kept = [c for c in rows.columns if c not in PARSED and c != "fields"]
    rest = F.map_filter(residual_map(F.col("fields"), fixed.CSV_KNOWN), lambda k, v: F.coalesce(v, F.lit("")) != "")
    out = rows.select(
        *kept, parse_ts(F.when(date.isNotNull(), F.concat_ws(" ", date, time)), default_year).alias("timestamp_utc"),
        get(fixed.CSV_MESSAGE).alias("message"), level.alias("_level"),
        F.coalesce(get(fixed.CSV_SERVICE), default).alias("service_name"), _or_empty(get(fixed.CSV_HOST)).alias("host"),
        rest.alias("attributes")).filter(F.col("message").isNotNull())
    return out.select(
        *kept, "timestamp_utc",
        F.when(F.col("_level").isNotNull(), map_severity(F.col("_level")))
        .otherwise(severity_from_text(F.col("message"))).alias("severity"),
        "message", "service_name", "host", F.lit("").alias("trace_id"), F.lit("").alias("span_id"), "attributes",
        F.col("message").alias("body_raw"))


def normalize(parsed: DataFrame, now: dt.datetime, tenant: str = DEFAULT_TENANT, environment: str = "prod") -> DataFrame:
    """Defaults and ranges of the canonical row. A missing event time becomes the ingest time and
    sets ts_inferred."""
    have = set(parsed.columns)
    ingest = F.lit(now).cast("timestamp")

    def col(name, default):
        return F.coalesce(F.col(name), default) if name in have else default

    ts = F.col("timestamp_utc") if "timestamp_utc" in have else F.lit(None).cast("timestamp")
    body = F.coalesce(F.nullif(col("body_raw", F.lit("")), F.lit("")), col("message", F.lit("")))
    names = ["tenant_id", "service_name", "environment", "timestamp_utc", "ingest_timestamp_utc", "ts_inferred",
             "severity", "host", "trace_id", "span_id", "attributes", "body_raw"]
    kept = [c for c in parsed.columns if c not in names]
    return parsed.select(
        *kept, (col("tenant_id", F.lit(tenant))).alias("tenant_id"),
        F.coalesce(F.nullif(col("service_name", F.lit("")), F.lit("")), F.lit("unknown")).alias("service_name"),
        col("environment", F.lit(environment)).alias("environment"),
        F.coalesce(ts, ingest).alias("timestamp_utc"), ingest.alias("ingest_timestamp_utc"),
        ts.isNull().alias("ts_inferred"), clamp_severity(map_severity(col("severity", F.lit(2)))).alias("severity"),
        *[col(n, F.lit("")).alias(n) for n in ("host", "trace_id", "span_id")],
        col("attributes", F.expr(_NO_ATTRIBUTES)).alias("attributes"), body.alias("body_raw"))
