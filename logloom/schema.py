"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

DEFAULT_TENANT = "org-123"

LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("service_name", T.StringType()),
    T.StructField("environment", T.StringType()),
    T.StructField("timestamp_utc", T.TimestampType()),
    T.StructField("ingest_timestamp_utc", T.TimestampType()),
    T.StructField("severity", T.IntegerType()),
    T.StructField("host", T.StringType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("span_id", T.StringType()),
    T.StructField("template_hash", T.LongType()),
    T.StructField("parameters", T.ArrayType(T.StringType())),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("body_raw", T.StringType()),
])

TEMPLATE_SCHEMA = T.StructType([
    T.StructField("tenant_id", T.StringType()),
    T.StructField("service_name", T.StringType()),
    T.StructField("template_hash", T.LongType()),
    T.StructField("template_text", T.StringType()),
    T.StructField("first_seen_utc", T.TimestampType()),
    T.StructField("last_seen_utc", T.TimestampType()),
    T.StructField("embedding_state", T.StringType()),
    T.StructField("embedding_model", T.StringType()),
    T.StructField("embedding_updated_utc", T.TimestampType()),
])

VECTOR_SCHEMA = T.StructType([
    T.StructField("tenant_id", T.StringType()),
    T.StructField("service_name", T.StringType()),
    T.StructField("template_hash", T.LongType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("updated_utc", T.TimestampType()),
])

LEDGER_SCHEMA = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("lines_processed", T.LongType()),
    T.StructField("events_inserted", T.LongType()),
    T.StructField("templates_discovered", T.LongType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("tenant_id", T.StringType()),
])

TEMPLATE_KEY = ["tenant_id", "service_name", "template_hash"]
