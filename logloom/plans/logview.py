"""Log, template and vector views over the driver's tables, and the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import mask_fast, template_hash

# One expression list that Spark SQL and DuckDB both accept.
LOG_COLUMNS = """
       event_id AS id,
       concat('org-', CAST(user_id % 2 AS STRING)) AS tenant_id,
       CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'sshd' WHEN 1 THEN 'nginx' WHEN 2 THEN 'mysql'
            WHEN 3 THEN 'kernel' ELSE 'app' END AS service_name,
       'prod' AS environment,
       CAST(ts AS TIMESTAMP) AS timestamp_utc,
       CAST(CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 5
                 WHEN event_type = 'error' THEN 4
                 WHEN event_type = 'signup' THEN 3
                 WHEN event_type IN ('purchase', 'view') THEN 2
                 WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS INT) AS severity,
       concat('host-', CAST(user_id % 3 AS STRING)) AS host,
       concat('tr-', CAST(event_id % 100 AS STRING)) AS trace_id,
       props AS attributes_json,
       CASE WHEN event_type = 'error' AND event_id % 4 = 0
              THEN concat('Failed password for user=u', CAST(user_id AS STRING), ' from 10.0.0.', CAST(user_id % 250 AS STRING), ' port=', CAST(event_id % 60000 AS STRING))
            WHEN event_type = 'error' AND event_id % 4 = 1
              THEN concat('ERROR connection refused: timeout talking to 10.1.0.', CAST(user_id % 250 AS STRING), ' pid=', CAST(event_id % 5000 AS STRING))
            WHEN event_type = 'error' AND event_id % 4 = 2
              THEN concat('FATAL out of memory in worker pid=', CAST(event_id % 5000 AS STRING))
            WHEN event_type = 'error'
              THEN concat('GET /search?q=1=1 union select password from users from 10.0.0.', CAST(user_id % 250 AS STRING))
            WHEN event_type = 'signup'
              THEN concat('WARN login attempt user=u', CAST(user_id AS STRING), ' rate limit near, attempt ', CAST(event_id % 7 AS STRING))
            WHEN event_type = 'view'
              THEN concat('GET /item/', CAST(event_id % 50 AS STRING), ' 200 from 10.0.0.', CAST(user_id % 250 AS STRING))
            WHEN event_type = 'purchase'
              THEN concat('INFO order ', CAST(event_id AS STRING), ' completed for user=u', CAST(user_id AS STRING))
            ELSE concat('DEBUG click handled in ', CAST(event_id % 900 AS STRING), ' ms') END AS body_raw
"""


def split_columns(text: str) -> list[str]:
    """The comma-separated expressions of a select list, commas inside parentheses kept."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0 and text[:i].count("'") % 2 == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    return parts + [text[start:].strip()]


def log_view(events: DataFrame) -> DataFrame:
    """Log rows from the events table, with the masked template of every row."""
    logs = events.selectExpr(*split_columns(LOG_COLUMNS))
    masked = mask_fast(F.col("body_raw"))
    return (logs.withColumn("template_text", masked)
            .withColumn("template_hash", template_hash(F.col("service_name"), masked)))


def template_view(logs: DataFrame) -> DataFrame:
    """One row per (tenant, service, template). The state is derived from the text so that
    every state occurs."""
    return (logs.groupBy("tenant_id", "service_name", "template_hash")
            .agg(F.min("template_text").alias("template_text"),
                 F.min("timestamp_utc").alias("first_seen_utc"),
                 F.max("timestamp_utc").alias("last_seen_utc"))
            .withColumn("embedding_state", F.expr(
                "CASE length(template_text) % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'queued' "
                "WHEN 2 THEN 'failed' ELSE 'none' END")))


def vector_view(embeddings: DataFrame) -> DataFrame:
    """Vectors keyed like template vectors: tenant and service derived from the id."""
    return embeddings.selectExpr(
        "concat('org-', CAST(vec_id % 2 AS STRING)) AS tenant_id",
        "CASE CAST(label % 3 AS INT) WHEN 0 THEN 'sshd' WHEN 1 THEN 'nginx' ELSE 'app' END AS service_name",
        "vec_id AS template_hash", "embedding AS vector", "vec_id", "label")


LOGS_SQL = f"""logs AS (
SELECT *, masked AS template_text FROM (
SELECT *, regexp_replace(regexp_replace(body_raw, '\\b\\d+\\b', '<NUM>', 'g'),
                         '\\b[0-9a-fA-F]{{8,}}\\b', '<HEX>', 'g') AS masked
FROM (SELECT {LOG_COLUMNS} FROM events)))"""

TEMPLATES_SQL = """templates AS (
SELECT *, CASE length(template_text) % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'queued'
               WHEN 2 THEN 'failed' ELSE 'none' END AS embedding_state
FROM (SELECT tenant_id, service_name, template_text, min(timestamp_utc) AS first_seen_utc,
             max(timestamp_utc) AS last_seen_utc
      FROM logs GROUP BY ALL))"""

VECTORS_SQL = """vectors AS (
SELECT concat('org-', CAST(vec_id % 2 AS STRING)) AS tenant_id,
       CASE CAST(label % 3 AS INT) WHEN 0 THEN 'sshd' WHEN 1 THEN 'nginx' ELSE 'app' END AS service_name,
       vec_id AS template_hash, embedding AS vector, vec_id, label FROM embeddings)"""


def with_logs(sql: str) -> str:
    return f"WITH {LOGS_SQL}\n{sql}"


def with_templates(sql: str) -> str:
    return f"WITH {LOGS_SQL},\n{TEMPLATES_SQL}\n{sql}"


def more(*ctes: str) -> str:
    """Extra common table expressions after the logs view."""
    return f"WITH RECURSIVE {LOGS_SQL}" + "".join(",\n" + c for c in ctes) + "\n"


ISO = "yyyy-MM-dd HH:mm:ss.SSSSSS"
ISO_SQL = "'%Y-%m-%d %H:%M:%S.%f'"


def ts_text(col) -> F.Column:
    return F.date_format(col, ISO)
