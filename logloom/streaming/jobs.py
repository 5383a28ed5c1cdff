"""Structured Streaming forms of the windowed and incremental operators.

Inputs are log streams with a TIMESTAMP column timestamp_utc. The watermark default is 10
minutes: later rows still reach the log table but not closed windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.labels import extract_source, extract_target, is_auth_failure
from logloom.functions.text import first_group, template_hash
from logloom.session import materialize
from logloom.sources import files
from logloom.sources.ingest import Store, take_files
from logloom.streaming.stateful import (WATERMARK, stream_bruteforce_events, stream_clusters, stream_recon_events,  # noqa: F401
                                        stream_update)
from logloom import fixed


def stream_trend(logs: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Rows and errors per hour."""
    return (logs.withWatermark("timestamp_utc", watermark).groupBy(F.window("timestamp_utc", "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("severity") >= 4).alias("errors"))
            .select(F.col("w.start").alias("hour"), "count", "errors"))


def stream_health(logs: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Totals, errors and warnings per service and hour."""
    return (logs.withWatermark("timestamp_utc", watermark)
            .groupBy(F.window("timestamp_utc", "1 hour").alias("w"), "service_name")
            .agg(F.count(F.lit(1)).alias("total_logs"), F.count_if(F.col("severity") >= 4).alias("errors"),
                 F.count_if(F.col("severity") == 3).alias("warnings"))
            .select(F.col("w.start").alias("hour"), "service_name", "total_logs", "errors", "warnings"))


def stream_bruteforce(logs: DataFrame, window: str = "5 minutes", slide: str = "1 minute", threshold: int = 5,
                      watermark: str = WATERMARK) -> DataFrame:
    """Failures per source in sliding windows. Partial counts are made before the shuffle."""
    body = F.col("body_raw")
    fails = logs.filter(is_auth_failure(body)).withColumn("source", extract_source(body, F.col("service_name")))
    return (fails.withWatermark("timestamp_utc", watermark).groupBy(F.window("timestamp_utc", window, slide).alias("w"), "source")
            .agg(F.count(F.lit(1)).alias("failure_count"))
            .select(F.col("w.start").alias("window_start"), "source", "failure_count",
                    (F.col("failure_count") > threshold).alias("is_brute_force")))


def stream_recon(logs: DataFrame, window: str = "1 minute", slide: str = "30 seconds", diversity: int = 10,
                 watermark: str = WATERMARK, approximate: bool = False) -> DataFrame:
    """Distinct targets per source in sliding windows. The exact form keeps the set of targets per
    (window, source) as state; `approximate` keeps a fixed-size sketch instead, for sources that
    may touch millions of targets in a window."""
    body = F.col("body_raw")
    source = F.coalesce(first_group(body, fixed.IP_PATTERN, 0), F.col("service_name"))
    seen = (logs.withColumn("source", source).withColumn("target", extract_target(body)).filter(F.col("target").isNotNull())
            .withWatermark("timestamp_utc", watermark))
    count = F.approx_count_distinct("target") if approximate else F.size(F.collect_set("target")).cast("bigint")
    return (seen.groupBy(F.window("timestamp_utc", window, slide).alias("w"), "source").agg(count.alias("unique_targets"))
            .select(F.col("w.start").alias("window_start"), "source", "unique_targets",
                    (F.col("unique_targets") >= diversity).alias("is_recon")))


def stream_templates(logs: DataFrame, path: str, checkpoint: str, depth: int = 4, sim_th: float = 0.4):
    """Template discovery: each batch appends the templates it touched to `path` (read_templates). A batch that runs
    again replaces its own folder."""
    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (stream_clusters(logs, depth, sim_th).writeStream.outputMode("update").foreachBatch(put)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """The template table as of the newest batch: tenant_id, service_name, template_hash, template_text, first_seen_utc,
    last_seen_utc, rows, embedding_state."""
    changes = spark.read.parquet(path)
    # a leader's newest text holds for all tenants that met it
    newest = changes.groupBy("service_name", "leader").agg(F.max_by("template_text", F.struct("batch", F.length("template_text"))).alias("template_text"))
    named = changes.drop("template_text", "batch").join(newest.withColumnsRenamed({"service_name": "_s", "leader": "_l"}),
                                                      F.col("service_name").eqNullSafe(F.col("_s")) & (F.col("leader") == F.col("_l")))
    out = named.groupBy("tenant_id", "service_name", "template_text").agg(
        F.min("first_at").alias("_a"), F.max("last_at").alias("_b"), F.sum("rows").alias("rows"))
    return out.select("tenant_id", "service_name", template_hash(F.col("service_name"), F.col("template_text")).alias("template_hash"), "template_text",
                      F.timestamp_micros("_a").alias("first_seen_utc"), F.timestamp_micros("_b").alias("last_seen_utc"), "rows",
                      F.lit("queued").alias("embedding_state"))


def stream_ingest(spark: SparkSession, root: str, store: Store, checkpoint: str, now: dt.datetime, tenant: str, mode: str = "auto",
                  max_bytes: int = fixed.MAX_FILE_BYTES):
    """Continuous folder ingest of all formats. The source log lists every file once; each batch takes its files as
    the folder job does: content hashes, ledger, rejects and rows become visible together, and a batch that runs
    again after its commit finds its files in the ledger."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    listed = (spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", "true").load(root)
              .select("path", "length"))
    found = files.log_files(listed, root, max_bytes)

    def take(batch: DataFrame, batch_id: int) -> None:
        take_files(spark, materialize(batch, "listed"), root, store, now, tenant, mode)

    return found.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run_to_table(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> None:
    """Runs an update-mode stream over the input at hand and keeps the latest row per key: batches
    are appended with their number and the newest wins on reading (read_latest)."""
    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    (stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def read_latest(spark: SparkSession, keys: list[str], path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")
