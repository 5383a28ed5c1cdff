"""Tables on shared storage: log appends, versioned small tables, and the file ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.schema import LEDGER_SCHEMA, TEMPLATE_SCHEMA


def write_logs(logs: DataFrame, path: str) -> None:
    """Appends rows, partitioned by event date. Rows are not moved: each task writes its own file
    per date it holds, so a busy date is never one task."""
    dated = logs.withColumn("event_date", F.to_date("timestamp_utc"))
    dated.write.mode("append").partitionBy("event_date").parquet(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


class VersionedTable:
    """A small table whose every write is a new folder v=N; readers take the newest complete one
    (with its _SUCCESS mark), so a writer never overwrites what it reads."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _versions(self) -> list[int]:
        if not _exists(self.spark, self.path):
            return []
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and _exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={versions[-1]}")

    def write(self, df: DataFrame) -> None:
        versions = self._versions()
        have = set(df.columns)
        cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
        df.select(*cols).write.mode("overwrite").parquet(f"{self.path}/v={(versions[-1] if versions else 0) + 1}")


def template_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, TEMPLATE_SCHEMA)


# --- batches that become visible in one step --------------------------------------------
class BatchTables:
    """Tables below one root whose rows come in batches: <table>/batch=<id>. A batch is seen by readers only once
    its id stands in <root>/commits, one empty file that is made after all of its tables are written. A batch that
    was interrupted anywhere before leaves nothing visible, and the run that repeats it replaces its folders."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, *parts: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def committed(self) -> list[str]:
        """Ids only; the newest ones last by name."""
        fs, where = self._at("commits")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def commit(self, batch: str) -> None:
        fs, where = self._at("commits", batch)
        fs.mkdirs(where.getParent())
        fs.createNewFile(where)

    def put(self, table: str, batch: str, rows: DataFrame, by: str | None = None) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{table}/batch={batch}")

    def get(self, table: str, schema) -> DataFrame:
        """Rows of all committed batches, with the id of their batch."""
        folders = [f"{self.root}/{table}/batch={b}" for b in self.committed() if _exists(self.spark, f"{self.root}/{table}/batch={b}")]
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("string"))
        return self.spark.read.option("basePath", f"{self.root}/{table}").schema(schema).parquet(*folders).withColumn(
            "batch", F.regexp_extract(F.col("_metadata.file_path"), "/batch=([^/]+)/", 1))

    def clear(self, table: str) -> None:
        fs, where = self._at(table)
        fs.delete(where, True)


# --- ledger of files taken in -----------------------------------------------------------
def ledger_read(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def ledger_append(entries: DataFrame, path: str) -> None:
    entries.select(*[F.col(f.name).cast(f.dataType) for f in LEDGER_SCHEMA]).write.mode("append").parquet(path)


def ledger_list(ledger: DataFrame, tenant: str) -> DataFrame:
    """Entries of the tenant, newest first."""
    return ledger.filter(F.col("tenant_id") == tenant).orderBy(F.col("ingested_at").desc(), "file_path")


def ledger_clear(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("overwrite").parquet(path)


def ledger_entries(stats: DataFrame, now: dt.datetime, tenant: str) -> DataFrame:
    """Per-file statistics (file_path, file_size, file_hash, lines, events, templates) as entries."""
    return stats.select(
        "file_path", F.element_at(F.split("file_path", "/"), -1).alias("file_name"), "file_size", "file_hash",
        F.col("lines").alias("lines_processed"), F.col("events").alias("events_inserted"),
        F.col("templates").alias("templates_discovered"), F.lit(now).cast("timestamp").alias("ingested_at"),
        F.lit(tenant).alias("tenant_id"))
