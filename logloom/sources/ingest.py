"""Ingest jobs: files or event records to the log, template, ledger and reject tables.

Everything that one batch adds becomes visible in one step (tables.BatchTables). A batch of files is named by what
its files hold, so a run that repeats an interrupted one replaces the same folders, and a file that is in the
committed ledger is not taken again."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import fixed
from logloom.operators.templates import mine_fast, mine_templates, new_templates, templates_of, upsert_templates
from logloom.schema import DEFAULT_TENANT, LEDGER_SCHEMA, LOG_SCHEMA, TEMPLATE_KEY, TEMPLATE_SCHEMA
from logloom.session import discard, materialize
from logloom.sources import files, parsers, tables

ROW_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LOG_SCHEMA) + (
    ", template_text string, ts_inferred boolean, file_path string, event_date date")
REJECT_SCHEMA = "file_path string, value string, reason string, tenant_id string"
TEMPLATE_DELTA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TEMPLATE_SCHEMA if not f.name.startswith("embedding_")) + ", embedding_state string"
STATS = ["files", "skipped", "lines", "events", "new_templates", "errors", "rejected"]


class Templates:
    """The template table: a base that keeps embedding states, and what committed batches added since. Adding a
    batch again changes nothing, so base and batches may overlap."""

    def __init__(self, batches: tables.BatchTables, path: str):
        self.batches, self.base = batches, tables.template_table(batches.spark, path)

    def read(self) -> DataFrame:
        base, added = self.base.read(), self.batches.get("templates", TEMPLATE_DELTA)
        merged = added.groupBy(*TEMPLATE_KEY).agg(
            F.min("template_text").alias("template_text"), F.min("first_seen_utc").alias("first_seen_utc"),
            F.max("last_seen_utc").alias("last_seen_utc"), F.min("embedding_state").alias("embedding_state"))
        kept = base.select(*TEMPLATE_KEY, "embedding_model", "embedding_updated_utc")
        return upsert_templates(base, merged).join(kept, TEMPLATE_KEY, "left").select(*[f.name for f in TEMPLATE_SCHEMA])

    def write(self, df: DataFrame) -> None:
        """A new base, for instance after embedding."""
        self.base.write(df)


class Store:
    """Folder layout of one store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.batches = spark, tables.BatchTables(spark, root)
        self.templates = Templates(self.batches, f"{root.rstrip('/')}/template_base")

    def logs(self) -> DataFrame:
        return self.batches.get("logs", ROW_SCHEMA)

    def ledger(self) -> DataFrame:
        return self.batches.get("ledger", LEDGER_SCHEMA).drop("batch")

    def rejects(self) -> DataFrame:
        return self.batches.get("rejects", REJECT_SCHEMA)

    def clear_ledger(self) -> None:
        """Forgets which files were taken in; their rows stay."""
        self.batches.clear("ledger")


def with_ids(df: DataFrame, batch: str) -> DataFrame:
    """A 64-bit id from the batch name and the row's place; the place is fixed by the input splits."""
    return df.withColumn("id", F.xxhash64(F.lit(batch), F.monotonically_increasing_id()))


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def parse_files(spark: SparkSession, found: DataFrame, root: str, default_year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Parsed rows of the files (path, format), all formats in one plan, with file_path; and the lines that gave no
    row: file_path, value, reason."""
    by_format: dict[str, list[str]] = {}
    for r in found.select("path", "format").orderBy("path").collect():  # file names only
        by_format.setdefault(r.format, []).append(r.path)
    parts, rejects = [], []
    for fmt, paths in by_format.items():
        raw = files.read_csv_rows(spark, paths) if fmt == "csv" else files.read_lines(spark, paths)
        if raw is None:
            continue
        raw = raw.withColumn("service_name", files.service_from_path(F.col("file_path"), root))
        parse = {"csv": parsers.parse_csv, "jsonl": parsers.parse_jsonl, "text": parsers.parse_text}[fmt]
        parts.append(parse(raw, default_year).select("file_path", *parsers.PARSED))
        if fmt == "jsonl":
            rejects.append(parsers.json_rejects(raw).select("file_path", "value", F.lit("no_object").alias("reason")))
        if fmt == "csv":
            rejects.append(parsers.csv_rejects(raw).select("file_path", F.to_json("fields").alias("value"), F.lit("no_content").alias("reason")))
    nothing = spark.createDataFrame([], "file_path string, value string, reason string")
    return _together(parts), _together([nothing, *rejects])


def is_large(length: Column) -> Column:
    """Files that are estimated to hold too many lines for full mining."""
    return F.floor(length / fixed.BYTES_PER_LINE) > fixed.FAST_MODE_LINES


def _mine(rows: DataFrame, mode: str, large: DataFrame | None) -> DataFrame:
    """`fast`, `full`, or `auto`: fast for the rows of large files only."""
    if mode != "auto" or large is None:
        return mine_fast(rows) if mode == "fast" else mine_templates(rows)
    return _together([mine_fast(rows.join(large, "file_path", "left_semi")), mine_templates(rows.join(large, "file_path", "left_anti"))])


def _put(store: Store, batch: str, mined: DataFrame, rejects: DataFrame | None = None, entries: DataFrame | None = None) -> int:
    """Writes all tables of the batch, then makes them visible. Returns the number of templates new to the store."""
    found = materialize(templates_of(mined), "batch-templates")
    fresh = new_templates_count(found, store.templates.read())
    have = set(mined.columns)
    names = [*(f.name for f in LOG_SCHEMA), "template_text", "ts_inferred", "file_path"]
    types = dict(x.split(" ", 1) for x in ROW_SCHEMA.split(", "))
    rows = mined.select(*[(F.col(n) if n in have else F.lit(None)).cast(types[n]).alias(n) for n in names]).withColumn(
        "event_date", F.to_date("timestamp_utc"))
    store.batches.put("logs", batch, rows, by="event_date")
    store.batches.put("templates", batch, found)
    if rejects is not None:
        store.batches.put("rejects", batch, rejects)
    if entries is not None:
        store.batches.put("ledger", batch, entries)
    store.batches.commit(batch)
    discard(found)
    return fresh


def new_templates_count(found: DataFrame, known: DataFrame) -> int:
    return found.join(known.select(*TEMPLATE_KEY), TEMPLATE_KEY, "left_anti").count()


def ingest_stats(spark: SparkSession, **counts: int) -> DataFrame:
    """One row: files seen, skipped (known or repeated content), lines read, events stored, new templates, files that could
    not be read, lines that gave no event."""
    return spark.createDataFrame([tuple(int(counts.get(c) or 0) for c in STATS)], ", ".join(f"{c} long" for c in STATS))


def take_files(spark: SparkSession, found: DataFrame, root: str, store: Store, now: dt.datetime, tenant: str, mode: str,
               service: str | None = None) -> DataFrame:
    """Takes in the files (path, length, format) whose content is not in the ledger; see ingest_folder."""
    listed = found.select("path").collect()  # file names only
    if not listed:
        return ingest_stats(spark)
    hashes = materialize(files.file_hashes(spark, [r.path for r in listed]), "file-hashes")
    lost = found.join(hashes.select("path"), "path", "left_anti").select(
        files.plain_path(F.col("path")).alias("file_path"), F.lit(None).cast("string").alias("value"), F.lit("unreadable").alias("reason"))
    fresh = materialize(files.new_files(hashes, store.ledger()), "new-files")
    taken, mark, errors = fresh.count(), fresh.agg(F.hex(F.bit_xor(F.xxhash64("file_hash")))).first()[0], lost.count()
    skipped = len(listed) - taken - errors
    if not taken:
        return ingest_stats(spark, files=len(listed), skipped=skipped, errors=errors)
    batch = f"files-{mark}-{taken}"
    parsed, refused = parse_files(spark, found.join(fresh.select("path"), "path"), root, now.year)
    if service is not None:
        parsed = parsed.withColumn("service_name", F.lit(service))
    sizes = fresh.select(files.plain_path(F.col("path")).alias("file_path"), F.col("length").alias("file_size"), "file_hash")
    rows = materialize(with_ids(parsers.normalize(parsed, now, tenant), batch), "parsed")
    mined = materialize(_mine(rows, mode, sizes.filter(is_large(F.col("file_size"))).select("file_path")), "ingest")
    rejects = materialize(refused.unionByName(lost).withColumn("tenant_id", F.lit(tenant)), "rejects")
    per_file = mined.groupBy("file_path").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("template_hash").alias("templates"))
    bad = rejects.filter("reason <> 'unreadable'").groupBy("file_path").agg(F.count(F.lit(1)).alias("bad"))
    entries = sizes.join(per_file, "file_path", "left").join(bad, "file_path", "left").na.fill(0, ["events", "templates", "bad"])
    entries = materialize(tables.ledger_entries(entries.withColumn("lines", F.col("events") + F.col("bad")), now, tenant), "entries")
    counts = entries.agg(F.sum("lines_processed").alias("lines"), F.sum("events_inserted").alias("events")).first()
    added = _put(store, batch, mined, rejects, entries)
    discard(rows, mined, rejects, entries, hashes, fresh)
    return ingest_stats(spark, files=len(listed), skipped=skipped, lines=counts["lines"], events=counts["events"], new_templates=added, errors=errors,
                        rejected=counts["lines"] - counts["events"])


def ingest_folder(spark: SparkSession, root: str, store: Store, now: dt.datetime, tenant: str = DEFAULT_TENANT,
                  mode: str = "auto", max_bytes: int = files.fixed.MAX_FILE_BYTES, paths: list[str] | None = None,
                  service: str | None = None) -> DataFrame:
    """Takes in every new file under root (or only `paths`, which must lie under it) and returns
    the statistics row. Files whose content is in the ledger, or twice in the batch, are skipped; a file that
    cannot be read is reported as an error in the statistics and among the rejects, and does not stop the job.
    `mode` chooses template mining: fast, full, or by the estimated number of lines of each file (auto)."""
    found = files.discover(spark, root, max_bytes)
    if paths is not None:
        base = root.rstrip("/") + "/"
        outside = [p for p in paths if not p.startswith(base) or "/../" in p]
        if outside:
            raise ValueError(f"not under the root: {outside}")
        found = found.filter(files.plain_path(F.col("path")).isin(paths))
    return take_files(spark, found, root, store, now, tenant, mode, service)


def ingest_files(spark: SparkSession, root: str, paths: list[str], store: Store, now: dt.datetime,
                 service: str | None = None, **kw) -> DataFrame:
    return ingest_folder(spark, root, store, now, paths=paths, service=service, **kw)


def ingest_events(events: DataFrame, store: Store, now: dt.datetime, tenant: str = DEFAULT_TENANT, mode: str = "fast",
                  batch: str | None = None) -> DataFrame:
    """Takes in event records (message or body_raw, and any canonical column). With a `batch` name, a batch that is
    committed already is not taken again."""
    spark = store.spark
    name = f"events-{uuid.uuid4().hex if batch is None else batch}"
    if name in store.batches.committed():
        return ingest_stats(spark)
    rows = parsers.normalize(events, now, tenant)
    keep = [c for c in rows.columns if c not in ("id", "template_text", "template_hash", "parameters", "message")]
    rows = materialize(with_ids(rows.select(*keep), name), "parsed")
    mined = materialize(_mine(rows, mode, None), "ingest")
    n = mined.count()
    added = _put(store, name, mined)
    discard(rows, mined)
    return ingest_stats(spark, lines=n, events=n, new_templates=added)
