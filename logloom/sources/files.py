"""Finding log files, reading their lines, and skipping files already taken in."""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import fixed

#: Files up to this size are hashed as one value; larger ones in pieces of neighbouring lines of about PIECE_BYTES.
WHOLE_BYTES = 8 << 20
PIECE_BYTES = 1 << 20


def plain_path(path: Column) -> Column:
    """Path without scheme and host."""
    return F.when(path.startswith("/"), path).otherwise(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", ""))


def decoded_path(path: Column) -> Column:
    """`_metadata.file_path` is percent-encoded; this is the plain path."""
    return plain_path(F.when(path.contains("%"), F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path))


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def format_of(path: Column) -> Column:
    suffix = suffix_of(path)
    return F.when(suffix == ".jsonl", "jsonl").when(suffix == ".csv", "csv").otherwise("text")


def service_from_path(path: Column, root: str) -> Column:
    """First folder below the root, else the file stem; lower case, blanks and dashes as _."""
    base = root.rstrip("/") + "/"
    plain = plain_path(path)
    rest = F.substring(plain, len(base) + 1, 1_000_000)
    stem = F.regexp_replace(rest, r"(?<=.)\.[^.]*$", "")
    name = F.when(rest.contains("/"), F.substring_index(rest, "/", 1)).otherwise(stem)
    return F.when(plain.startswith(base), F.translate(F.lower(name), " -", "__")).otherwise("unknown")


def log_files(found: DataFrame, root: str, max_bytes: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    """path, length, format and service of the log files among (path, length). Hidden files and folders
    and files above `max_bytes` (0 = no limit) are left out."""
    rest = F.substring(plain_path(F.col("path")), len(root.rstrip("/")) + 1, 1_000_000)
    keep = suffix_of(F.col("path")).isin(*fixed.LOG_SUFFIXES) & ~rest.rlike(r"/\.")
    if max_bytes > 0:
        keep = keep & (F.col("length") <= max_bytes)
    return (found.filter(keep).withColumn("format", format_of(F.col("path")))
            .withColumn("service_name", service_from_path(F.col("path"), root)))


def discover(spark: SparkSession, root: str, max_bytes: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    """The log files under root, by path (see log_files). File content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return log_files(found, root, max_bytes).orderBy("path")


def file_hashes(spark: SparkSession, paths: list[str], whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """path, length, SHA-256 of the files that can be read whole; those that cannot have no row, which the ingest job
    reports. Files above `whole_bytes` are hashed in pieces, so a task never holds one as a value."""
    def load(some, fmt, **options):
        return spark.read.options(ignoreCorruptFiles="true", ignoreMissingFiles="true", **options).format(fmt).load(some)

    found = load(paths, "binaryFile")
    small = found.filter(F.col("length") <= whole_bytes).select("path", "length", F.sha2("content", 256).alias("file_hash"))
    large = found.filter(F.col("length") > whole_bytes).select("path", "length")
    names = [r.path for r in large.select("path").collect()]  # file names only
    if not names:
        return small
    meta = F.col("_metadata")
    lines = load(names, "text", lineSep="\n").select(
        meta["file_path"].alias("name"), meta["file_size"].alias("size"), meta["file_block_start"].alias("start"),
        F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("piece"))
    pieces = lines.mapInArrow(_joined_lines, lines.schema)
    hashed = pieces.repartition("name").sortWithinPartitions("name", "start", "n").mapInPandas(
        _hashed_pieces, "name string, size long, file_hash string")
    same = (plain_path(F.col("path")) == decoded_path(F.col("name"))) & (F.col("length") == F.col("size"))
    return small.unionByName(large.join(hashed, same).select("path", "length", "file_hash"))


def _joined_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring lines of a part of a file as one row of about PIECE_BYTES."""
    for batch in batches:
        name, piece = batch["name"].dictionary_encode().indices.to_numpy(), batch["piece"]
        at = np.cumsum(pc.binary_length(piece).to_numpy().astype(np.int64)) // PIECE_BYTES
        new = np.any([x[1:] != x[:-1] for x in (name, batch["start"].to_numpy(), at)], axis=0)
        first = np.flatnonzero(np.concatenate([[True], new])) if len(at) else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), piece)
        joined = pc.binary_join(lists, pa.scalar(b"\n", piece.type))
        yield pa.RecordBatch.from_arrays([joined if c == "piece" else batch[c].take(pa.array(first)) for c in batch.schema.names], batch.schema.names)


def _hashed_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The SHA-256 of each file from its pieces in order. The reader takes a byte order mark from the first line and does
    not tell whether the last one ends; the size of the file does. Files that were not read to the end have no row."""
    name = None

    def ended():
        rest = size - read
        if rest in (0, 1, 3, 4):
            state = marked if rest >= 3 else plain
            state.update(b"\n" * (rest % 3))
            yield pd.DataFrame({"name": [name], "size": [size], "file_hash": [state.hexdigest()]})

    for batch in batches:
        for at, whole, piece in batch[["name", "size", "piece"]].itertuples(index=False):
            if at != name:
                if name is not None:
                    yield from ended()
                name, size, read = at, whole, len(piece)
                plain, marked = hashlib.sha256(piece), hashlib.sha256(codecs.BOM_UTF8 + piece)
            else:
                for state in (plain, marked):
                    state.update(b"\n")
                    state.update(piece)
                read += 1 + len(piece)
    if name is not None:
        yield from ended()


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """One path (the first by name) per content hash that the ledger does not hold."""
    one = files.groupBy("file_hash").agg(F.min(F.struct("path", "length")).alias("f"))
    return one.select("file_hash", "f.path", "f.length").join(ledger.select("file_hash"), "file_hash", "left_anti")


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """value, file_path for every line that is not blank. Bad bytes decode to the replacement mark."""
    lines = spark.read.option("recursiveFileLookup", "true").text(paths)
    return lines.select(F.regexp_replace("value", r"[\r\n]+$", "").alias("value"),
                        decoded_path(F.col("_metadata.file_path")).alias("file_path")
                        ).filter(F.col("value").rlike(r"\S"))


def read_csv_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """fields (map header -> text), file_path. Files are read per distinct header line."""
    first = (spark.read.text(paths)
             .filter(F.col("_metadata.file_block_start") == 0)
             .select(F.col("_metadata.file_path").alias("p"), "value", F.monotonically_increasing_id().alias("n"))
             .groupBy("p").agg(F.min_by("value", "n").alias("header")))
    groups = first.groupBy("header").agg(F.collect_list("p").alias("paths")).collect()  # file names only
    out = None
    for g in sorted(groups, key=lambda r: r.header):
        names = next(iter(_split_header(g.header)), [])
        cols = [f"c{i}" for i in range(len(names))]
        raw = (spark.read.schema(", ".join(f"{c} string" for c in cols))
               .option("header", "true").option("enforceSchema", "true").option("escape", '"').csv(g.paths))
        unique = [(n, c) for i, (n, c) in enumerate(zip(names, cols)) if n not in names[:i]]
        part = raw.select(
            F.map_from_arrays(F.array(*[F.lit(n) for n, _ in unique]), F.array(*[F.col(c) for _, c in unique])).alias("fields"),
            decoded_path(F.col("_metadata.file_path")).alias("file_path"))
        out = part if out is None else out.unionByName(part)
    return out


def _split_header(line: str):
    import csv
    return csv.reader([line.lstrip("﻿")])
