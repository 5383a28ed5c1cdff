"""Small helpers that the operators of this package share."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import materialize

WORD = re.compile(r"\w+")


_stores: dict = {}


def worker_store(key, make):
    """What a Python worker keeps from task to task. It keeps one such store at a time, so that the
    stores of operators that run one after the other do not add up."""
    if key not in _stores:
        _stores.clear()
        _stores[key] = make()
    return _stores[key]


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a whole text; none for a null text."""
    return WORD.findall(text.lower()) if text else []


def fresh(columns: list[str], base: str) -> str:
    """A column name that no column of the input has (names differ in case only: taken)."""
    taken, name = {c.lower() for c in columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def hash_pair(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes, which together name a value without practical collisions."""
    return [F.xxhash64(F.lit(11), *cols), F.xxhash64(F.lit(29), *cols)]


def with_row_id(docs: DataFrame, file: str = "_f", row: str = "_r") -> DataFrame:
    """Adds the place of each row (hash of its file, index in the file). The place is the same in
    every scan and every retry, also where ids are null or repeat. Anything but a plain file scan
    is written to the shared folder first."""
    def placed(df: DataFrame) -> DataFrame:
        return df.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))

    try:
        return placed(docs)
    except AnalysisException:
        return placed(materialize(docs, "rows"))


def drop_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose place is not in `gone` (_gone_f, _gone_r)."""
    f, r = fresh(docs.columns, "_gone_f"), fresh(docs.columns, "_gone_r")
    placed = with_row_id(docs, f, r)
    return placed.join(gone.toDF(f, r), [f, r], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
