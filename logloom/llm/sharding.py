"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logloom.llm.common import hash_pair
from logloom.scale import positions
from logloom.session import materialize

#: Rows of a shard that are put in order together in the second permutation.
SLICE_ROWS = 5_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows, taken without replacement, are among the `good` ones. The smallest
    count whose cumulative probability passes a uniform number, summed outwards from the mode, so
    that the work follows the spread and not the number of rows."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    peak = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - peak
    up, down, p_up, p_down = mode, mode, peak, peak
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if p_up < 1e-18 and p_down < 1e-18:
            break
    return mode


def communication_matrix(sources: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """How many rows each source sends to each shard in a uniform shuffle: row sums are the source
    sizes, column sums the shard sizes. Each cell is drawn given all cells before it."""
    rng, left, out = random.Random(seed), list(shards), []
    for size in sources:
        row, draws, rest = [], size, sum(left)
        for k, room in enumerate(left):
            n = hypergeometric(rng, room, rest - room, draws)
            row.append(n)
            draws, rest = draws - n, rest - room
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def _shuffled(*cols: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def shard_rows(df: DataFrame, shards: int = 40, seed: int = 17, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard). Shard sizes differ
    by one at most, and every split of the rows is equally likely.

    The rows are written once to the shared folder together with the partition they came from, so
    that a retry sees the same partitions. Only the row count of each partition goes to the driver,
    which draws the matrix. Rows are permuted inside their partition, cut into shards by the running
    sums of its matrix row, and permuted again inside the shard. Repeated rows stay apart; nulls are
    ordinary values; an empty table stays empty. A column that is named shard or slot is replaced."""
    df = df.drop("shard", "slot")
    names = df.columns
    df = df.toDF(*[f"c{i}" for i in range(len(names))])  # no name of the input can clash with those used here
    part, rank, order, cuts, slot = "part", "rank", "order", "cuts", "position"
    held = materialize(df.withColumn(part, F.spark_partition_id()), "shards")
    counts = sorted((r[0], r[1]) for r in held.groupBy(part).count().collect())
    total = sum(n for _, n in counts)
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    rows = []
    for (p, _), row in zip(counts, matrix):
        ends, at = [], 0
        for n in row[:-1]:
            at += n
            ends.append(at)
        rows.append((p, ends))
    plan = materialize(df.sparkSession.createDataFrame(rows, f"`{part}` int, `{cuts}` array<bigint>"), "plan")
    everything = [F.col(c) for c in df.columns]
    local = held.withColumn(rank, F.row_number().over(
        W.partitionBy(part).orderBy(_shuffled(*everything, seed=seed), *_tie(everything))))
    sent = local.join(plan, part).withColumn(
        "shard", F.size(F.filter(cuts, lambda c: c < F.col(rank))).cast("int")).drop(rank, cuts)
    sent = sent.withColumn(order, _shuffled(F.col(part), *everything, seed=seed + 1)).drop(part)
    slices = max(1, math.ceil(total / shards / slice_rows))
    placed = positions(sent, ["shard"], [order], F.floor((F.col(order) / F.lit(2.0 ** 64) + 0.5) * slices), slot, None)
    return placed.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "shard", (F.col(slot) - 1).alias("slot"))


def _tie(cols: list[Column]) -> list[Column]:
    return hash_pair(*cols)


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 17, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Shard and slot of each document by the law `rows`: doc_id, size (UTF-8 bytes of the text plus
    16; a null text has none), text_crc32 (of the UTF-8 bytes; 0 for a null text), law, shard, slot,
    grown_shard (null under this law)."""
    text = F.col(text_col).cast("string")
    digests = docs.select(
        F.col(id_col), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    return shard_rows(digests, shards, seed).select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
