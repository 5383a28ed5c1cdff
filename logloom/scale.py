"""Building blocks that keep ordered and windowed work balanced when one key holds a large
share of the rows. They replace per-key windows over raw rows by windows over small buckets
plus prefix sums over bucket totals, and give the same answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket_of(at: Column, grain: int) -> Column:
    return F.floor(at / F.lit(grain)).cast("long")


def _same(keys: list[str], left: str, right: str) -> Column:
    conds = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda a, b: a & b, conds)


def running_totals(points: DataFrame, keys: list[str], at: str, values: list[str], grain: int,
                   tie: str | None = None) -> DataFrame:
    """Adds run_<value>: the cumulative sum per key up to and including `at` (then `tie`).

    `at` is a long. Rows are windowed inside buckets of `grain`; the totals of earlier buckets
    come from a window over one row per (key, bucket)."""
    b = points.withColumn("_b", bucket_of(F.col(at), grain))
    totals = b.groupBy(*keys, "_b").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", *[
        F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    order = [F.col(at)] + ([F.col(tie)] if tie else [])
    inside = W.partitionBy(*keys, "_b").orderBy(*order).rangeBetween(W.unboundedPreceding, W.currentRow)
    ran = b.withColumns({f"_r_{v}": F.sum(v).over(inside) for v in values})
    joined = ran.alias("x").join(offsets.alias("o"), _same(keys + ["_b"], "x", "o"), "left")
    return joined.select(
        *[F.col(f"x.{c}") for c in points.columns],
        *[(F.col(f"_r_{v}") + F.col(f"_o_{v}")).alias(f"run_{v}") for v in values])


def trailing_sums(points: DataFrame, keys: list[str], at: str, values: list[str], window: int,
                  grain: int) -> DataFrame:
    """Sum of each value over rows of the key with at - window <= row <= at, one row per
    (key, at). The sum is C(at) - C(before at - window), both from one running total: every
    point also emits a probe at the window start that sorts before real rows of that instant."""
    ticks = points.groupBy(*keys, at).agg(*[F.sum(v).alias(v) for v in values])
    both = ticks.withColumn("_p", F.explode(F.array(F.lit(1), F.lit(0)))).select(
        *keys, F.col(at).alias("_own"), "_p",
        F.when(F.col("_p") == 1, F.col(at)).otherwise(F.col(at) - window).alias("_at"),
        *[F.when(F.col("_p") == 1, F.col(v)).otherwise(F.lit(0)).alias(v) for v in values])
    ran = running_totals(both, keys, "_at", values, grain, tie="_p")
    return ran.groupBy(*keys, F.col("_own").alias(at)).agg(*[
        (F.sum(F.when(F.col("_p") == 1, F.col(f"run_{v}")).otherwise(-F.col(f"run_{v}")))).alias(v)
        for v in values])


def trailing_distinct(rows: DataFrame, keys: list[str], item: str, at: str, window: int, grain: int,
                      kinds: dict[str, Column] | None = None) -> DataFrame:
    """Distinct items of the key seen in [at - window, at], one row per (key, at); `kinds` adds
    the same count limited to items that meet a condition.

    An item is visible from each sighting until `window` later. Sightings of one item within a
    cell of `window` always overlap, so a cell is one segment; segments that touch are joined,
    and the count is the number of starts up to `at` less the number of ends before it."""
    counts = {"distinct_items": F.lit(True), **(kinds or {})}
    cells = (rows.groupBy(*keys, item, bucket_of(F.col(at), window).alias("_c"))
             .agg(F.min(at).alias("_lo"), F.max(at).alias("_hi")))
    per_item = W.partitionBy(*keys, item).orderBy("_c")
    seg = (cells.withColumn("_prev", F.lag("_hi").over(per_item))
           .withColumn("_next", F.lead("_lo").over(per_item)))
    starts = seg.filter(F.col("_prev").isNull() | (F.col("_lo") - F.col("_prev") > window)).select(
        *keys, item, F.col("_lo").alias("_at"), F.lit(1).alias("_s"))
    ends = seg.filter(F.col("_next").isNull() | (F.col("_next") - F.col("_hi") > window)).select(
        *keys, item, (F.col("_hi") + window).alias("_at"), F.lit(-1).alias("_s"))
    changes = starts.unionByName(ends).select(
        *keys, "_at", F.when(F.col("_s") == 1, 0).otherwise(2).alias("_p"),
        *[F.when(cond, F.col("_s")).otherwise(0).cast("long").alias(name) for name, cond in counts.items()])
    changes = changes.groupBy(*keys, "_at", "_p").agg(*[F.sum(n).alias(n) for n in counts])
    probes = rows.select(*keys, F.col(at).alias("_at")).distinct().select(
        *keys, "_at", F.lit(1).alias("_p"), *[F.lit(0).cast("long").alias(n) for n in counts])
    ran = running_totals(changes.unionByName(probes), keys, "_at", list(counts), grain, tie="_p")
    return ran.filter(F.col("_p") == 1).select(
        *keys, F.col("_at").alias(at), *[F.col(f"run_{n}").alias(n) for n in counts])


def positions(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "position",
              total: str | None = "total") -> DataFrame:
    """Adds the 1-based position of each row in its key by `order`, and the key's row count.
    `bucket` must not fall as `order` rises. Only one bucket of one key is ever sorted together."""
    b = df.withColumn("_b", bucket)
    totals = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"),
                            F.sum("_n").over(W.partitionBy(*keys)).alias("_all"))
    ran = b.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)))
    joined = ran.alias("x").join(offsets.alias("o"), _same(keys + ["_b"], "x", "o"))
    out = joined.select(*[F.col(f"x.{c}") for c in df.columns], (F.col("_rn") + F.col("_o")).alias(name),
                        *([F.col("_all").alias(total)] if total else []))
    return out


def lagged(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, n: int,
           prefix: str = "prev") -> DataFrame:
    """Adds prev_1..prev_n: `value` of the 1st..n-th earlier row of the key by `order`.

    Lags run inside a bucket; the first n rows of a bucket look into the tail carried over from
    the buckets before it (every bucket has a row, so n earlier buckets are enough)."""
    b = df.withColumn("_b", bucket).withColumn("_v", F.struct(value.alias("v")))
    inside = W.partitionBy(*keys, "_b").orderBy(*order)
    b = b.withColumn("_rn", F.row_number().over(inside)).withColumns(
        {f"_l{i}": F.lag("_v", i).over(inside) for i in range(1, n + 1)})
    last = W.partitionBy(*keys, "_b").orderBy(*[F.col(o).desc() for o in order])
    tails = (df.withColumn("_b", bucket).withColumn("_v", F.struct(value.alias("v")))
             .withColumn("_k", F.row_number().over(last)).filter(F.col("_k") <= n)
             .groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(F.struct("_k", "_v"))).alias("_t")))
    by_bucket = W.partitionBy(*keys).orderBy("_b")
    # newest first: the bucket just before, then the one before that
    carried = F.concat(*[F.coalesce(F.lag("_t", i).over(by_bucket), F.expr("filter(_t, x -> false)"))
                         for i in range(1, n + 1)])
    tails = tails.select(*keys, "_b", F.slice(carried, 1, n).alias("_tail"))
    joined = b.alias("x").join(tails.alias("t"), _same(keys + ["_b"], "x", "t"), "left")
    outs = []
    for i in range(1, n + 1):
        from_tail = F.try_element_at(F.col("_tail"), (F.lit(i) - F.col("_rn") + 1).cast("int"))["_v"]
        outs.append(F.when(F.col("_rn") > i, F.col(f"_l{i}")).otherwise(from_tail)["v"].alias(f"{prefix}_{i}"))
    return joined.select(*[F.col(f"x.{c}") for c in df.columns], *outs)


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], slices: int = 64) -> DataFrame:
    """Linear-interpolated quantiles per group: one row per group with q_0, q_1, ...

    Values are first counted (group, value), so work follows the distinct values; the counts
    are cut into about equal slices by an approximate sketch and prefix-summed, so no single
    task sorts a whole group."""
    if not by:
        return exact_quantiles(df.withColumn("_g", F.lit(0)), ["_g"], value, probs, slices).drop("_g")
    hist = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    cuts = [i / slices for i in range(1, slices)]
    edges = hist.groupBy(*by).agg(F.percentile_approx(value, cuts, 1000).alias("_e"),
                                  F.sum("_n").alias("_all"))
    h = hist.alias("x").join(edges.alias("e"), _same(by, "x", "e")).select(
        *[F.col(f"x.{c}") for c in by + [value, "_n"]], "_e", "_all")
    h = h.withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col(value))))
    totals = h.groupBy(*by, "_b").agg(F.sum("_n").alias("_tn"))
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*by, "_b", F.coalesce(F.sum("_tn").over(before), F.lit(0)).alias("_o"))
    ran = h.withColumn("_r", F.sum("_n").over(W.partitionBy(*by, "_b").orderBy(value)))
    joined = ran.alias("x").join(offsets.alias("o"), _same(by + ["_b"], "x", "o"))
    pos = joined.select(*[F.col(f"x.{c}") for c in by], F.col(f"x.{value}").cast("double").alias("_v"), "_all",
                        (F.col("_o") + F.col("_r")).alias("_hi"),
                        (F.col("_o") + F.col("_r") - F.col("_n")).alias("_lo"))
    aggs = []
    for i, p in enumerate(probs):
        at = (F.col("_all") - 1) * F.lit(p)
        below, above = F.floor(at), F.ceil(at)
        low = F.max(F.when((F.col("_lo") <= below) & (below < F.col("_hi")), F.col("_v")))
        high = F.max(F.when((F.col("_lo") <= above) & (above < F.col("_hi")), F.col("_v")))
        part = F.max(at - below)
        aggs.append((low + (high - low) * part).alias(f"q_{i}"))
    return pos.groupBy(*by).agg(*aggs)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rn") -> DataFrame:
    """The first n rows of each key. Spark cuts each partition to n rows per key before the
    shuffle (WindowGroupLimit) while n is at most 1000. For a larger n the rows are first cut per
    (key, scan partition group), so that a hot key is not sorted in one task; the second cut makes
    the answer exact whatever the grouping."""
    if n > 1000:
        parts = df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(256)))
        first = W.partitionBy(*keys, "_part").orderBy(*order)
        df = parts.withColumn("_first", F.row_number().over(first)).filter(F.col("_first") <= n).drop("_part", "_first")
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
