"""Keyword security metrics: hits, counts, examples, score, risk, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import fixed
from logloom.functions.text import first_contained
from logloom.scale import top_n

CATEGORIES = list(fixed.SECURITY_RULES)


def security_sample(logs: DataFrame, high: int = 5000, low: int = 5000, max_services: int = 20) -> DataFrame:
    """The `high` most severe recent rows (severity 3 up), then recent low rows per service. The
    reports do not use it: they read every row."""
    top = (logs.filter(F.col("severity") >= 3)
           .orderBy(F.col("severity").desc(), F.col("timestamp_utc").desc(), F.col("id").desc()).limit(high))
    names = logs.groupBy("service_name").agg(F.count(F.lit(1)).alias("_n"))
    quota = names.agg(F.greatest(F.lit(500), F.floor(F.lit(low) / F.greatest(F.count(F.lit(1)), F.lit(1))))
                      .alias("_quota")).withColumn("_k", F.lit(1))
    chosen = names.orderBy("service_name").limit(max_services).withColumn("_k", F.lit(1)).join(quota, "_k")
    rest = logs.filter(F.col("severity") < 3).join(chosen.select("service_name", "_quota"), "service_name")
    cut = top_n(rest, ["service_name"], [F.col("timestamp_utc").desc(), F.col("id").desc()], max(500, low))
    return top.unionByName(cut.filter(F.col("rn") <= F.col("_quota")).select(*logs.columns))


def _lowered(logs: DataFrame) -> DataFrame:
    return logs.withColumn("_low", F.lower(F.coalesce("body_raw", F.lit(""))))


def first_keywords(low: Column) -> dict[str, Column]:
    """Per category the first keyword in the lower-cased text, or null."""
    return {cat: first_contained(low, words) for cat, (_, words) in fixed.SECURITY_RULES.items()}


def keyword_hits(logs: DataFrame) -> DataFrame:
    """One row per (log row, category) that matches, with the first keyword in list order."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), k.alias("matched_keyword"))
                      for c, k in first_keywords(F.col("_low")).items()])
    # explode_outer: a plain explode makes Catalyst repeat the whole keyword match in a filter
    hits = _lowered(logs).withColumn("_hit", F.explode_outer(pairs)).filter(F.col("_hit.matched_keyword").isNotNull())
    return hits.select(*logs.columns, "_hit.category", "_hit.matched_keyword")


def category_counts(logs: DataFrame) -> DataFrame:
    """category, hits for every category, also those without a hit. One scan, one row shuffled
    per task."""
    flags = first_keywords(F.col("_low"))
    wide = _lowered(logs).agg(*[F.count_if(k.isNotNull()).alias(c) for c, k in flags.items()])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("hits")) for c in CATEGORIES]))
    return wide.select(cells.alias("_c")).select("_c.category", "_c.hits")


def category_examples(logs: DataFrame, n: int = 5) -> DataFrame:
    """The n most severe, newest rows per category, message cut at 300 characters."""
    order = [F.col("severity").desc(), F.col("timestamp_utc").desc(), F.col("id").desc()]
    return top_n(keyword_hits(logs), ["category"], order, n).select(
        "category", "rn", "id", F.substring("body_raw", 1, 300).alias("message"), "timestamp_utc",
        "service_name", "severity", "matched_keyword")


def score_columns(counts: dict[str, Column], total: Column) -> dict[str, Column]:
    weighted = F.lit(0)
    for cat, (boost, _) in fixed.SECURITY_RULES.items():
        weighted = weighted + counts[cat] * boost
    ratio = F.when(total > 0, weighted / total).otherwise(0.0)
    return {"score": F.greatest(F.lit(0.0), 100 - F.least(ratio * 100, F.lit(100.0)))}


def risk_level(score: Column, counts: dict[str, Column]) -> Column:
    out = F.when(F.lit(False), "CRITICAL")
    for cat, limit in fixed.CRITICAL_COUNTS.items():
        out = out.when(counts[cat] > limit, "CRITICAL")
    for name, floor in fixed.RISK_FLOORS:
        out = out.when(score >= floor, name)
    return out.otherwise("CRITICAL")


def recommendations(counts: dict[str, Column], risk: Column) -> Column:
    """Recommendation codes, the critical one first; `none` when nothing applies."""
    picks = [F.when(risk == "CRITICAL", F.lit("immediate_review"))]
    picks += [F.when(counts[cat] > limit, F.lit(code)) for code, cat, limit in fixed.RECOMMENDATION_COUNTS]
    found = F.array_compact(F.array(*picks))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none")))


def security_report(logs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Category counts, events, analysed rows, score, risk and recommendations, per group."""
    flags = first_keywords(F.col("_low"))
    agg = _lowered(logs).groupBy(*by).agg(F.count(F.lit(1)).alias("total_logs_analyzed"),
                                *[F.count_if(k.isNotNull()).alias(c) for c, k in flags.items()])
    return score_report(agg)


def score_report(counts_row: DataFrame) -> DataFrame:
    """Score, risk and recommendations from category count columns and total_logs_analyzed."""
    counts = {c: F.col(c) for c in CATEGORIES}
    events = counts[CATEGORIES[0]]
    for c in CATEGORIES[1:]:
        events = events + counts[c]
    scored = counts_row.withColumn("total_security_events", events).withColumn(
        "_score", score_columns(counts, F.col("total_logs_analyzed"))["score"])
    return (scored.withColumn("security_score", F.round("_score", 1))
            .withColumn("risk_level", risk_level(F.col("_score"), counts))
            .withColumn("recommendations", recommendations(counts, F.col("risk_level"))).drop("_score"))


def affected_services(logs: DataFrame, n: int = 10) -> DataFrame:
    return (logs.filter(F.col("severity") >= 4).groupBy("service_name").agg(F.count(F.lit(1)).alias("error_count"))
            .orderBy(F.col("error_count").desc(), "service_name").limit(n))
