"""Reports: severity, performance, trend, service health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def severity_breakdown(logs: DataFrame, sample_mod: int | None = None) -> DataFrame:
    """Rows per severity. With `sample_mod` = m only every m-th id is counted and the counts are
    scaled to the exact number of filtered rows."""
    if not sample_mod or sample_mod <= 1:
        return logs.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))
    picked = F.pmod(F.col("id"), F.lit(sample_mod)) == 0
    counts = logs.groupBy("severity").agg(F.count(F.lit(1)).alias("_all"), F.count_if(picked).alias("_picked"))
    totals = counts.agg(F.sum("_all").alias("_n"), F.sum("_picked").alias("_m")).withColumn("_k", F.lit(1))
    return (counts.filter(F.col("_picked") > 0).withColumn("_k", F.lit(1)).join(totals, "_k")
            .select("severity", F.floor(F.col("_picked") * F.col("_n") / F.col("_m")).cast("bigint").alias("count")))


def performance_metrics(logs: DataFrame, templates: DataFrame) -> DataFrame:
    """One row with totals, rates, severity bands and template coverage."""
    sev = F.col("severity")
    a = logs.agg(
        F.count(F.lit(1)).alias("total_logs"), F.count_distinct("service_name").alias("services_count"),
        F.count_if(sev == 5).alias("critical"), F.count_if(sev == 4).alias("error"),
        F.count_if(sev == 3).alias("warning"), F.count_if(sev.isin(1, 2)).alias("info"),
        F.count_if(sev == 0).alias("debug")).withColumn("_k", F.lit(1))
    b = templates.agg(F.count(F.lit(1)).alias("total_templates"),
                      F.count_if(F.col("embedding_state") == "ready").alias("embedded_templates")
                      ).withColumn("_k", F.lit(1))

    def share(part, whole, scale, digits):
        return F.when(F.col(whole) > 0, F.round(part / F.col(whole) * scale, digits)).otherwise(0.0)

    return a.join(b, "_k").drop("_k").withColumns({
        "error_rate": share(F.col("critical") + F.col("error"), "total_logs", 100, 2),
        "warning_rate": share(F.col("warning"), "total_logs", 100, 2),
        "embedding_coverage": share(F.col("embedded_templates"), "total_templates", 100, 1),
        "template_efficiency": share(F.col("total_logs"), "total_templates", 1, 1),
    })


def hourly_trend(logs: DataFrame, n: int = 24) -> DataFrame:
    """Rows and errors of the latest n hours that have rows, oldest first."""
    hours = logs.groupBy(F.date_trunc("hour", "timestamp_utc").alias("hour")).agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("severity") >= 4).alias("errors"))
    return hours.orderBy(F.col("hour").desc()).limit(n).orderBy("hour")


def service_health(logs: DataFrame, n: int | None = None) -> DataFrame:
    """Status per service from its error rate, largest services first; all of them, or the n largest."""
    agg = logs.groupBy("service_name").agg(
        F.count(F.lit(1)).alias("total_logs"), F.count_if(F.col("severity") >= 4).alias("errors"),
        F.count_if(F.col("severity") == 3).alias("warnings"), F.max("timestamp_utc").alias("last_seen"))
    rate = F.col("errors") / F.col("total_logs") * 100
    status = F.when(rate < 1, "healthy").when(rate < 5, "warning").when(rate < 10, "degraded").otherwise("critical")
    out = (agg.withColumn("status", status).withColumn("error_rate", F.round(rate, 2))
           .orderBy(F.col("total_logs").desc(), "service_name"))
    return out if n is None else out.limit(n)


def health_summary(health: DataFrame) -> DataFrame:
    return health.groupBy("status").agg(F.count(F.lit(1)).alias("services"))


def full_report(logs: DataFrame, templates: DataFrame) -> dict[str, DataFrame]:
    """The report sections, each a DataFrame."""
    from logloom.operators import security
    return {
        "performance": performance_metrics(logs, templates),
        "severity": severity_breakdown(logs),
        "trend": hourly_trend(logs),
        "health": service_health(logs),
        "security": security.security_report(logs),
    }


def full_report_row(logs: DataFrame, templates: DataFrame) -> DataFrame:
    """The report as one row of struct columns."""
    from logloom.operators import security

    def one(df, name):
        return df.select(F.struct(*df.columns).alias(name)).withColumn("_k", F.lit(1))

    health = service_health(logs)
    statuses = health_summary(health).agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("status", "services")))).alias("health")).withColumn("_k", F.lit(1))
    return (one(performance_metrics(logs, templates), "performance")
            .join(one(security.security_report(logs), "security"), "_k")
            .join(statuses, "_k").drop("_k"))
