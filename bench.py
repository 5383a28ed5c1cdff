"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logloom.plans import catalog  # noqa: E402
from logloom.session import build_session  # noqa: E402

HEADLINE = [
    "query_logs", "top_templates", "template_detail", "service_health", "performance_metrics", "hourly_trend",
    "security_score", "keyword_hits", "mine_fast", "mine_templates", "vector_topk", "stat_baseline", "frequency_features",
    "forest_score", "tfidf_weights", "naive_bayes_predict", "bruteforce_detect", "recon_detect", "injection_patterns",
    "injection_detect", "detect_threats", "holt_forecast", "seasonal_factors", "failure_forecast",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    queries["service_health"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    took = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    spark.stop()
    sf = float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": sf, "log_rows": rows, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
