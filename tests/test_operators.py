import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators import anomaly, classify, forecast, forest, security, svm, templates, training, vectors
from logloom.plans.registry import QUERIES, Tables

SMALL = "/root/testdata/sf0.001"


def log_rows(spark, lines, service="svc"):
    rows = [(i, "org-1", service, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), 2, m) for i, m in enumerate(lines)]
    return spark.createDataFrame(rows, "id long, tenant_id string, service_name string, timestamp_utc timestamp, severity int, body_raw string")


# --- template mining --------------------------------------------------------------------
def test_similar_lines_share_a_template(spark):
    out = {r.id: r for r in templates.mine_templates(log_rows(spark, [
        "User alice logged in from 192.168.1.100", "User bob logged in from 10.0.0.1",
        "Error connecting to database", "   "])).collect()}
    assert out[0].template_text == out[1].template_text == "User <*> logged in from <*>"
    assert out[0].template_hash == out[1].template_hash != out[2].template_hash
    assert out[0].parameters == ["alice", "192.168.1.100"]
    assert out[3].template_text == "<*>"


def test_hash_differs_by_service(spark):
    a = templates.mine_templates(log_rows(spark, ["same text"], "service1")).first().template_hash
    b = templates.mine_templates(log_rows(spark, ["same text"], "service2")).first().template_hash
    assert a != b and -2**63 <= a < 2**63


def test_mining_does_not_depend_on_partitions(spark):
    lines = [f"task {w} finished stage {'abcdefgh'[i % 8]} on node {i % 5}" for i, w in enumerate(["alpha", "beta", "gamma", "delta"] * 30)]
    logs = log_rows(spark, lines)
    results = []
    for n in (1, 7):
        results.append(sorted((r.id, r.template_text) for r in templates.mine_templates(logs.repartition(n)).collect()))
    assert results[0] == results[1]


def test_hot_group_is_merged_in_parts(spark):
    lines = [f"job {a}{b} moved to {b}{a} queue" for a in "abcdefghij" for b in "klmnopqrst"]
    out = templates.mine_templates(log_rows(spark, lines), group_limit=10)
    got = {r.template_text for r in out.select("template_text").distinct().collect()}
    assert got == {"job <*> moved to <*> queue"}


# --- security ---------------------------------------------------------------------------
@pytest.mark.parametrize("score,suspicious,brute,want", [
    (95.0, 0, 0, "LOW"), (50.0, 100, 0, "CRITICAL"), (95.0, 0, 21, "CRITICAL"), (75.0, 0, 0, "MEDIUM"), (20.0, 0, 0, "CRITICAL")])
def test_risk_level(spark, score, suspicious, brute, want):
    counts = {c: F.lit(0) for c in security.CATEGORIES}
    counts["suspicious_access"], counts["brute_force_indicators"] = F.lit(suspicious), F.lit(brute)
    assert spark.range(1).select(security.risk_level(F.lit(score), counts).alias("r")).first().r == want


def test_security_report_rows(spark):
    logs = log_rows(spark, ["Failed password for root", "connection refused by peer", "all good"])
    r = security.security_report(logs).first()
    assert r.total_logs_analyzed == 3 and r.authentication_failures > 0 and r.network_issues > 0


# --- vectors ----------------------------------------------------------------------------
def test_topk_against_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 48)).astype(np.float32)
    q = np.vstack([m[0] + 0.01 * rng.normal(size=48), m[5] * 100]).astype(np.float32)
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "vec_id long, vector array<float>").repartition(5)
    asked = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "query_id long, vector array<float>")
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    want = np.argsort(-(unit(q.astype(float)) @ unit(m.astype(float)).T), axis=1)[:, :4]
    for limit in (10, 1):
        out = vectors.vector_topk(v, asked, 4, broadcast_limit=limit).orderBy("query_id", "rank").collect()
        assert [[r.vec_id for r in out if r.query_id == j] for j in (0, 1)] == want.tolist()
    assert want[0][0] == 0 and want[1][0] == 5


def test_wrong_dimension_is_rejected(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    with pytest.raises(Exception, match="vector dimension"):
        vectors.vector_topk(v, q, 1).collect()


# --- forest -----------------------------------------------------------------------------
def test_forest_scores(spark):
    f = anomaly.frequency_features(Tables(spark, SMALL).logs)
    cols = ["severity_level", "message_length"]
    a = forest.forest_fit(f.repartition(1), cols, n_trees=20)
    b = forest.forest_fit(f.repartition(6), cols, n_trees=20)
    x, y = (m.nodes.sort_values(["tree", "node"]).to_numpy(dtype=float) for m in (a, b))
    assert x.shape == y.shape and np.allclose(x, y)  # means may differ in the last digit
    r = forest.forest_score(f, a).agg(F.min("anomaly_score").alias("lo"), F.max("anomaly_score").alias("hi"),
                                      F.avg(F.col("is_anomaly").cast("int")).alias("share")).first()
    assert 0 < r.lo <= r.hi <= 1 and r.share <= 0.11


def test_forest_finds_the_outlier(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(300)] + [(999, 500.0, 500.0)], "id long, a double, b double")
    model = forest.forest_fit(rows, ["a", "b"], n_trees=40, contamination=0.01)
    top = forest.forest_score(rows, model).orderBy(F.col("anomaly_score").desc()).first()
    assert top.id == 999


# --- forecasts --------------------------------------------------------------------------
def test_recurrences(spark):
    values = [3.0, 5.0, 4.0, 8.0, 9.5]
    s = spark.createDataFrame([("x", dt.datetime(2024, 1, 1, i), v) for i, v in enumerate(values)] + [("y", dt.datetime(2024, 1, 1), 1.0)],
                              "series string, bucket_ts timestamp, value double")
    level, trend, flat = values[0], values[1] - values[0], values[0]
    for v in values[1:]:
        before = level
        level = 0.3 * v + 0.7 * (level + trend)
        trend = 0.1 * (level - before) + 0.9 * trend
        flat = 0.3 * v + 0.7 * flat
    got = {r.series: r for r in forecast.holt_state(s).collect()}
    assert (got["x"].level, got["x"].trend) == pytest.approx((level, trend)) and not got["y"].fitted
    assert {r.series: r.level for r in forecast.ses_state(s).collect()}["x"] == pytest.approx(flat)
    assert {r.forecast for r in forecast.holt(s, horizon=2).filter("series = 'y'").collect()} == {0.0}


# --- training ---------------------------------------------------------------------------
def test_split_is_exact_and_repeatable(spark):
    df = spark.range(1000).withColumn("c", (F.col("id") % 4 == 0).cast("string"))
    train, test = training.split(df, 0.8, "c")
    assert {r.c: r["count"] for r in train.groupBy("c").count().collect()} == {"true": 200, "false": 600}
    again = training.split(df.repartition(7), 0.8, "c")[0]
    assert train.exceptAll(again).isEmpty() and train.join(test, "id").isEmpty()


def test_auc_matches_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rng = np.random.default_rng(1)
    rows = [(float(round(s, 2)), float(rng.random() < s)) for s in rng.random(500)]
    df = spark.createDataFrame(rows, "score double, label double")
    auc = training.roc_points(df, "score", "label").first().auc
    assert auc == pytest.approx(BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(df), abs=1e-6)


def test_too_few_rows(spark):
    with pytest.raises(ValueError):
        training.train_all(log_rows(spark, ["a"] * 20))
    assert training.fit_gap(0.95, 0.8) == "overfit"


def test_report_counts_every_service(spark):
    from logloom.operators import metrics
    rows = spark.range(150).selectExpr("concat('svc', id) AS service_name", "1 AS severity", "timestamp'2024-01-01' AS timestamp_utc")
    assert metrics.health_summary(metrics.service_health(rows)).first()["services"] == 150


def test_template_merge_in_parts_finds_all_pairs(spark):
    from logloom.operators import templates
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu"]
    lines = [(i, "svc", f"job {w} {w}x {w}y {w}z {v}", "2024-01-01 00:00:00") for i, (w, v) in enumerate((w, v) for w in words for v in ("red", "blue", "green"))]
    logs = spark.createDataFrame(lines, "id long, service_name string, body_raw string, ts string").withColumn(
        "timestamp_utc", F.col("ts").cast("timestamp"))
    found = {n: sorted(r[0] for r in templates.mine_templates(logs, group_limit=n).select("template_text").distinct().collect())
             for n in (4, 50)}
    assert found[4] == found[50] and len(found[50]) == 12


def test_equal_texts_get_equal_ngram_scores_whatever_the_ids(spark):
    from logloom.operators import threats
    rows = spark.createDataFrame([(None, "a😀bcd"), (1, "a😀bcd"), (1, "zz"), (2, None)], "id long, body_raw string")
    model = spark.createDataFrame([("a😀b", 1.0), ("bcd", 0.5), ("zz", 9.0)], "ngram string, score double")
    got = threats.with_injection(rows, "body_raw", model).select("body_raw", "ngram_score").collect()
    assert sorted((str(r[0]), r[1]) for r in got) == [("None", 0.0), ("a😀bcd", 1.5), ("a😀bcd", 1.5), ("zz", 0.0)]


def test_every_waiting_template_is_embedded_and_searched_in_every_tenant(spark, monkeypatch):
    from types import SimpleNamespace

    from logloom.operators import vectors
    import logloom.plans.catalog  # noqa: F401
    from logloom.plans import q_templates
    rows = [(f"org-{i % 3}", "api", i, f"text number {i}", "queued" if i % 2 else "none") for i in range(1_100)]
    made = spark.createDataFrame(rows, "tenant_id string, service_name string, template_hash long, template_text string, embedding_state string")
    made = made.withColumn("last_seen_utc", F.lit("2024-01-01").cast("timestamp"))
    done, found = vectors.embed_pending(made, n=None)
    assert done.filter("embedding_state = 'ready'").count() == found.count() == 1_100
    asked = {}
    whole = vectors.embed_pending
    monkeypatch.setattr(q_templates.V, "embed_pending", lambda t, n=1000, **k: asked.update(n=n) or whole(t, n=n, **k))
    q_templates._embedded(SimpleNamespace(templates=made))
    assert asked["n"] is None
    stub = "0L AS query_id", "1 AS rank", "0D AS score", "service_name", "template_text", "0L AS count", "array(0L) AS sample_ids", "0D AS relevance"

    def search(*args, tenant=None, **options):
        asked.setdefault("tenants", []).append(tenant)
        return made.selectExpr(*stub)

    monkeypatch.setattr(q_templates.V, "semantic_search", search)
    monkeypatch.setattr(q_templates.V, "evidence", search)
    for name in ("semantic_search", "evidence"):
        QUERIES[name](spark, SMALL)
    assert asked["tenants"] == [None, None]


def test_models_are_trained_over_the_whole_job_by_default(spark, monkeypatch):
    from inspect import signature

    def defaults(fn):
        return {k: p.default for k, p in signature(fn).parameters.items()}

    assert len(defaults(training.tune)["alphas"]) == 5 and len(defaults(training.tune)["cs"]) == 4
    assert [defaults(training.tune)[k] for k in ("folds", "strength_folds", "max_iter")] == [5, 3, 500]
    assert [defaults(training.train_behavioural)[k] for k in ("trees", "classifier_trees")] == [200, 100]
    assert defaults(training.train_all)["n_trees"] == 100 and defaults(svm.svm_fit)["passes"] == 1000
    from logloom.plans import q_anomaly, q_models
    _, model = q_anomaly._forest(Tables(spark, SMALL))
    assert model.nodes["tree"].nunique() == 100 and model.nodes["feature"].max() == 4
    seen = []
    monkeypatch.setattr(q_models.Z, "learning_curve", lambda df, fit, fractions=defaults(training.learning_curve)["fractions"], **k: [
        (f, seen.append(f) or 0.0) for f in fractions])
    QUERIES["learning_curve"](spark, SMALL)
    assert len(seen) == 10
