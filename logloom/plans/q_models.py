"""Registered queries: classification, training and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom import fixed
from logloom.functions import labels
from logloom.operators import classify as C
from logloom.operators import svm
from logloom.operators import training as Z
from logloom.plans.logview import more, with_logs
from logloom.plans.q_anomaly import HEUR, NAME_SQL, _heuristic, rounded
from logloom.plans.q_functions import _entity_sql, _tokens_sql, sql_any, sql_case
from logloom.plans.registry import query
from logloom.session import materialize

TF = [f"tk AS (SELECT id, {_tokens_sql('body_raw')} AS w FROM logs)",
      "tc AS (SELECT id, term, count(*) AS c FROM (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))) AS term FROM tk) GROUP BY ALL)",
      "vo AS (SELECT term, df, ln(((SELECT count(*) FROM logs) + 1) / (df + 1)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tc GROUP BY term HAVING count(*) >= 2 ORDER BY df DESC, term LIMIT 5000))",
      "tw AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM (SELECT id, term, (1 + ln(c)) * idf AS w FROM tc JOIN vo USING (term)))"]


def _tfidf(t):
    v = materialize(C.tfidf_fit(t.wide_logs, "id", "body_raw"), "vocabulary")  # used twice
    return v, C.tfidf_transform(t.wide_logs, "id", "body_raw", v)


@query("tfidf_vocabulary", more(*TF) + "SELECT term, df, round(idf, 6) AS idf FROM vo")
def _(t):
    return rounded(_tfidf(t)[0], "idf")


@query("tfidf_weights", more(*TF) + "SELECT id, term, round(weight, 6) AS weight FROM tw")
def _(t):
    return rounded(_tfidf(t)[1], "weight")


CATEGORY = sql_case(fixed.CATEGORY_WORDS, "normal", "lower(body_raw)")
NB = [f"lb AS (SELECT id, {CATEGORY} AS label FROM logs)",
      "su AS (SELECT label, term, sum(weight) AS s FROM tw JOIN lb USING (id) GROUP BY ALL)",
      """cl AS (SELECT label, ln(n / sum(n) OVER ()) AS prior, ln(1 / (coalesce(t, 0) + (SELECT count(*) FROM vo))) AS dflt FROM
 (SELECT label, count(*) AS n FROM lb GROUP BY label) LEFT JOIN (SELECT label, sum(s) AS t FROM su GROUP BY label) USING (label))""",
      """sc AS (SELECT l.id, cl.label, prior + coalesce(tot, 0) * dflt + coalesce(g, 0) AS s FROM logs l CROSS JOIN cl
 LEFT JOIN (SELECT id, sum(weight) AS tot FROM tw GROUP BY id) a ON a.id = l.id
 LEFT JOIN (SELECT id, label, sum(weight * ln(s + 1)) AS g FROM tw JOIN su USING (term) GROUP BY ALL) b ON b.id = l.id AND b.label = cl.label)""",
      "pr AS (SELECT id, arg_max(label, s) AS label, 1 / sum(exp(s - m)) AS conf FROM (SELECT *, max(s) OVER (PARTITION BY id) AS m FROM sc) GROUP BY id)"]


def _nb(t):
    """The model, and id, category, label and confidence of every row."""
    v = materialize(C.tfidf_fit(t.wide_logs, "id", "body_raw"), "vocabulary")
    terms, idf = C.numbered(v)
    labelled = t.wide_logs.select("id", "body_raw", labels.keyword_labels(F.col("body_raw"), F.col("service_name"))["category"].alias("category"))
    rows = materialize(C.tfidf_vectors(labelled, "body_raw", terms, idf).select("id", "category", "_x"), "weights")  # used by the fit and the prediction
    model = C.nb_fit(rows, v, "category")
    return model, lambda: C.nb_score(rows, model, len(terms))


@query("naive_bayes_classes", more(*TF, *NB) + "SELECT label, round(prior, 6) AS log_prior, round(dflt, 6) AS log_default FROM cl")
def _(t):
    return rounded(_nb(t)[0][0], "log_prior", "log_default")


@query("naive_bayes_predict", more(*TF, *NB) + "SELECT id, label, round(conf, 6) AS confidence FROM pr")
def _(t):
    return rounded(_nb(t)[1]().select("id", "label", "confidence"), "confidence")


METRICS = """me AS (SELECT truth, sum(n)::BIGINT AS support, sum(n) FILTER (truth = pred) / any_value(p) AS precision, sum(n) FILTER (truth = pred) / sum(n) AS recall FROM cm
  JOIN (SELECT pred AS truth, sum(n) AS p FROM cm GROUP BY pred) USING (truth) GROUP BY truth)"""


@query("class_metrics", more(*TF, *NB, "cm AS (SELECT lb.label AS truth, pr.label AS pred, count(*) AS n FROM lb JOIN pr USING (id) GROUP BY ALL)",
 """tr AS (SELECT truth, sum(n)::BIGINT AS support, coalesce(sum(n) FILTER (truth = pred), 0) AS tp FROM cm GROUP BY truth)""",
 """me AS (SELECT truth, support, tp, CASE WHEN coalesce(p, 0) > 0 THEN tp / p ELSE 0 END AS pre, tp / support AS rec FROM tr LEFT JOIN (SELECT pred AS truth, sum(n) AS p FROM cm GROUP BY pred) USING (truth))""",
 "mf AS (SELECT *, CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END AS f FROM me)") + """
SELECT truth, support, round(pre, 6)::DOUBLE AS precision, round(rec, 6)::DOUBLE AS recall, round(f, 6)::DOUBLE AS f1,
 round(sum(tp) OVER () / sum(support) OVER (), 6)::DOUBLE AS accuracy, round(avg(f) OVER (), 6)::DOUBLE AS macro_f1 FROM mf""")
def _(t):
    out = Z.class_metrics(_nb(t)[1](), "label", "category")
    return rounded(out.drop("macro_precision", "macro_recall"), "precision", "recall", "f1", "accuracy", "macro_f1")


@query("confusion_matrix", more(*TF, *NB) + "SELECT lb.label AS truth, pr.label AS predicted, count(*) AS n FROM lb JOIN pr USING (id) GROUP BY ALL")
def _(t):
    return Z.confusion(_nb(t)[1](), "label", "category")


TRUTH = f"(name IN ('ERROR', 'CRITICAL') OR {sql_any('lower(body_raw)', fixed.ERROR_WORDS)})"


@query("binary_metrics", more(HEUR) + f"""
SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives, round(rate, 6) AS anomaly_rate, round(tp / (tp + fp), 6) AS precision,
 round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT count_if(is_anomaly AND {TRUTH})::BIGINT AS tp, count_if(is_anomaly AND NOT {TRUTH})::BIGINT AS fp,
 count_if(NOT is_anomaly AND {TRUTH})::BIGINT AS fn, count_if(NOT is_anomaly AND NOT {TRUTH})::BIGINT AS tn, avg(CASE WHEN is_anomaly THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM heur)""")
def _(t):
    rows = _heuristic(t).withColumn("truth", Z.anomaly_truth("name", "body_raw"))
    return rounded(Z.binary_metrics(rows, "is_anomaly", "truth"), "anomaly_rate", "precision", "recall", "f1")


@query("roc_points", more("""r AS (SELECT s, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM (SELECT (id % 101) / 101 * 0.6::DOUBLE + CASE WHEN severity >= 4 THEN 0.3::DOUBLE ELSE 0 END AS sc,
  round(((id % 101) / 101 * 0.6::DOUBLE + CASE WHEN severity >= 4 THEN 0.3::DOUBLE ELSE 0 END) * 1e9) AS s, CASE WHEN severity >= 4 THEN 1 ELSE 0 END AS y FROM logs) GROUP BY s)""",
 "q AS (SELECT s, p, n, sum(p) OVER w AS rp, sum(n) OVER w AS rn, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM r WINDOW w AS (ORDER BY s DESC))") + """
SELECT round(s / 1e9::DOUBLE, 6) AS threshold, round(rp / tp, 6) AS tpr, round(rn / tn, 6) AS fpr, round((SELECT sum(n * (2 * rp - p) / (2 * tp * tn)) FROM q), 6) AS auc FROM q""")
def _(t):
    rows = t.wide_logs.select(((F.col("id") % 101) / 101 * 0.6 + F.when(F.col("severity") >= 4, 0.3).otherwise(0.0)).alias("s"),
                         (F.col("severity") >= 4).cast("int").alias("y"))
    return rounded(Z.roc_points(rows, "s", "y"), "threshold", "tpr", "fpr", "auc")


ROC_SCORE = "(id % 101) / 101 * 0.6::DOUBLE + CASE WHEN service_name = c THEN 0.2::DOUBLE ELSE 0 END"


@query("roc_one_vs_rest", more(f"""r AS (SELECT c, s, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM (SELECT c, round(({ROC_SCORE}) * 1e9) AS s,
  CASE WHEN service_name = c THEN 1 ELSE 0 END AS y FROM logs, (SELECT DISTINCT service_name AS c FROM logs)) GROUP BY c, s)""",
 "q AS (SELECT c, s, p, n, sum(p) OVER w AS rp, sum(n) OVER w AS rn, sum(p) OVER a AS tp, sum(n) OVER a AS tn FROM r WINDOW w AS (PARTITION BY c ORDER BY s DESC), a AS (PARTITION BY c))") + """
SELECT c AS class, count(*) AS points, round(max(rp / tp), 6) AS last_tpr, round(sum(n * (2 * rp - p) / (2 * tp * tn)), 6) AS auc FROM q GROUP BY c""")
def _(t):
    names = t.logs.select(F.col("service_name").alias("class")).distinct()
    classes = F.array(*[F.lit(r["class"]) for r in names.orderBy("class").collect()])  # the classes of a model
    rows = t.wide_logs.select("id", "service_name", F.explode(classes).alias("class")).select(
        "class", (F.col("service_name") == F.col("class")).cast("int").alias("y"),
        ((F.col("id") % 101) / 101 * 0.6 + F.when(F.col("service_name") == F.col("class"), 0.2).otherwise(0.0)).alias("s"))
    points = Z.roc_points(rows, "s", "y", by=["class"])
    return rounded(points.groupBy("class").agg(F.count(F.lit(1)).alias("points"), F.max("tpr").alias("last_tpr"), F.first("auc").alias("auc")), "last_tpr", "auc")


@query("tune_threats")
def _(t):
    # the log view's own words for attacks
    table, _ = Z.tune_threats(t.wide_logs, ["union select", "failed password", "refused"])
    return rounded(table, "train_auc", "train_accuracy", "validation_auc", "validation_accuracy")


@query("category_from_severity", with_logs(f"""
SELECT id, CASE WHEN severity >= 4 THEN 'error' WHEN severity = 3 THEN 'warning' WHEN {sql_any('lower(body_raw)', ['security', 'attack'])} THEN 'security' ELSE 'normal' END AS category,
 {sql_case(fixed.TEXT_DOMAIN_WORDS, 'application', 'lower(body_raw)')} AS domain, round((0.8::DOUBLE + 0.6::DOUBLE + 0.8::DOUBLE) / 3, 6) AS mean_confidence FROM logs"""))
def _(t):
    rows = t.wide_logs.withColumn("name", labels.model_severity_name(F.col("severity"))).withColumn("c", F.lit(0.8))
    return rounded(C.classify_from_severity(rows, "name", "c", "body_raw"), "mean_confidence").select(
        "id", "category", "domain", "mean_confidence")


@query("heuristic_classify", with_logs(f"""
SELECT id, {CATEGORY} AS category, {sql_case(fixed.DOMAIN_WORDS, 'application', 'lower(body_raw)', 'service_name')} AS domain,
 {sql_case(fixed.LABEL_SEVERITY_WORDS, 'info', 'lower(body_raw)')} AS severity_label, 0.6::DOUBLE AS confidence, {_entity_sql('ip_address')} FROM logs"""))
def _(t):
    return C.heuristic_classify(t.wide_logs).select("id", "category", "domain", "severity_label", "confidence", F.coalesce(
        F.array_join(F.try_element_at("entities", F.lit("ip_address")), " "), F.lit("")).alias("ip_address"))


def _levels(t):
    return t.wide_logs.select("id", "body_raw", labels.keyword_labels(F.col("body_raw"), F.col("service_name"))["severity"].alias("level"))


@query("svm_predict")
def _(t):
    rows = _levels(t)
    return rounded(svm.svm_predict(rows, svm.svm_fit(rows, "id", "body_raw", "level"), "id", "body_raw"), "confidence")


@query("svm_update")
def _(t):
    """A model of one half of the rows, updated with the other half."""
    rows = _levels(t)
    model = svm.svm_fit(rows.filter("id % 2 = 0"), "id", "body_raw", "level")
    model = svm.svm_update(model, rows.filter("id % 2 = 1"), "id", "body_raw", "level")
    return rounded(svm.svm_predict(rows, model, "id", "body_raw"), "confidence")


GIVEN_LABELS = ["error", "info", "warning"]
GIVEN = ["gw AS (SELECT k, label, term, ((df * k + length(term)) % 11 - 5) / 10::DOUBLE AS w FROM vo, (VALUES (1, 'error'), (2, 'info'), (3, 'warning')) v(k, label))",
         """gm AS (SELECT l.id, g.k, g.label, (g.k - 2) / 4::DOUBLE + coalesce(s, 0) AS m FROM logs l CROSS JOIN (SELECT DISTINCT k, label FROM gw) g
 LEFT JOIN (SELECT id, label, sum(weight * w) AS s FROM tw JOIN gw USING (term) GROUP BY ALL) x ON x.id = l.id AND x.label = g.label)"""]


def _given_model(t):
    """Weights that a formula gives, over the vocabulary of the rows."""
    v = materialize(C.tfidf_fit(t.wide_logs, "id", "body_raw"), "vocabulary")
    classes = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(x).alias("label")) for i, x in enumerate(GIVEN_LABELS)])
    inner = v.select("term", "df", F.explode(classes).alias("c")).select(
        "c.label", "term", (((F.col("df") * F.col("c.k") + F.length("term")) % 11 - 5) / 10.0).alias("weight"))
    bias = t.spark.createDataFrame([(x, None, (i - 1) / 4) for i, x in enumerate(GIVEN_LABELS)], "label string, term string, weight double")
    return svm.Svm(v, materialize(inner.unionByName(bias), "given"), GIVEN_LABELS)


@query("svm_score", more(*TF, *GIVEN) + """
SELECT id, arg_max(label, round(m, 9)) AS label, round(1 / (1 + exp(-max(abs(m)))), 6) AS confidence FROM (SELECT * FROM gm ORDER BY id, k) GROUP BY id""")
def _(t):
    return rounded(svm.svm_predict(t.wide_logs, _given_model(t), "id", "body_raw"), "confidence")


@query("classify_rows")
def _(t):
    out = C.classify(t.wide_logs, C.train_classifiers(t.wide_logs))
    return rounded(out.select("id", "category", "domain", "severity_label", "confidence"), "confidence")


@query("stratified_split", with_logs("""
SELECT severity, CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) AS train, count(*) - CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) AS test FROM logs GROUP BY severity"""))
def _(t):
    train, test = Z.split(t.wide_logs, 0.8, "severity")
    a = train.groupBy("severity").agg(F.count(F.lit(1)).alias("train"))
    return a.join(test.groupBy("severity").agg(F.count(F.lit(1)).alias("test")), "severity")


@query("proportional_sample", with_logs("""
SELECT service_name, least(n, greatest(1000, CAST(floor(n / sum(n) OVER () * 5000) AS BIGINT)))::BIGINT AS rows FROM (SELECT service_name, count(*) AS n FROM logs GROUP BY service_name)"""))
def _(t):
    return Z.proportional_sample(t.wide_logs, 5000, 7).groupBy("service_name").agg(F.count(F.lit(1)).alias("rows"))


@query("export_sample", with_logs("SELECT least(count(*), 500)::BIGINT AS rows FROM logs"))
def _(t):
    return Z.export_sample(t.wide_logs, 500, 7).agg(F.count(F.lit(1)).alias("rows"))


@query("training_source", with_logs(f"""
SELECT id, {sql_case(fixed.MESSAGE_SEVERITY_WORDS, 'INFO', 'lower(body_raw)')} AS severity,
 {sql_case([(d, [n.lower()]) for n, d in fixed.DATASET_DOMAINS.items()], 'application', "concat('open', service_name)")} AS domain FROM logs"""))
def _(t):
    rows = t.wide_logs.select("id", F.col("body_raw").alias("message"), F.concat(F.lit("Open"), "service_name").alias("source"))
    return Z.training_source(rows).select("id", "severity", "domain")


def _documents(t):
    """Documents with their quality label."""
    rows = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", F.col("quality").cast("string").alias("quality")), "doc_id")
    return materialize(rows, "documents")


@query("tune_models")
def _(t):
    found = Z.tune(_documents(t), "text", "quality")
    rows = [(name, i, float(s)) for name, r in found.items() for i, s in enumerate(r["scores"])]
    return t.spark.createDataFrame(rows, "model string, setting int, score double")


@query("learning_curve")
def _(t):
    rows = Z.learning_curve(_documents(t), Z.TextAccuracy("text", "quality"), id_col="doc_id")
    return t.spark.createDataFrame([(float(f), float(s)) for f, s in rows], "fraction double, score double")


@query("train_behavioural")
def _(t):
    """The confusion of the detector, and the accuracy of all three classifiers in each row."""
    found = Z.train_behavioural(t.wide_logs)
    right = [F.lit(float(v)).alias(f"{name}_accuracy") for name, v in found.accuracy.items()]
    return rounded(found.scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")).select("*", *right),
                   *[f"{name}_accuracy" for name in found.accuracy])


@query("analyze_rows")
def _(t):
    models, test = Z.train_all(t.wide_logs)
    return Z.analysis_summary(Z.analyze(test, models))
