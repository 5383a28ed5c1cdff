"""Sampling, splitting, training jobs and evaluation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, IDF, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom import fixed
from logloom.functions.features import behaviour_features, threat_features, with_columns
from logloom.functions.labels import model_severity_name
from logloom.functions.text import contains_any, log_tokens, word_ngrams
from logloom.operators import anomaly, classify, forest, tfidf, threats
from logloom.scale import positions, running_totals
from logloom.session import discard, materialize, spread

MIN_TRAINING_ROWS = 100
#: Rows that a task of a tuning fit reads in each pass.
FIT_ROWS = 2_000
#: Shares of the training rows in a learning curve.
FRACTIONS = tuple(i / 10 for i in range(1, 11))


def hashed_positions(df: DataFrame, keys: list[str], seed: int, id_col: str = "id") -> DataFrame:
    """Adds _pos and _all: the place of each row in a seeded random order of its key."""
    h = df.withColumn("_h", F.xxhash64(F.col(id_col), F.lit(seed)))
    return positions(h, keys, ["_h", id_col], F.shiftright("_h", 46), "_pos", "_all").drop("_h")


def split(df: DataFrame, ratio: float = 0.8, strat: str | None = None, seed: int = 42, id_col: str = "id"
          ) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the exact ratio in each class of `strat`; the same rows every time."""
    placed = hashed_positions(df, [strat] if strat else [], seed, id_col)
    cut = F.floor(F.col("_all") * ratio)
    return (placed.filter(F.col("_pos") <= cut).drop("_pos", "_all"), placed.filter(F.col("_pos") > cut).drop("_pos", "_all"))


def export_sample(logs: DataFrame, n: int, seed: int, path: str | None = None, id_col: str = "id") -> DataFrame:
    """n random rows by a seeded hash, written as CSV when a path is given."""
    rows = logs.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)
    if path:
        flat = rows.select(*[c for c, t in rows.dtypes if not t.startswith(("array", "map", "struct"))])
        flat.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    return rows


def proportional_sample(logs: DataFrame, n: int, seed: int, services: int = 30, minimum: int = 1000, id_col: str = "id") -> DataFrame:
    """Random rows of the largest services, in proportion to their size, at least `minimum` each."""
    counts = (logs.groupBy("service_name").agg(F.count(F.lit(1)).alias("_n"))
              .orderBy(F.col("_n").desc(), "service_name").limit(services))
    total = counts.agg(F.sum("_n").alias("_t")).withColumn("_k", F.lit(1))
    quota = counts.withColumn("_k", F.lit(1)).join(total, "_k").select("service_name", F.greatest(
        F.lit(minimum), F.floor(F.col("_n") / F.col("_t") * n)).alias("_quota"))
    placed = hashed_positions(logs.join(quota, "service_name"), ["service_name"], seed, id_col)
    return placed.filter(F.col("_pos") <= F.col("_quota")).select(*logs.columns)


# --- evaluation -------------------------------------------------------------------------
def confusion(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Per true class precision, recall, f1, support, plus accuracy and macro averages on each row.
    All sums run on the confusion table (classes x classes rows)."""
    cells = confusion(df, predicted, truth)
    hit = F.col("truth") == F.col("predicted")
    by_truth = cells.groupBy("truth").agg(F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    by_pred = cells.groupBy(F.col("predicted").alias("truth")).agg(F.sum("n").alias("_p"))
    c = by_truth.join(by_pred, "truth", "left").na.fill(0)
    p = F.when(F.col("_p") > 0, F.col("tp") / F.col("_p")).otherwise(0.0)
    c = c.withColumn("precision", p).withColumn("recall", F.col("tp") / F.col("support"))
    s = F.col("precision") + F.col("recall")
    c = c.withColumn("f1", F.when(s > 0, 2 * F.col("precision") * F.col("recall") / s).otherwise(0.0))
    every = W.partitionBy()
    return c.select("truth", "support", "precision", "recall", "f1",
                    (F.sum("tp").over(every) / F.sum("support").over(every)).alias("accuracy"),
                    *[F.avg(m).over(every).alias(f"macro_{m}") for m in ("precision", "recall", "f1")])


def binary_metrics(df: DataFrame, flag: str, truth: str) -> DataFrame:
    p, t = F.col(flag).cast("boolean"), F.col(truth).cast("boolean")
    m = df.agg(F.count_if(p & t).alias("true_positives"), F.count_if(p & ~t).alias("false_positives"),
               F.count_if(~p & t).alias("false_negatives"), F.count_if(~p & ~t).alias("true_negatives"),
               F.coalesce(F.avg(p.cast("double")), F.lit(0.0)).alias("anomaly_rate"))
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    m = m.withColumn("precision", F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)).withColumn(
        "recall", F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0))
    s = F.col("precision") + F.col("recall")
    return m.withColumn("f1", F.when(s > 0, 2 * F.col("precision") * F.col("recall") / s).otherwise(0.0))


def anomaly_truth(severity_name: str, message: str):
    """Truth for anomaly evaluation: an error level or an error word."""
    return F.col(severity_name).isin("ERROR", "CRITICAL") | contains_any(F.lower(F.col(message)), fixed.ERROR_WORDS)


def roc_points(df: DataFrame, score: str, label: str, by: list[str] = ()) -> DataFrame:
    """threshold, tpr, fpr, auc per distinct score (to 9 digits), from the highest. `by` gives one
    curve per group, as for one-vs-rest."""
    by = list(by)
    keys = by or ["_g"]
    rows = df if by else df.withColumn("_g", F.lit(0))
    y = F.col(label).cast("double")
    ticks = rows.groupBy(*keys, F.round(-F.col(score) * 1e9).cast("long").alias("_at")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    ran = running_totals(ticks, keys, "_at", ["pos", "neg"], 10_000_000)
    totals = ticks.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    ran = ran.join(totals, keys)
    area = ran.groupBy(*keys).agg(F.sum(F.col("neg") * (2 * F.col("run_pos") - F.col("pos")) / (2 * F.col("_p") * F.col("_n"))).alias("auc"))
    return ran.join(area, keys).select(*by, (-F.col("_at") / 1e9).alias("threshold"), (F.col("run_pos") / F.col("_p")).alias("tpr"),
                                       (F.col("run_neg") / F.col("_n")).alias("fpr"), "auc")


def nested(df: DataFrame, fractions: Sequence[float], seed: int = 42, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(train, test), each stored once. _since of a train row is the least of `fractions` whose subset holds it."""
    train, test = split(df, 0.8, None, seed, id_col)
    placed = hashed_positions(train, [], seed, id_col)
    since = F.coalesce(*[F.when(F.col("_pos") <= F.col("_all") * f, F.lit(float(f))) for f in sorted(fractions)])
    placed = placed.withColumn("_since", since).filter("_since IS NOT NULL").drop("_pos", "_all")
    return materialize(placed, "curve-train"), materialize(test, "curve-test")


@dataclass(frozen=True)
class TextAccuracy:
    """For learning_curve: the accuracy of naive Bayes over term weights. See text_curve."""

    text: str
    label: str

    def curve(self, df: DataFrame, fractions: Sequence[float], seed: int, id_col: str) -> list[tuple[float, float]]:
        return text_curve(df, self.text, self.label, fractions, seed, id_col)


def learning_curve(df: DataFrame, fit_score, fractions: Sequence[float] = FRACTIONS, seed: int = 42, id_col: str = "id"):
    """[(fraction, score)] over nested subsets; fit_score(train, test) -> number, or an object whose `curve` makes all scores
    in one go."""
    if hasattr(fit_score, "curve"):
        return fit_score.curve(df, fractions, seed, id_col)
    train, test = nested(df, fractions, seed, id_col)
    return [(f, fit_score(train.filter(F.col("_since") <= float(f)).drop("_since"), test)) for f in fractions]


def text_curve(df: DataFrame, text: str, label: str, fractions: Sequence[float] = FRACTIONS, seed: int = 42, id_col: str = "id"):
    """[(fraction, accuracy)] of naive Bayes over term weights: the learning_curve of tfidf_fit, nb_fit and nb_score. The texts
    are read once for the vocabularies of all fractions and once for the counts of their terms; every fit starts from the counts."""
    train, test = nested(df.select(id_col, text, label), fractions, seed, id_col)
    train, test = spread(train), spread(test)
    steps = [float(f) for f in fractions]
    models = [tfidf.numbered(v) for v in tfidf.nested_fits(train, text, "_since", steps)]
    every = sorted({t for terms, _ in models for t in terms})  # at most MAX_FEATURES a fraction
    train, test = (materialize(tfidf.term_counts(part, text, every).drop(text), "curve-counts") for part in (train, test))
    out = []
    for f, (terms, idf) in zip(fractions, models):
        fitted = tfidf.weigh_counts(train.filter(F.col("_since") <= float(f)), "_counts", every, terms, idf)
        model = tuple(materialize(m, "nb-model") for m in classify.nb_fit(fitted, len(terms), label))
        scored = classify.nb_score(tfidf.weigh_counts(test.withColumnRenamed(label, "_truth"), "_counts", every, terms, idf), model, len(terms))
        out.append((f, scored.agg(F.avg((F.col("label") == F.col("_truth")).cast("double"))).first()[0]))
        discard(*model)
    return out


# --- training jobs ----------------------------------------------------------------------
def _text_stages(min_df: float):
    return [CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=5000, minDF=min_df),
            IDF(inputCol="_tf", outputCol="features")]


def text_features(df: DataFrame, text: str, label: str, min_df: float = 2.0):
    """features and _y columns for a text classifier, and the class names."""
    rows = df.withColumn("_grams", word_ngrams(log_tokens(F.col(text))))
    for stage in _text_stages(min_df):
        rows = stage.fit(rows).transform(rows)
    index = StringIndexer(inputCol=label, outputCol="_y").fit(rows)
    return index.transform(rows), index.labels


def tune(df: DataFrame, text: str, label: str, alphas=(0.001, 0.01, 0.1, 1.0, 10.0), cs=(0.01, 0.1, 1.0, 10.0), folds: int = 5,
         strength_folds: int = 3, max_iter: int = 500, seed: int = 42) -> dict:
    """Cross-validated naive Bayes smoothing (`folds`) and logistic strength (`strength_folds`), with the mean scores. The
    features are stored once, in parts of about FIT_ROWS rows; the fits of a fold run side by side, as each is many short passes."""
    rows, _ = text_features(spread(df), text, label)
    rows = materialize(rows.select("features", "_y"), "tune-features")
    rows = materialize(rows.repartition(max(1, math.ceil(rows.count() / FIT_ROWS))), "tune-parts")
    metric = MulticlassClassificationEvaluator(labelCol="_y", metricName="accuracy")
    nb = NaiveBayes(labelCol="_y")
    lr = LogisticRegression(labelCol="_y", maxIter=max_iter, elasticNetParam=0.15)
    out = {}
    for name, est, grid, parts in (
            ("naive_bayes", nb, ParamGridBuilder().addGrid(nb.smoothing, list(alphas)).build(), folds),
            ("logistic", lr, ParamGridBuilder().addGrid(lr.regParam, [1 / c / 100 for c in cs]).build(), strength_folds)):
        fitted = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=metric, numFolds=parts, seed=seed,
                                parallelism=len(grid)).fit(rows)
        out[name] = {"model": fitted.bestModel, "scores": list(fitted.avgMetrics)}
    return out


def fit_gap(train_score: float, validation_score: float, limit: float = 0.10) -> str:
    gap = train_score - validation_score
    return "overfit" if gap > limit else "underfit" if validation_score < 0.6 else "good"


THREAT_STRENGTHS = (0.00001, 0.0001, 0.001, 0.01)


def auc_of(scored: DataFrame, score: str, label: str) -> float | None:
    """Area under the curve of roc_points; null where one class is missing."""
    first = roc_points(scored, score, label).limit(1).collect()
    return first[0]["auc"] if first else None


def tune_threats(logs: DataFrame, words: Sequence[str] = tuple(fixed.THREAT_TRUTH_WORDS),
                 strengths: Sequence[float] = THREAT_STRENGTHS, l1_ratio: float = 0.15, max_iter: int = 500, seed: int = 42, id_col: str = "id") -> tuple[DataFrame, object]:
    """Rows with one of `words` are threats. An elastic-net logistic model over the scaled threat features for each strength, trained on four fifths of each
    class: (one row per strength with the scores of both sides, the fit verdict and which one is chosen by the
    validation AUC, of equal ones the weakest; the chosen model). Rows whose label all share give no model."""
    pairs = threat_features(F.col("body_raw"), model_severity_name(F.col("severity")))
    truth = contains_any(F.lower("body_raw"), list(words)).cast("double")
    rows = logs.filter(F.col("body_raw").isNotNull()).select(id_col, truth.alias("label"), *[F.coalesce(c, F.lit(0)).cast("double").alias(n) for n, c in pairs])
    train, test = (materialize(part, "threat-rows") for part in split(rows, 0.8, "label", seed, id_col))
    if train.select("label").distinct().count() < 2:
        raise ValueError("threat tuning needs rows of both classes")
    vec = VectorAssembler(inputCols=[n for n, _ in pairs], outputCol="_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(vec.transform(train))
    sides = {name: scaler.transform(vec.transform(part)).select("label", "features") for name, part in (("train", train), ("validation", test))}
    out, best = [], None
    for strength in strengths:
        model = LogisticRegression(regParam=strength, elasticNetParam=l1_ratio, maxIter=max_iter).fit(sides["train"])
        scores = {}
        for name, part in sides.items():
            scored = materialize(model.transform(part).select("label", "prediction", vector_to_array("probability")[1].alias("score")), "threat-scores")
            hit = scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
            scores[name] = (auc_of(scored, "score", "label"), hit)
            discard(scored)
        out.append((strength, *scores["train"], *scores["validation"], fit_gap(scores["train"][1], scores["validation"][1])))
        reached = scores["validation"][0] or 0.0
        if best is None or reached > best[0]:
            best = (reached, strength, model)
    table = logs.sparkSession.createDataFrame(
        [(*r, r[0] == best[1]) for r in out],
        "strength double, train_auc double, train_accuracy double, validation_auc double, validation_accuracy double, fit string, chosen boolean")
    return table, PipelineModel([vec, scaler, best[2]])


@dataclass
class Retrained:
    """What train_behavioural trains. `scored`: the test rows of the detector with label and prediction, `auc` over them;
    `accuracy`: the share of right test rows of the detector (behaviour), severity and service."""

    detector: PipelineModel
    labeller: forest.ForestModel
    outliers: forest.ForestModel
    vocabulary: DataFrame
    severity: tuple[DataFrame, DataFrame]
    service: tuple[DataFrame, DataFrame]
    scored: DataFrame
    auc: float
    accuracy: dict[str, float]


def text_classifiers(rows: DataFrame, text: str, targets: Sequence[str], seed: int = 42, id_col: str = "id") -> tuple[DataFrame, dict, dict]:
    """Naive Bayes models of each column of `targets` over the term weights of `text`, trained on four fifths of the rows:
    the vocabulary (of all rows), the model of each target, and its share of right answers on the other fifth."""
    vocabulary = materialize(tfidf.content_fit(rows, text), "vocabulary")
    terms, idf = tfidf.numbered(vocabulary)
    vectors = tfidf.tfidf_vectors(rows, text, terms, idf, found=tfidf.content_grams(F.col(text)), damped=False)
    train, test = (materialize(part, "weights") for part in split(vectors.select(id_col, *targets, "_x"), 0.8, None, seed, id_col))
    models, right = {}, {}
    for target in targets:
        models[target] = tuple(materialize(part, "nb-model") for part in classify.nb_fit(train, len(terms), target))
        scored = classify.nb_score(test.select(F.col(target).alias("_truth"), "_x"), models[target], len(terms))
        right[target] = scored.agg(F.avg((F.col("label") == F.col("_truth")).cast("double"))).first()[0]
    discard(train, test)
    return vocabulary, models, right


def train_behavioural(logs: DataFrame, contamination: float = 0.05, trees: int = 200, classifier_trees: int = 100, seed: int = 42,
                      outlier_share: float = 0.1, outlier_trees: int = 100) -> Retrained:
    """The whole retraining job. An isolation forest over severity, length and template; naive Bayes for severity and service over
    term weights; and the behavioural detector: an isolation forest over 14 behaviour features, severity and length gives
    pseudo-labels, on which a balanced random forest of the scaled features is trained. Rows without a message, severity or
    service count as empty, 1 and unknown."""
    rows = logs.withColumns({"body_raw": F.coalesce("body_raw", F.lit("")), "severity": F.coalesce("severity", F.lit(1)),
                             "service_name": F.coalesce("service_name", F.lit("unknown"))})
    rows = rows.withColumn("_level", F.col("severity").cast("double"))
    shapes = rows.select("id", "_level", F.length("body_raw").cast("double").alias("_chars"), F.coalesce(
        F.pmod(F.xxhash64("template_hash"), F.lit(10_000)), F.lit(0)).cast("double").alias("_template"))
    outliers = forest.forest_fit(shapes, ["_level", "_chars", "_template"], n_trees=outlier_trees, contamination=outlier_share, seed=seed, standard=True)
    vocabulary, texts, right = text_classifiers(rows.withColumn("_level", F.col("severity").cast("string")), "body_raw", ["_level", "service_name"], seed)

    feats = with_columns(rows, behaviour_features(F.col("body_raw"))).withColumn("_len", F.length("body_raw") / 100.0)
    names = fixed.BEHAVIOUR_FEATURES
    labeller, marked = forest.forest_fit_score(feats.select("id", *names, "_level", "_len"), names + ["_level", "_len"], n_trees=trees,
                                               contamination=contamination, seed=seed, standard=True)
    marked = marked.withColumn("label", F.col("is_anomaly").cast("double"))
    share = marked.agg(F.avg("label")).first()[0] or 0.5
    share = min(max(share, 1e-6), 1 - 1e-6)
    marked = marked.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    vec = VectorAssembler(inputCols=names, outputCol="_raw")
    assembled = vec.transform(marked)
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(assembled)
    train, test = split(scaler.transform(assembled), 0.8, "label", seed)
    model = RandomForestClassifier(maxDepth=15, minInstancesPerNode=10, numTrees=classifier_trees, weightCol="weight", seed=seed).fit(train)
    scored = materialize(model.transform(test), "behaviour-scores")
    hit = scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    return Retrained(PipelineModel([vec, scaler, model]), labeller, outliers, vocabulary, texts["_level"], texts["service_name"], scored,
                     BinaryClassificationEvaluator().evaluate(scored), {"behaviour": hit, "severity": right["_level"], "service": right["service_name"]})


class TrainedModels:
    def __init__(self, classifiers, outliers, baseline, markov, injection):
        self.classifiers, self.outliers = classifiers, outliers
        self.baseline, self.markov, self.injection = baseline, markov, injection


def train_all(logs: DataFrame, seed: int = 42, n_trees: int = 100) -> tuple[TrainedModels, DataFrame]:
    """Splits, trains the three model families and returns them with the test rows. Fewer than
    100 rows are an error."""
    if logs.limit(MIN_TRAINING_ROWS).count() < MIN_TRAINING_ROWS:
        raise ValueError(f"at least {MIN_TRAINING_ROWS} rows are needed")
    train, test = (materialize(part, "split") for part in split(logs, 0.8, "severity", seed))
    classifiers = classify.train_classifiers(train)
    outliers = forest.forest_fit(anomaly.frequency_features(train), anomaly.FOREST_COLUMNS,
                                 n_trees=n_trees, seed=seed)
    secure = contains_any(F.lower("body_raw"), fixed.SECURITY_WORDS)
    markov = threats.markov_fit(train.filter(~secure), train.filter(secure))
    sets = threats.threat_training_sets(train)
    baseline = threats.bruteforce_fit(sets["auth"])
    injection = threats.injection_fit(sets["malicious"], sets["benign"])
    return TrainedModels(classifiers, outliers, baseline, markov, injection), test


def analyze(logs: DataFrame, models: TrainedModels) -> DataFrame:
    """One row per log row: anomaly, classification and threat columns. The three parts are written
    as tables before they are joined, so each is planned and restarted on its own."""
    odd = forest.detect_anomalies(logs, anomaly.frequency_features(logs), models.outliers).select(
        "id", "is_anomaly", "anomaly_score", "anomaly_type")
    kinds = classify.classify(logs, models.classifiers).select("id", "category", "domain", "severity_label", "confidence")
    harm = threats.detect_threats(logs, models.baseline, models.markov, *models.injection).select(
        "id", "is_threat", "threat_score", "threat_type", "threat_level")
    odd, kinds, harm = (materialize(part, "analysis") for part in (odd, kinds, harm))
    return odd.join(kinds, "id").join(harm, "id")


def analysis_summary(analyzed: DataFrame) -> DataFrame:
    return analyzed.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_anomaly").alias("anomalies"),
                        F.count_if("is_threat").alias("threats"), F.count_distinct("category").alias("categories"))


def training_source(df: DataFrame, message: str = "message", source: str = "source") -> DataFrame:
    """Adds domain (by source name) and severity (by message words) to training rows."""
    from logloom.functions.labels import infer_domain_from_service, infer_severity
    return df.withColumn("domain", infer_domain_from_service(F.col(source))).withColumn("severity", infer_severity(F.col(message)))


