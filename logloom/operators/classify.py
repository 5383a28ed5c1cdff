"""Log classification: TF-IDF, naive Bayes, linear SVM, combined labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.labels import category_from_severity, infer_domain_from_text, keyword_labels
from logloom.functions.text import extract_entities
from logloom.operators.svm import svm_fit, svm_score
from logloom.operators.tfidf import class_sums, numbered, tfidf_fit, tfidf_transform, tfidf_vectors  # noqa: F401
from logloom.session import discard, materialize

#: Classes whose scores are summed together.
CLASS_BLOCK = 200
#: Added to the weight of every term of a class.
ALPHA = 1.0


def nb_fit(vectors: DataFrame, vocabulary: DataFrame | int, label: str, column: str = "_x") -> tuple[DataFrame, DataFrame]:
    """(classes, terms) of rows with a vector column of tfidf_vectors over a vocabulary (or its size). classes: label, log_prior, log_default (a term never
    seen in the class). terms: label, term (its place in the sorted vocabulary), gain over log_default. At most classes x
    max_features rows."""
    pairs = vectors.select(F.col(label).alias("label"), F.explode(F.arrays_zip(f"{column}.terms", f"{column}.values")).alias("_p"))
    sums = pairs.filter("label IS NOT NULL").groupBy("label", F.col("_p.terms").alias("term")).agg(F.sum("_p.values").alias("_s"))
    if isinstance(vocabulary, int):
        size = vectors.sparkSession.range(1).select(F.lit(vocabulary).cast("long").alias("_v"), F.lit(1).alias("_k"))
    else:
        size = vocabulary.agg(F.count(F.lit(1)).alias("_v")).withColumn("_k", F.lit(1))
    counts = vectors.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_all")).withColumn("_k", F.lit(1))
    mass = sums.groupBy("label").agg(F.sum("_s").alias("_t"))
    classes = (counts.join(mass, "label", "left").withColumn("_k", F.lit(1)).join(whole, "_k").join(size, "_k")
               .select("label", F.log(F.col("_n") / F.col("_all")).alias("log_prior"),
                       F.log(ALPHA / (F.coalesce("_t", F.lit(0.0)) + ALPHA * F.col("_v"))).alias("log_default")))
    return classes, sums.select("label", "term", F.log((F.col("_s") + ALPHA) / ALPHA).alias("gain"))


def nb_score(vectors: DataFrame, model: tuple[DataFrame, DataFrame], width: int, column: str = "_x") -> DataFrame:
    """Adds label, confidence, probabilities. The gains of CLASS_BLOCK classes at a time (at most MAX_FEATURES x
    CLASS_BLOCK numbers) are shared; a row is scored where it lies."""
    classes, terms = model
    spec = sorted(classes.collect(), key=lambda r: (r.label is None, r.label))  # one row per class
    blocks = []
    for start in range(0, len(spec), CLASS_BLOCK):
        block = spec[start:start + CLASS_BLOCK]
        place = {r.label: i for i, r in enumerate(block)}
        weights = np.repeat([[r.log_default for r in block]], width, axis=0)
        for r in terms.filter(F.col("label").isin([x for x in place if x is not None])).collect():
            weights[r.term, place[r.label]] += r.gain
        blocks.append(class_sums(column, weights))
    if not spec:
        return vectors.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("label", "string"), ("confidence", "double"), ("probabilities", "map<string,double>"))])
    named = F.array(*[F.struct(F.lit(r.log_prior).alias("p"), F.lit(r.label).alias("label")) for r in spec])
    scored = vectors.withColumn("_s", F.concat(*blocks)).withColumn("_s", F.zip_with(
        "_s", named, lambda s, c: F.struct((s + c["p"]).alias("s"), c["label"].alias("label"))))
    scored = scored.withColumn("_top", F.array_max(F.transform("_s", lambda e: e["s"])))
    scored = scored.withColumn("_z", F.aggregate("_s", F.lit(0.0), lambda a, e: a + F.exp(e["s"] - F.col("_top"))))
    probs = F.map_from_entries(F.transform("_s", lambda e: F.struct(
        e["label"].alias("key"), (F.exp(e["s"] - F.col("_top")) / F.col("_z")).alias("value"))))
    best = F.element_at(F.filter("_s", lambda e: e["s"] == F.col("_top")), 1)["label"]
    return scored.select(*vectors.columns, best.alias("label"), (1 / F.col("_z")).alias("confidence"), probs.alias("probabilities"))


# --- whole rows -------------------------------------------------------------------------
class LogModels:
    """Vocabulary, naive Bayes models for category and domain, SVM for severity."""

    def __init__(self, vocabulary, category, domain, severity):
        self.vocabulary, self.category, self.domain, self.severity = vocabulary, category, domain, severity


def train_classifiers(logs: DataFrame, key: str = "id", text: str = "body_raw", source: str = "service_name") -> LogModels:
    """Fits on keyword labels (category, domain, severity)."""
    labelled = logs.select(key, text, keyword_labels(F.col(text), F.col(source)).alias("k")).select(
        key, text, "k.category", "k.domain", F.col("k.severity").alias("level"))
    labelled = materialize(labelled, "labelled")
    vocabulary = materialize(tfidf_fit(labelled, key, text), "vocabulary")
    vectors = materialize(tfidf_vectors(labelled, text, *numbered(vocabulary)), "weights")
    category, domain = (tuple(materialize(part, "nb-model") for part in nb_fit(vectors, vocabulary, name)) for name in ("category", "domain"))
    if labelled.filter("level IS NULL").isEmpty():  # then the vocabulary is that of the SVM
        severity = svm_fit(vectors, key, text, "level", vocabulary=vocabulary)
    else:
        severity = svm_fit(labelled, key, text, "level")
    discard(vectors)
    return LogModels(vocabulary, category, domain, severity)


def classify(logs: DataFrame, models: LogModels, key: str = "id", text: str = "body_raw") -> DataFrame:
    """key, category, domain, severity_label, confidence (mean of three), probabilities, entities. Every row is scored
    where it lies; nothing is shuffled."""
    terms, idf = numbered(models.vocabulary)
    rows = tfidf_vectors(logs.select(key, text), text, terms, idf)
    rows = nb_score(rows, models.category, len(terms)).withColumnsRenamed({"label": "category", "confidence": "_c1", "probabilities": "_p"})
    rows = nb_score(rows, models.domain, len(terms)).withColumnsRenamed({"label": "domain", "confidence": "_c2"}).drop("probabilities")
    shared = "_x" if models.severity.vocabulary is models.vocabulary else None
    rows = svm_score(rows, models.severity, text, shared).withColumnsRenamed({"label": "severity_label", "confidence": "_c3"})
    return rows.select(key, "category", "domain", "severity_label", ((F.col("_c1") + F.col("_c2") + F.col("_c3")) / 3).alias("confidence"),
                       F.col("_p").alias("probabilities"), extract_entities(F.col(text)).alias("entities"))


def classify_from_severity(df: DataFrame, severity: str, confidence: str, message: str) -> DataFrame:
    """Category from a predicted severity name, domain by words, mean confidence (domain 0.6)."""
    c = F.col(confidence)
    return (df.withColumn("category", category_from_severity(F.col(severity), F.col(message)))
            .withColumn("domain", infer_domain_from_text(F.col(message)))
            .withColumn("mean_confidence", (c + 0.6 + c) / 3))


def heuristic_classify(logs: DataFrame, message: str = "body_raw", source: str = "service_name") -> DataFrame:
    """Keyword labels with 0.6 confidence, and entities."""
    k: Column = keyword_labels(F.col(message), F.col(source))
    return (logs.withColumn("_k", k).withColumn("category", F.col("_k.category")).withColumn("domain", F.col("_k.domain"))
            .withColumn("severity_label", F.col("_k.severity")).withColumn("confidence", F.lit(0.6))
            .withColumn("entities", extract_entities(F.col(message))).drop("_k"))
