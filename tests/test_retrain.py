"""The whole retraining job: both isolation forests, the text classifiers and the detector."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom import fixed
from logloom.operators import forest, tfidf, training

SCHEMA = "id long, body_raw string, severity int, service_name string, template_hash long"


def made(n, seed=3):
    rng = random.Random(seed)
    kinds = [("GET /item/{0} 200 user session", 2, "nginx"), ("order {0} completed for user u{0}", 2, "app"), ("disk check took {0} ms", 1, "kernel"),
             ("error connection refused by 10.0.0.{0}", 4, "mysql"), ("login failed: invalid password for u{0} ../etc/passwd", 4, "sshd")]
    rows = []
    for i in range(n):
        k = rng.choice([0, 0, 1, 1, 2, 2, 3, 4])
        text, level, service = kinds[k]
        rows.append((i, text.format(rng.randrange(30)), level if rng.random() < 0.9 else 3, service if rng.random() < 0.9 else "app", k))
    return [*rows, (n, None, None, None, None), (n + 1, "", 5, "app", 9)]


def term_weights(texts):
    """Weights of the words as the text vectoriser of the retraining script makes them."""
    found = []
    for t in texts:
        w = [x for x in re.findall(r"\b\w\w+\b", t.lower()) if x not in fixed.ENGLISH_STOP_WORDS]
        found.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    n, df, times = len(texts), Counter(x for c in found for x in c), sum(found, Counter())
    kept = sorted((x for x in df if 5 <= df[x] <= 0.95 * n), key=lambda x: (-times[x], x))[:5000]
    idf = {x: math.log((1 + n) / (1 + df[x])) + 1 for x in kept}
    out = []
    for c in found:
        v = {x: c[x] * idf[x] for x in c if x in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({x: y / norm for x, y in v.items()})
    return out, len(kept)


def bayes(train, test, width):
    """The label of each test row, by multinomial naive Bayes with a smoothing of 1."""
    sums, sizes = defaultdict(Counter), Counter(y for _, y in train)
    for v, y in train:
        sums[y].update(v)
    base = {y: sum(sums[y].values()) + width for y in sizes}
    score = lambda v, y: math.log(sizes[y] / len(train)) + sum(w * math.log((sums[y][x] + 1) / base[y]) for x, w in v.items())
    return [max(sorted(sizes), key=lambda y: score(v, y)) for v in test]


def test_retraining_does_every_step(spark):
    rows = made(600)
    logs = spark.createDataFrame(rows, SCHEMA)
    found = training.train_behavioural(logs, trees=30, classifier_trees=5, outlier_trees=10)
    whole = [(i, m or "", str(1 if s is None else s), n or "unknown") for i, m, s, n, _ in rows]
    weights, width = term_weights([r[1] for r in whole])
    assert found.vocabulary.count() == width
    train, test = training.split(logs, 0.8, None, 42)
    for name, place in (("severity", 2), ("service", 3)):
        ids = [r["id"] for r in test.select("id").collect()]
        learnt = [(weights[r["id"]], whole[r["id"]][place]) for r in train.select("id").collect()]
        said = bayes(learnt, [weights[i] for i in ids], width)
        assert found.accuracy[name] == pytest.approx(np.mean([a == whole[i][place] for a, i in zip(said, ids)]), abs=1e-9)
    assert found.scored.filter("label = prediction").count() / found.scored.count() == pytest.approx(found.accuracy["behaviour"])
    assert found.outliers.nodes["tree"].nunique() == 10 and found.labeller.nodes["tree"].nunique() == 30
    assert len(found.detector.stages) == 3


def test_standard_forest_splits_on_columns_that_vary(spark):
    rng = random.Random(1)
    rows = [(i, rng.random(), *[0.0] * 9) for i in range(2000)] + [(2000, 9.0, *[0.0] * 9)]
    df = spark.createDataFrame(rows, "id long, a double, " + ", ".join(f"z{i} double" for i in range(9)))
    columns = df.columns[1:]
    model = forest.forest_grow(df, columns, n_trees=30, standard=True)
    roots = model.nodes[model.nodes["node"] == 0]
    assert (roots["feature"] == 0).all() and model.nodes["depth"].max() == 8
    assert forest.forest_score(df, model).orderBy(F.col("anomaly_score").desc()).first()["id"] == 2000


def test_standard_forest_threshold_is_the_exact_quantile(spark):
    df = spark.createDataFrame([(i, float((i * 37) % 1009) ** 2) for i in range(1009)], "id long, a double")
    model, scored = forest.forest_fit_score(df, ["a"], n_trees=20, contamination=0.1, standard=True)
    scores = [r["anomaly_score"] for r in scored.collect()]
    assert model.threshold == pytest.approx(np.quantile(scores, 0.9), abs=1e-12)


def test_terms_of_many_documents_and_stop_words_are_left_out(spark):
    docs = spark.createDataFrame([(f"common word{i % 4} the x{'yz'[i % 2]}",) for i in range(40)] + [("rare thing",)], "t string")
    assert {r["term"] for r in tfidf.content_fit(docs, "t").collect()} == {
        *[f"word{i}" for i in range(4)], *[f"common word{i}" for i in range(4)], "xy", "xz", "word0 xy", "word1 xz", "word2 xy", "word3 xz"}
