"""Regressions: whole answers and bounded tasks of single operators."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F


from logloom.operators import classify, tfidf, threats, training, vectors
from logloom.plans import catalog


def test_top_templates_returns_all_templates(spark, tmp_path):
    """More than 1,000 templates match; the SQL has no limit."""
    rows = [(i, dt.datetime(2024, 1, 10), 2 * i + 1, "purchase", 1.0, "{}") for i in range(1100)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet")
    out = catalog.queries()["top_templates"](spark, str(tmp_path))
    assert out.count() == 1100 and out.agg(F.sum("count")).first()[0] == 1100


def test_vector_topk_reads_the_vectors_once(spark):
    """Many small query parts neither search the source of the vectors again nor change the answer, ties included."""
    seen = spark.sparkContext.accumulator(0)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 6)]) for i in range(3000)]
    v = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(3)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    asked = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows[:50]) if any(r[1])], "query_id long, vector array<double>")
    out = vectors.vector_topk(v.mapInPandas(count, v.schema), asked, 5, broadcast_limit=4).collect()
    assert seen.value == 3000
    m = np.array([r[1] for r in rows])
    norms = np.linalg.norm(m, axis=1)
    unit = m / np.where(norms == 0, 1, norms)[:, None]
    for q in asked.collect():
        sims = unit @ unit[q.query_id]
        want = np.sort(sims)[::-1][:5]
        got = sorted((r for r in out if r.query_id == q.query_id), key=lambda r: r["rank"])
        assert np.allclose([r.score for r in got], want) and np.allclose([sims[r.vec_id] for r in got], want)
        assert len({r.vec_id for r in got}) == 5


def test_weights_and_scores_never_group_rows_by_document(spark):
    """Memory of a task: terms are counted, scaled and scored inside the row, so no shuffle or aggregate is keyed by document."""
    docs = spark.createDataFrame([(i, f"disk {'full full' if i % 2 else 'fine'} node{i % 3}", "ab"[i % 2]) for i in range(40)] + [(40, None, "a"), (41, "", "b")],
                                 "id long, m string, y string")
    vocabulary = classify.tfidf_fit(docs, "id", "m")
    terms, idf = classify.numbered(vocabulary)
    weights = classify.tfidf_transform(docs, "id", "m", vocabulary)
    rows = classify.tfidf_vectors(docs, "m", terms, idf)
    scored = classify.nb_score(rows, classify.nb_fit(rows, vocabulary, "y"), len(terms))
    for out in (weights, scored):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "hashpartitioning" not in plan
    assert all(abs(r[0] - 1) < 1e-12 for r in weights.groupBy("id").agg(F.sum(F.col("weight") ** 2)).select("sum(power(weight, 2))").collect())
    got = scored.collect()
    assert len(got) == 42 and all(r.label == r.y for r in got if r.m) and all(abs(sum(r.probabilities.values()) - 1) < 1e-12 for r in got)


def test_needed_literal_is_in_every_match_and_rules_stay_equal(spark):
    want = {r"'\s*or\s+['\d]": "or", r"ab?c\d{2}de": "de", r"colou?r": "colo", r"x(?:y|z)+long": "long", r"a|b": "", r"\x41b": "",
            r"[]a]xyz": "xyz", r"\$\{jndi:": "${jndi:", r"https?://": "http", r".*": "", r"%\w+;": "%", r"ab{0,2}": "a", "É": ""}
    assert {p: threats.needed_literal(p) for p in want} == want
    texts = ["' OR 1", "; drop table", "<ScRiPt>x", "../etc/passwd", "${JNDI:ldap://x}", "a:1:{", "\r\n", "plain", "", None, "x=rO0AB", "Kelvin wget x", "db.a.find ("]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, m string")
    for strict in (False, True):
        target, flag = (F.lower("m"), "") if strict else (F.col("m"), "(?i)")
        plain = F.array(*[F.array_compact(F.array(*[F.when(target.rlike(flag + p), F.lit(p)) for p in ps])) for ps in threats.INJECTION_RULES.values()])
        found = rows.select(threats.matched_rules(F.col("m"), strict=strict).alias("a"), plain.alias("b")).collect()
        assert [r.a for r in found] == [r.b for r in found] and any(any(r.a) for r in found)


def test_text_curve_equals_separate_fits_and_reads_the_texts_twice(spark, monkeypatch):
    """The texts are tokenised once for all vocabularies and once for the counts, whatever the number of fractions."""
    rng = np.random.default_rng(4)
    words = ["disk", "full", "fine", "node", "ready", "late", "queue", "panic"]
    rows = [(i, None if i == 7 else " ".join(rng.choice(words[i % 3:], 5)), "ab"[i % 2] if rng.random() < 0.8 else "b") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, m string, y string")
    fractions = (0.2, 0.5, 1.0)

    def fit_score(train, test):
        v = classify.tfidf_fit(train, "doc_id", "m")
        terms, idf = classify.numbered(v)
        model = classify.nb_fit(classify.tfidf_vectors(train, "m", terms, idf), v, "y")
        return classify.nb_score(classify.tfidf_vectors(test, "m", terms, idf), model, len(terms)).agg(
            F.avg((F.col("label") == F.col("y")).cast("double"))).first()[0]

    want = training.learning_curve(docs, fit_score, fractions, id_col="doc_id")
    reads, plain = [], tfidf.log_tokens
    monkeypatch.setattr(tfidf, "log_tokens", lambda *a: reads.append(1) or plain(*a))
    got = training.text_curve(docs, "m", "y", fractions, id_col="doc_id")
    assert [f for f, _ in got] == list(fractions) and got == want
    assert len(reads) == 3  # vocabularies of the train rows, counts of the train rows, counts of the test rows


def test_tuning_makes_the_features_once(spark):
    """The fits of the cross-validation read stored features: no text is tokenised again, however many folds and settings."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    rows = [(i, f"{'disk full' if i % 2 else 'all fine'} node{i % 5}", str(i % 2)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, m string, y string")
    one = docs.select(read.asNondeterministic()("m").alias("m"), "y")
    found = training.tune(one, "m", "y", alphas=(0.1, 1.0), cs=(1.0,), folds=3, strength_folds=2, max_iter=5)
    assert {k: len(v["scores"]) for k, v in found.items()} == {"naive_bayes": 2, "logistic": 1} and min(found["naive_bayes"]["scores"]) == 1.0
    assert seen.value <= 5 * 80  # vocabulary, weights, class names, features; not once per fold
