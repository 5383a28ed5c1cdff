"""The SVM by mini-batches against single steps in NumPy, and its updates."""

import numpy as np
import pytest

from logloom.operators import svm

WORDS = {"high": ["disk", "full", "error", "broken", "panic"], "low": ["fine", "ok", "done", "ready", "idle"], "mid": ["slow", "retry", "wait", "late", "queue"]}


def made(n, seed):
    rng = np.random.default_rng(seed)
    kinds = rng.choice(list(WORDS), n)
    return [(i, " ".join(rng.choice(WORDS[k] if rng.random() < 0.9 else WORDS["low"], 4)), str(k)) for i, k in enumerate(kinds)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, m string, y string")


def single_steps(x, signs, weights, bias, rate, strength, passes):
    """One row and one class at a time."""
    for c in range(signs.shape[1]):
        w, b = weights[:, c].copy(), bias[c]
        for _ in range(passes):
            for row, y in zip(x, signs[:, c]):
                active = y * (row @ w + b) < 1
                w = w - rate * strength * w + (rate * y * row if active else 0)
                b += rate * y if active else 0
        weights[:, c], bias[c] = w, b
    return weights, bias


def dense(spark, model, rows):
    """Rows, signs, weights and bias of the model's space, rows in the order of its tasks."""
    numbered, terms = svm._numbered(model.vocabulary)
    from pyspark.sql import functions as F
    got = svm.feature_rows(frame(spark, rows), "id", "m", "y", numbered).orderBy(F.xxhash64("id"), "id").collect()
    x = np.zeros((len(got), len(terms)))
    for i, r in enumerate(got):
        x[i, r["terms"]] = r["values"]
    signs = np.array([[1.0 if r["label"] == c else -1.0 for c in model.labels] for r in got])
    place, w, b = {t: i for i, t in enumerate(terms)}, np.zeros((len(terms), len(model.labels))), np.zeros(len(model.labels))
    for r in model.weights.collect():
        if r["term"] is None:
            b[model.labels.index(r["label"])] = r["weight"]
        else:
            w[place[r["term"]], model.labels.index(r["label"])] = r["weight"]
    return x, signs, w, b


@pytest.mark.parametrize("batch, limit", [(1, 1e-12), (64, 0.02)])
def test_steps_equal_single_steps(batch, limit):
    rng = np.random.default_rng(batch)
    x = np.where(rng.random((300, 12)) < 0.3, rng.random((300, 12)), 0)
    signs = np.where(rng.random((300, 3)) < 0.4, 1.0, -1.0)
    rows, terms = np.nonzero(x)
    starts = np.searchsorted(rows, np.arange(301))
    w, b = rng.random((12, 3)), rng.random(3)
    want = single_steps(x, signs, w.copy(), b.copy(), 0.001, 0.01, 20)
    svm.steps(w, b, starts, terms, x[rows, terms], signs, 0.001, 0.01, 20, batch)
    assert np.abs(w - want[0]).max() < limit and np.abs(b - want[1]).max() < limit


def test_fit_equals_single_steps_of_one_task(spark):
    rows = made(200, 1)
    model = svm.svm_fit(frame(spark, rows), "id", "m", "y", passes=30, merges=3)
    x, signs, w, b = dense(spark, model, rows)
    want = single_steps(x, signs, np.zeros_like(w), np.zeros_like(b), svm.LEARNING_RATE, svm.REGULARISATION, 30)
    assert np.abs(w - want[0]).max() < 0.01 and np.abs(b - want[1]).max() < 0.01


def test_two_updates_equal_one_pass_over_both(spark):
    model = svm.svm_fit(frame(spark, made(150, 2)), "id", "m", "y", passes=40, merges=1)
    new = made(400, 3)
    halves = [[r for r in new if (r[0] % 2 == 0) == even] for even in (True, False)]
    twice = svm.svm_update(svm.svm_update(model, frame(spark, halves[0]), "id", "m", "y"), frame(spark, halves[1]), "id", "m", "y")
    once = svm.svm_update(model, frame(spark, new), "id", "m", "y")
    (x, signs, _, _), (_, _, w0, b0) = dense(spark, model, new), dense(spark, model, new)
    want = single_steps(x, signs, w0, b0, svm.LEARNING_RATE, svm.REGULARISATION, 1)
    for found in (once, twice):
        _, _, w, b = dense(spark, found, new)
        assert np.abs(w - want[0]).max() < 0.02 and np.abs(b - want[1]).max() < 0.02


def test_update_moves_from_the_stored_weights_and_keeps_the_classes(spark, tmp_path):
    model = svm.svm_fit(frame(spark, made(100, 4)), "id", "m", "y", passes=50)
    model.save(str(tmp_path))
    again = svm.Svm.load(spark, str(tmp_path))
    assert again.labels == model.labels == ["high", "low", "mid"]
    new = frame(spark, [(1, "disk broken", "high"), (2, "strange thing", "other"), (3, None, "low"), (4, "disk", None)])
    moved = svm.svm_update(again, new, "id", "m", "y")
    assert moved.labels == model.labels
    before, after = (dict(((r["label"], r["term"]), r["weight"]) for r in m.weights.collect()) for m in (model, moved))
    assert before != after and max(abs(after.get(k, 0) - v) for k, v in before.items()) < 0.01


def test_tasks_are_averaged_and_tell_the_classes_apart(spark, monkeypatch):
    monkeypatch.setattr(svm, "ROWS_PER_TASK", 60)
    rows = made(400, 5)
    model = svm.svm_fit(frame(spark, rows), "id", "m", "y", passes=400)
    truth = {i: k for i, _, k in rows}
    got = svm.svm_predict(frame(spark, rows), model, "id", "m").collect()
    assert len(got) == 400 and sum(r["label"] == truth[r["id"]] for r in got) > 0.85 * 400
    assert all(0.5 <= r["confidence"] < 1 for r in got)


def test_prediction_of_rows_without_known_terms(spark):
    model = svm.svm_fit(frame(spark, made(60, 6)), "id", "m", "y", passes=5)
    got = svm.svm_predict(frame(spark, [(1, None, None), (2, "", None), (3, "unheard of", None)]), model, "id", "m").collect()
    assert len({(r["label"], r["confidence"]) for r in got}) == 1 and len(got) == 3
    none = frame(spark, [])
    assert svm.svm_predict(none, model, "id", "m").collect() == []
    assert svm.svm_update(model, none, "id", "m", "y").weights.count() >= 3


def test_terms_of_a_template_are_one_column_and_equal_rows_one_row():
    """Words that always stand together move together; steps and weights stay those of the single terms, from any start."""
    rng = np.random.default_rng(9)
    x = np.zeros((200, 9))
    kind = rng.integers(0, 3, 200)
    x[kind == 0, :3] = [0.2, 0.4, 0.6]
    x[kind == 1, 3:6] = np.array([0.5, 0.1, 0.3]) * rng.choice([1.0, 2.0], (np.sum(kind == 1), 1))
    x[kind == 2, 6:8] = rng.random((np.sum(kind == 2), 2))
    signs = np.where(rng.random((200, 2)) < 0.5, 1.0, -1.0)
    rows, terms = np.nonzero(x)
    starts = np.searchsorted(rows, np.arange(201))
    _, columns, _, of, column, share = svm._together(starts, terms, x[rows, terms])
    assert len(of) == 8 and column.max() == 3 and len(columns) < len(terms)
    assert np.allclose(np.bincount(column, share**2), 1)
    used, block, _, times = svm._dense(np.array([0, 2, 0, 2]), np.array([1.0, 2.0, 1.0, 2.0]), np.array([0, 0, 1, 1]), np.ones((3, 1)))
    assert used.tolist() == [0, 2] and block.tolist() == [[1, 2], [0, 0]] and times.tolist() == [2, 1]
    w, b = rng.random((9, 2)), rng.random(2)
    want = single_steps(x, signs, w.copy(), b.copy(), 0.001, 0.01, 30)
    svm.steps(w, b, starts, terms, x[rows, terms], signs, 0.001, 0.01, 30, 1)
    assert np.abs(w - want[0]).max() < 1e-12 and np.abs(b - want[1]).max() < 1e-12


def test_sets_side_by_side_step_as_alone(monkeypatch):
    """Sets of other sizes, one without rows that hold a term, in one part and in several."""
    rng = np.random.default_rng(7)

    def sets():
        out = []
        for n in (150, 1, 201, 64, 90):
            sizes = rng.integers(0, 6, n) if n != 90 else np.zeros(n, int)
            terms = [np.sort(rng.choice(30, k, replace=False)) for k in sizes]
            signs = np.where(rng.integers(0, 3, n)[:, None] == np.arange(3)[None, :], 1.0, -1.0)
            out.append((rng.normal(size=(30, 3)), rng.normal(size=3), np.concatenate([[0], np.cumsum(sizes)]),
                        np.concatenate([*terms, []]).astype(np.int64), rng.random(sizes.sum()) + 0.1, signs))
        return out

    for cells in (svm.KEPT_CELLS, 4_000):
        monkeypatch.setattr(svm, "KEPT_CELLS", cells)
        rows = sets()
        alone = [(w.copy(), b.copy(), *rest) for w, b, *rest in rows]
        for w, b, *rest in alone:
            svm.steps(w, b, *rest, 0.001, 0.01, 40)
        svm.steps_of_all(rows, 0.001, 0.01, 40)
        for (w, b, *_), (x, c, *_) in zip(rows, alone):
            assert np.abs(w - x).max() < 1e-9 and np.abs(b - c).max() < 1e-9


def test_fit_is_the_same_side_by_side(spark, monkeypatch):
    rows = frame(spark, made(400, 8))
    monkeypatch.setattr(svm, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(svm, "SIDE_BY_SIDE", 1)
    key = lambda m: sorted((r["label"], r["term"] or "", r["weight"]) for r in m.weights.collect())
    alone = key(svm.svm_fit(rows, "id", "m", "y", passes=20, merges=2))
    monkeypatch.setattr(svm, "SIDE_BY_SIDE", 4)
    monkeypatch.setattr(svm, "LEAST_CALLS", 2)
    together = key(svm.svm_fit(rows, "id", "m", "y", passes=20, merges=2))
    assert [x[:2] for x in alone] == [x[:2] for x in together]
    assert max(abs(x[2] - y[2]) for x, y in zip(alone, together)) < 1e-9


def test_classifiers_share_vocabulary_and_vectors(spark, monkeypatch):
    """The severity model is that of a fit of its own, and the texts are not read for it again."""
    from pyspark.sql import functions as F

    from logloom.operators import classify
    logs = spark.createDataFrame([(i, f"{w} in unit u{i % 7} code {i % 5}", "app") for i, w in enumerate(["error", "login ok", "warning low disk", "fatal crash"] * 15)],
                                 "id long, body_raw string, service_name string")
    fits, fit = [], classify.svm_fit
    monkeypatch.setattr(classify, "svm_fit", lambda *a, **k: fits.append(k) or fit(*a, **{**k, "passes": 30}))
    models = classify.train_classifiers(logs)
    assert fits[0]["vocabulary"] is models.vocabulary is models.severity.vocabulary
    levels = logs.select("id", "body_raw", classify.keyword_labels(F.col("body_raw"), F.col("service_name"))["severity"].alias("level"))
    own = fit(levels, "id", "body_raw", "level", passes=30)
    key = lambda m: sorted((r["label"], r["term"] or "", round(r["weight"], 9)) for r in m.weights.collect())
    assert key(own) == key(models.severity)
    got = {r["id"]: (r["severity_label"], r["category"]) for r in classify.classify(logs, models).collect()}
    models.severity = own
    assert got == {r["id"]: (r["severity_label"], r["category"]) for r in classify.classify(logs, models).collect()}
