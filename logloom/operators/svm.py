"""Linear one-vs-rest SVM by stochastic gradient descent, with updates from new rows only.

A model is a table of weights. A pass starts from that table: tasks of bounded size step through their rows
in mini-batches, all classes at once, and their weights are averaged by row counts into the next table. Where there are many parts,
a task steps several of them in the same array operations.
An update is one pass over the new rows; the rows seen before are not read again."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.tfidf import class_sums, numbered, tfidf_fit, tfidf_vectors
from logloom.session import materialize

LEARNING_RATE, REGULARISATION, PASSES = 0.001, 0.01, 1000
#: Rows that one task steps through; more rows are dealt to more tasks, whose weights are averaged. An update is
#: one pass, so a task can take more of them.
ROWS_PER_TASK, ROWS_PER_UPDATE = 20_000, 200_000
#: Numbers of batches that stay unpacked from pass to pass.
KEPT_CELLS = 1 << 24
#: Rows that step together from the same weights. Their order inside a batch does not matter, and the weights
#: differ from those of single steps by less than (LEARNING_RATE * BATCH) ** 2 a batch.
BATCH = 64
#: Parts of the rows that a task steps side by side at most, and the calls that are there before it takes more than one.
SIDE_BY_SIDE, LEAST_CALLS = 8, 32
#: How often the weights of the tasks are averaged during a fit.
MERGES = 10


@dataclass
class Svm:
    """vocabulary: term, df, idf. weights: label, term, weight; the bias is the row whose term is null."""

    vocabulary: DataFrame
    weights: DataFrame
    labels: list[str]
    learning_rate: float = LEARNING_RATE
    regularisation: float = REGULARISATION

    def save(self, path: str) -> None:
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")

    @staticmethod
    def load(spark: SparkSession, path: str, learning_rate: float = LEARNING_RATE, regularisation: float = REGULARISATION) -> Svm:
        weights = spark.read.parquet(f"{path}/weights")
        return Svm(spark.read.parquet(f"{path}/vocabulary"), weights, labels_of(weights), learning_rate, regularisation)


def labels_of(weights: DataFrame) -> list[str]:
    """Every class has a bias row."""
    return sorted(r["label"] for r in weights.filter("term IS NULL").select("label").distinct().collect())


def feature_rows(docs: DataFrame, key: str, text: str, label: str, vocabulary: DataFrame) -> DataFrame:
    """key, label, terms (position in the sorted vocabulary), values of every document; none for no known term."""
    rows = tfidf_vectors(docs.select(key, F.col(label).cast("string").alias("label"), F.col(text).alias("_text")), "_text", *numbered(vocabulary))
    return rows.select(key, "label", F.col("_x.terms").alias("terms"), F.col("_x.values").alias("values"))


def _numbered(vocabulary: DataFrame) -> tuple[DataFrame, list[str]]:
    """The vocabulary with the place of each term. It has at most MAX_FEATURES rows."""
    terms = sorted(r["term"] for r in vocabulary.select("term").collect())
    places = vocabulary.sparkSession.createDataFrame(list(zip(terms, range(len(terms)))), "term string, number int")
    return vocabulary.join(F.broadcast(places), "term"), terms


def _dense(terms: np.ndarray, values: np.ndarray, rows: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of a batch, its different rows over those terms with their signs, and how often each row stands in it."""
    used, column = np.unique(terms, return_inverse=True)
    block = np.zeros((len(signs), len(used)))
    block[rows, column] = values
    where: dict[bytes, int] = {}
    same = [where.setdefault(x.tobytes() + y.tobytes(), i) for i, (x, y) in enumerate(zip(block, signs))]
    first, times = np.unique(same, return_counts=True)
    return used, block[first], signs[first], times


def _together(starts: np.ndarray, terms: np.ndarray, values: np.ndarray):
    """Terms that stand in the same rows in one proportion, as the words of a log template do, are turned into one column
    of the same length. Returns starts, columns and values of the rows over the columns, the terms that occur, the
    column of each and its share of it: weight of a term = share * weight of the column, as far as rows move it."""
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((rows, terms))
    order = order[values[order] != 0]
    rows, terms, values = rows[order], terms[order], values[order]
    lows = np.flatnonzero(np.diff(terms, prepend=-1))
    highs = np.append(lows[1:], len(terms))
    ratio = values / np.repeat(values[lows], highs - lows)
    rounded, where, leads = np.round(ratio, 13), {}, []
    column = np.empty(len(lows), np.int64)
    for k, (low, high) in enumerate(zip(lows, highs)):
        column[k] = where.setdefault(rows[low:high].tobytes() + rounded[low:high].tobytes(), len(leads))
        if column[k] == len(leads):
            leads.append(k)
    length = np.sqrt(np.bincount(column, values[lows] ** 2))
    stays = np.isin(np.repeat(np.arange(len(lows)), highs - lows), leads)
    rows, at = rows[stays], np.repeat(column, highs - lows)[stays]
    back = np.argsort(rows, kind="stable")
    return (np.searchsorted(rows[back], np.arange(len(starts))), at[back], (ratio[stays] * length[at])[back],
            terms[lows], column, values[lows] / length[column])


def steps(weights: np.ndarray, bias: np.ndarray, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, signs: np.ndarray,
          rate: float, strength: float, passes: int, batch: int = BATCH) -> None:
    """`passes` over rows given as one flat list of terms and values (row i: starts[i] to starts[i + 1]) changes
    weights (terms x classes) and bias in place. A row whose margin is below 1 pulls the weights to its side; every
    row shrinks them. Shrinking is kept as one factor, so a batch touches only its own columns. Equal rows of a batch
    step from the same weights, so they are looked at once and pull as often as they stand there."""
    steps_of_all([(weights, bias, starts, terms, values, signs)], rate, strength, passes, batch)


def steps_of_all(sets: list[tuple], rate: float, strength: float, passes: int, batch: int = BATCH) -> None:
    """`steps` of several sets of rows, each from its own weights and bias in place: their batches of one number are
    stepped in the same array operations, filled up with columns and rows of zeros. Sets that together have more than
    KEPT_CELLS numbers go in parts."""
    parts, of_one = [[]], []
    for each in sets:
        starts, columns, values, of, column, share = _together(*each[2:5])
        signs, width = each[5], int(column.max(initial=-1)) + 1
        rows = np.repeat(np.arange(len(signs)), np.diff(starts))
        place = {"starts": starts, "columns": columns, "values": values, "rows": rows, "signs": signs, "width": width, "back": (*each[:2], of, column, share)}
        used, x, _, _ = _batch_of(place, 0, batch)
        of_one.append(x.size * math.ceil(len(signs) / batch))
        if parts[-1] and sum(of_one[-len(parts[-1]) - 1:]) > KEPT_CELLS:
            parts.append([])
        parts[-1].append(place)
    for part in parts:
        _step_part(part, rate, strength, passes, batch)


def _batch_of(rows: dict, low: int, batch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_dense of the rows from `low` on."""
    high = min(low + batch, len(rows["signs"]))
    if high <= low:
        return np.empty(0, np.int64), np.empty((0, 0)), np.empty((0, rows["signs"].shape[1])), np.empty(0, np.int64)
    cut = slice(rows["starts"][low], rows["starts"][high])
    return _dense(rows["columns"][cut], rows["values"][cut], rows["rows"][cut] - low, rows["signs"][low:high])


def _step_part(sets: list[dict], rate: float, strength: float, passes: int, batch: int) -> None:
    classes = sets[0]["signs"].shape[1]
    firsts = np.cumsum([0, *[s["width"] + 1 for s in sets]])  # a column of zeros ends each set
    joined = np.zeros((int(firsts[-1]), classes))
    for s, first in zip(sets, firsts):
        weights, _, of, column, share = s["back"]
        own = joined[first:first + s["width"]]
        np.add.at(own, column, share[:, None] * weights[of])
        weights[of] -= share[:, None] * own[column]  # no row sees this part, it only shrinks
    bias = np.stack([s["back"][1] for s in sets])
    chunk = np.dtype((np.void, joined.strides[0] or 8))
    moved = joined.view(chunk)[:, 0]  # to copy all classes of a column at once

    def block(low: int):
        found = [_batch_of(s, low, batch) for s in sets]
        high, wide = (max(f[1].shape[i] for f in found) for i in (0, 1))
        used = np.repeat(firsts[1:, None] - 1, wide, axis=1)
        x, y, force = np.zeros((len(sets), high, wide)), np.zeros((len(sets), high, classes)), np.zeros((len(sets), high, classes))
        shrink = np.ones(len(sets))
        for i, (u, rows, signs, times) in enumerate(found):
            used[i, :len(u)], x[i, :rows.shape[0], :rows.shape[1]], y[i, :len(signs)] = firsts[i] + u, rows, signs
            force[i, :len(signs)] = signs * (rate * times)[:, None]
            shrink[i] = (1 - rate * strength) ** int(times.sum())
        return used.ravel(), x, x.transpose(0, 2, 1), y, force, shrink

    lows, kept, cells = range(0, max(len(s["signs"]) for s in sets), batch), {}, 0
    for _ in range(passes):
        factor = np.ones(len(sets))
        for low in lows:
            here = kept.get(low) or block(low)
            used, x, turned, y, force, shrink = here
            if low not in kept and cells + x.size <= KEPT_CELLS:
                kept[low], cells = here, cells + x.size
            own = joined.take(used, axis=0).reshape(len(sets), -1, classes)
            margin = np.matmul(x, own)
            margin *= factor[:, None, None]
            margin += bias[:, None, :]
            margin *= y
            pull = force * (margin < 1)
            factor *= shrink
            bias += np.add.reduce(pull, axis=1)
            if len(used):
                pull /= factor[:, None, None]
                own += np.matmul(turned, pull)
                moved[used] = own.reshape(-1, classes).view(chunk)[:, 0]
        for s, first, shrunk in zip(sets, firsts, factor):
            joined[first:first + s["width"]] *= shrunk
            s["back"][0][...] *= shrunk
    for s, first, b in zip(sets, firsts, bias):
        weights, own_bias, of, column, share = s["back"]
        weights[of] += share[:, None] * joined[first:first + s["width"]][column]
        own_bias[:] = b


def _round(rows: DataFrame, key: str, start: dict, terms: list[str], labels: list[str], parts: int, together: int, passes: int, rate: float,
           strength: float) -> DataFrame:
    """label, term, weight after `passes` over every part of the rows, averaged by rows. A call steps up to `together` parts side by side."""
    shared = rows.sparkSession.sparkContext.broadcast(start)
    width, names = len(terms), np.array(labels)
    calls = math.ceil(parts / together)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets, begin = [], shared.value
        for _, part in group.sort_values(["_part", "_order", key], kind="stable").groupby("_part"):
            weights, bias = np.zeros((width, len(names))), np.zeros(len(names))
            weights[begin["terms"], begin["labels"]] = begin["values"]
            bias[:] = begin["bias"]
            sizes = part["terms"].map(len).to_numpy()
            flat = (lambda c, kind: np.concatenate(part[c].to_list()).astype(kind) if sizes.sum() else np.empty(0, kind))
            signs = np.where(part["label"].to_numpy()[:, None] == names[None, :], 1.0, -1.0)
            sets.append((weights, bias, np.concatenate([[0], np.cumsum(sizes)]), flat("terms", np.int64), flat("values", float), signs))
        steps_of_all(sets, rate, strength, passes)
        weights, bias = (sum(s[i] * len(s[5]) for s in sets) for i in (0, 1))
        t, c = np.nonzero(weights)
        places = pd.DataFrame({"c": np.concatenate([c, np.arange(len(names))]), "t": np.concatenate([t, np.full(len(names), -1)]),
                               "weight": np.concatenate([weights[t, c], bias])})
        return places.assign(n=np.int64(len(group)))

    dealt = rows.withColumn("_order", F.xxhash64(F.col(key))).withColumn("_part", F.pmod(F.col("_order"), F.lit(parts)))
    dealt = dealt.withColumn("_call", F.pmod("_part", F.lit(calls))).repartition(4 * calls, "_call")  # few calls share a task
    found = dealt.groupBy("_call").applyInPandas(run, "c int, t int, weight double, n long")
    # every call has a row for every bias, so their counts add up to the rows of the pass
    summed = found.groupBy("c", "t").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))
    return materialize(summed, "svm-weights")


def _as_start(summed: DataFrame, n: int, classes: int) -> dict:
    """At most classes x MAX_FEATURES numbers."""
    found = summed.toPandas()
    at_bias = found["t"] < 0
    bias = np.zeros(classes)
    bias[found.loc[at_bias, "c"]] = found.loc[at_bias, "weight"] / n
    rest = found[~at_bias]
    return {"terms": rest["t"].to_numpy(), "labels": rest["c"].to_numpy(), "values": rest["weight"].to_numpy() / n, "bias": bias}


def _descend(rows: DataFrame, key: str, terms: list[str], labels: list[str], start: dict, rounds: list[int], per_task: int, rate: float,
             strength: float) -> DataFrame:
    spark = rows.sparkSession
    n = rows.count()
    parts = max(1, math.ceil(n / per_task))
    together = max(1, min(SIDE_BY_SIDE, parts // LEAST_CALLS, ROWS_PER_UPDATE // per_task))
    for passes in rounds if n else []:
        start = _as_start(_round(rows, key, start, terms, labels, parts, together, passes, rate, strength), n, len(labels))
    found = [(labels[c], terms[t], float(w)) for t, c, w in zip(start["terms"], start["labels"], start["values"])]
    found += [(label, None, float(b)) for label, b in zip(labels, start["bias"])]
    return materialize(spark.createDataFrame(found, "label string, term string, weight double"), "svm-model")


def svm_fit(docs: DataFrame, key: str, text: str, label: str, passes: int = PASSES, learning_rate: float = LEARNING_RATE,
            regularisation: float = REGULARISATION, merges: int = MERGES, vocabulary: DataFrame | None = None) -> Svm:
    """A new model of the classes in `label`; rows without a label take no part. With `vocabulary`, that of the labelled rows,
    they hold their tfidf_vectors over it in a column _x, and no text is read."""
    if vocabulary is None:
        docs = materialize(docs.select(key, text, label).filter(F.col(label).isNotNull()), "svm-docs")
        vocabulary = materialize(tfidf_fit(docs, key, text), "svm-vocabulary")
        places, terms = _numbered(vocabulary)
        rows = feature_rows(docs, key, text, label, places)
    else:
        terms = numbered(vocabulary)[0]
        rows = docs.filter(F.col(label).isNotNull()).select(key, F.col(label).cast("string").alias("label"), "_x.terms", "_x.values")
    rows = materialize(rows, "svm-rows")
    labels = sorted(r[0] for r in rows.select("label").distinct().collect())
    rounds = [passes // merges + (i < passes % merges) for i in range(min(merges, passes))]
    nothing = {"terms": np.empty(0, int), "labels": np.empty(0, int), "values": np.empty(0), "bias": np.zeros(len(labels))}
    weights = _descend(rows, key, terms, labels, nothing, rounds, ROWS_PER_TASK, learning_rate, regularisation)
    return Svm(vocabulary, weights, labels, learning_rate, regularisation)


def svm_update(model: Svm, new: DataFrame, key: str, text: str, label: str) -> Svm:
    """One pass over the new rows from the stored weights. Rows of a class that the model does not know count
    against all its classes; terms it does not know are left out."""
    numbered, terms = _numbered(model.vocabulary)
    rows = materialize(feature_rows(new.filter(F.col(label).isNotNull()), key, text, label, numbered), "svm-rows")
    place, named = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(model.labels)}
    stored = [(r["label"], r["term"], r["weight"]) for r in model.weights.collect()]
    bias = np.zeros(len(named))
    for x, t, w in stored:
        if t is None:
            bias[named[x]] = w
    inner = [(place[t], named[x], w) for x, t, w in stored if t is not None]
    start = {"terms": np.array([a for a, _, _ in inner], int), "labels": np.array([b for _, b, _ in inner], int),
             "values": np.array([w for _, _, w in inner], float), "bias": bias}
    weights = _descend(rows, key, terms, model.labels, start, [1], ROWS_PER_UPDATE, model.learning_rate, model.regularisation)
    return Svm(model.vocabulary, weights, model.labels, model.learning_rate, model.regularisation)


def svm_score(docs: DataFrame, model: Svm, text: str, vectors: str | None = None) -> DataFrame:
    """Adds label of the largest margin (the first of equal ones), and confidence: the sigmoid of the largest absolute
    margin. The weights (at most classes x MAX_FEATURES numbers) are shared; a row is scored where it lies. `vectors` names a column
    of tfidf_vectors over the vocabulary of the model, where there is one."""
    terms, idf = numbered(model.vocabulary)
    place, named = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(model.labels)}
    weights, bias = np.zeros((len(terms), len(named))), [0.0] * len(named)
    for r in model.weights.groupBy("label", "term").agg(F.sum("weight").alias("weight")).collect():
        if r["label"] not in named or (r["term"] is not None and r["term"] not in place):
            continue
        if r["term"] is None:
            bias[named[r["label"]]] = r["weight"]
        else:
            weights[place[r["term"]], named[r["label"]]] = r["weight"]
    rows = docs.withColumn("_v", F.col(vectors)) if vectors else tfidf_vectors(docs, text, terms, idf, "_v")
    given = F.array(*[F.lit(b) for b in bias])
    rows = rows.withColumn("_m", F.zip_with(class_sums("_v", weights), given, lambda s, b: s + b))
    best = F.array_position("_m", F.array_max("_m"))
    strongest = F.array_max(F.transform("_m", lambda m: F.abs(m)))
    names = F.array(*[F.lit(x) for x in model.labels])
    return rows.select(*docs.columns, F.element_at(names, best.cast("int")).alias("label"), (1 / (1 + F.exp(-strongest))).alias("confidence"))


def svm_predict(docs: DataFrame, model: Svm, key: str, text: str) -> DataFrame:
    """key, label, confidence of every document."""
    return svm_score(docs.select(key, F.col(text).alias("_text")), model, "_text").drop("_text")
