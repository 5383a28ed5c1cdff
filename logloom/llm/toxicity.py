"""Toxicity: significant passages by maximum-scoring segments, calibrated by extreme values."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import WORD, fresh, words_of, worker_store

#: Labelled documents that the fit reads at most, chosen by a hash of their id. It bounds the model.
FIT_ROWS = 20_000
#: Entries of the model at most, those with the strongest evidence first.
MODEL_ENTRIES = 100_000
#: Every token costs this much, so that a chance run of ordinary words scores below zero.
DRIFT = 0.05
#: Pseudo-tokens that pull an entry towards the entry of its shorter prefix.
PRIOR = 2.0
PREFIXES = range(3, 8)
KEPT_WORDS = 400_000
EULER = 0.5772156649


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels no fit may read."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def entries_of(word: str) -> list[str]:
    """The prefixes of a word, shortest first, then the word itself with an end mark."""
    return [word[:k] for k in PREFIXES if len(word) >= k] + [word + "$"]


class Scores(dict):
    """Score of each word: the log-odds of its longest known entry, less the drift."""

    def __init__(self, entries: dict[str, float]):
        self.entries = entries

    def __missing__(self, word: str) -> float:
        if len(self) >= KEPT_WORDS:
            self.clear()
        known = next((self.entries[e] for e in reversed(entries_of(word)) if e in self.entries), 0.0)
        self[word] = found = known - DRIFT
        return found


@dataclass
class Model:
    """`entries` are token log-odds; `rate` and `log_k` calibrate segment scores; `weights` turn the
    calibrated statistics of a document into a probability. Without weights every score is `base`."""

    entries: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    log_k: float = 0.0
    weights: list[float] | None = None
    base: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence, in one pass over it."""
    ends = np.cumsum(scores)
    at = np.flatnonzero(scores > 0)
    stack: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum at the end
    for i, low, high in zip(at.tolist(), (ends[at] - scores[at]).tolist(), ends[at].tolist()):
        cur = (i, i, low, high)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= cur[2]:
                j -= 1
            if j < 0 or stack[j][3] >= cur[3]:
                break
            cur = (stack[j][0], cur[1], stack[j][2], cur[3])
            del stack[j:]
        stack.append(cur)
    return [(a, b, high - low) for a, b, low, high in stack]


def statistics(scores: np.ndarray, model: Model) -> tuple[list[float], list[tuple[int, int, float, float]]]:
    """What the probability is made of, and the significant segments with their expected number of
    chance finds in a text of this length (significant: below one in twenty)."""
    if not len(scores):
        return [0.0, 0.0, 0.0], []
    chance = model.log_k + math.log(len(scores))
    found, best, total = [], 0.0, 0.0
    for a, b, s in maximal_segments(scores):
        bits = model.rate * s - chance
        best = max(best, bits)
        if bits > 3.0:
            total += bits
            found.append((a, b, s, math.exp(-bits)))
    share = max(0.0, float(scores[scores > 1.0].sum())) / (len(scores) + 20.0)
    return [math.log1p(best), math.log1p(total), share], found


def sample_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """At most `fit_rows` labelled documents outside the held-out rows as (text, toxic, fold). Equal
    texts count once. Of several labels of a document the toxic one wins; other values than 0 and 1 do not count."""
    chosen = (labels.filter(~held_out(id_col) & F.col("toxic").isin(0, 1))
              .groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("_id"), "_id").limit(fit_rows))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "_id").filter("text is not null")  # fit_rows bounds the broadcast
    return (joined.groupBy(F.xxhash64("text").alias("_h"), "toxic").agg(F.first("text").alias("text"))
            .select("text", F.col("toxic").cast("int").alias("toxic"), F.pmod("_h", F.lit(2)).cast("int").alias("fold")))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens and documents per (entry, toxic, fold), summed in the task before they are shuffled."""
    def out() -> pd.DataFrame:
        keys = list(tokens)
        return pd.DataFrame({"entry": pd.Series([k[0] for k in keys], dtype=object), "toxic": [k[1] for k in keys], "fold": [k[2] for k in keys],
                             "n": [tokens[k] for k in keys], "docs": [seen[k] for k in keys]})

    tokens: Counter = Counter()
    seen: Counter = Counter()
    for batch in batches:
        for text, toxic, fold in zip(batch["text"], batch["toxic"], batch["fold"]):
            own: Counter = Counter()
            for w, n in Counter(words_of(text)).items():
                for e in entries_of(w):
                    own[e, toxic, fold] += n
            tokens.update(own)
            seen.update(own.keys())
            if len(tokens) > 300_000:
                yield out()
                tokens.clear()
                seen.clear()
    yield out()


def log_odds(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Log-odds of each entry, given its tokens in toxic and clean documents and all their tokens. Each entry has a
    Dirichlet prior at the estimate of the longest shorter prefix that is known; the root is even."""
    out: dict[str, float] = {}
    for entry in sorted(counts, key=lambda e: (len(e) - e.endswith("$"), e.endswith("$"), e)):
        word = entry.rstrip("$")
        above = next((out[word[:k]] for k in reversed(PREFIXES) if k <= len(word) and word[:k] != entry
                      and word[:k] in out), 0.0)
        share = toxic * math.exp(above) / (toxic * math.exp(above) + clean)
        a, b = counts[entry]
        out[entry] = math.log((a + PRIOR * share) / (b + PRIOR * (1 - share)) * clean / toxic)
    return out


def _calibrate(model: Model, background: np.ndarray, best: np.ndarray, lengths: np.ndarray) -> None:
    """Rate and constant of the extreme-value law from clean documents: the rate solves
    E[exp(rate * score)] = 1 over their tokens, the constant fits their best segments."""
    if background.max(initial=0) > 0 and background.mean() < 0:
        low, high = 0.0, 1.0
        while np.exp(high * background).mean() < 1 and high < 64:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if np.exp(mid * background).mean() < 1 else (low, mid)
        model.rate = max(1e-3, low)
    if len(best):
        model.log_k = float((model.rate * best - np.log(lengths)).mean()) - EULER


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _summaries(rows: DataFrame, models: list[Model]) -> pd.DataFrame:
    """Per sampled document, scored by the model of the other fold: best raw segment, length, and
    a sketch of token scores (sums of powers are not enough for the rate, so a histogram)."""
    entries = rows.sparkSession.sparkContext.broadcast([m.entries for m in models])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stores = [Scores(e) for e in entries.value]
        for batch in batches:
            out = []
            for text, toxic, fold in zip(batch["text"], batch["toxic"], batch["fold"]):
                words = words_of(text)
                s = np.fromiter(map(stores[fold].__getitem__, words), float, len(words))
                values, n = np.unique(np.round(s, 1), return_counts=True)
                out.append((toxic, fold, max((x[2] for x in maximal_segments(s)), default=0.0), len(s), values, n,
                            [x[2] for x in maximal_segments(s)], float(s[s > 1.0].sum()) if len(s) else 0.0))
            yield pd.DataFrame(out, columns=["toxic", "fold", "best", "n", "values", "counts", "segments", "high"])

    return rows.mapInPandas(score, "toxic int, fold int, best double, n long, values array<double>, "
                            "counts array<long>, segments array<double>, high double").toPandas()


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from a bounded sample of labelled rows (see sample_rows). Two folds give the documents
    of the sample scores by words that others taught, for the calibration; the model has both folds.
    Without toxic or without clean documents, every score is the share of toxic ones (0 if none)."""
    rows = sample_rows(docs, labels, fit_rows, id_col, text_col).persist()
    try:
        sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
        base = toxic / (toxic + clean) if toxic + clean else 0.0
        if not toxic or not clean:
            return Model(base=base)
        counted = rows.mapInPandas(_count, "entry string, toxic int, fold int, n long, docs long")
        of = lambda c, t, k: F.sum(F.when((F.col("toxic") == t) & (F.col("fold") == k), F.col(c)).otherwise(0)).alias(f"{c}{t}{k}")
        table = counted.groupBy("entry").agg(*[of(c, t, k) for c in ("n", "docs") for t in (1, 0) for k in (0, 1)])
        a, b = F.col("docs10") + F.col("docs11"), F.col("docs00") + F.col("docs01")
        lean = F.abs(a - (a + b) * base) / F.sqrt((a + b) * base * (1 - base))
        kept = table.filter((a + b >= 3) & (lean >= 1.5)).orderBy(lean.desc(), "entry").limit(MODEL_ENTRIES).collect()
        words = rows.select("toxic", "fold", F.size(F.split("text", " ")).alias("n")).groupBy("toxic", "fold").sum("n")
        size = {(r[0], r[1]): r[2] for r in words.collect()}
        of_class = lambda t, *folds: sum(size.get((t, k), 0) for k in folds)
        whole = Model(log_odds({r[0]: (r.n10 + r.n11, r.n00 + r.n01) for r in kept}, of_class(1, 0, 1), of_class(0, 0, 1)), base=base)
        halves = []
        for k in (1, 0):  # what fold 0 is scored with comes from fold 1
            known = {r[0]: (r[f"n1{k}"], r[f"n0{k}"]) for r in kept if r[f"docs1{k}"] + r[f"docs0{k}"] >= 2}
            n = of_class(1, k), of_class(0, k)
            halves.append(Model(log_odds(known, *n) if all(n) else {}))
        seen = _summaries(rows, halves)
    finally:
        rows.unpersist()
    plain = seen[(seen["toxic"] == 0) & (seen["n"] > 0)]
    histogram: Counter = Counter()
    for values, n in zip(plain["values"], plain["counts"]):
        histogram.update(dict(zip(np.round(values, 1).tolist(), np.asarray(n).tolist())))
    if histogram:
        values, n = np.array(list(histogram), float), np.array(list(histogram.values()), float)
        sized = np.repeat(values, np.maximum(1, n * (100_000 / n.sum())).astype(int))
        _calibrate(whole, sized, plain["best"].to_numpy(), plain["n"].to_numpy())
    x = []
    for segments, n, high in zip(seen["segments"], seen["n"], seen["high"]):
        bits = whole.rate * np.asarray(segments, float) - (whole.log_k + math.log(n)) if n else np.zeros(0)
        x.append([math.log1p(max(0.0, bits.max(initial=0.0))), math.log1p(float(bits[bits > 3.0].sum())), max(0.0, high) / (n + 20.0)])
    whole.weights = _logistic(np.array(x), (seen["toxic"] == 1).to_numpy(float))
    return whole


SCORED = ("score double, passage_starts array<int>, passage_ends array<int>, passage_scores array<double>, "
          "passage_e_values array<double>")


def scorer(model: Model):
    """A column function text -> score and significant toxic passages (offsets in characters, end
    exclusive, segment score, expected number of such chance finds). Null and empty texts have no
    words: they get the probability of a text without any toxic passage."""
    shared = {"store": None}

    @F.pandas_udf(SCORED)
    def score(texts: pd.Series) -> pd.DataFrame:
        if shared["store"] is None:
            shared["store"] = worker_store(("scores", model.name), lambda: Scores(model.entries))
        out = []
        for text in texts:
            words = words_of(text)
            s = np.fromiter(map(shared["store"].__getitem__, words), float, len(words))
            stats, found = statistics(s, model)
            if model.weights is None:
                p = model.base
            else:
                p = 1 / (1 + math.exp(-min(30.0, max(-30.0, model.weights[0] + float(np.dot(model.weights[1:], stats))))))
            spans = [m.span() for m in WORD.finditer(text.lower())] if found else []
            out.append((p, [spans[a][0] for a, *_ in found], [spans[b][1] for _, b, *_ in found],
                        [x[2] for x in found], [x[3] for x in found]))
        return pd.DataFrame(out, columns=["score", "passage_starts", "passage_ends", "passage_scores", "passage_e_values"])

    return score


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with score, passage_* columns (replaced where the input has them already)."""
    names = [part.split()[0] for part in SCORED.split(", ")]
    docs = docs.drop(*names)
    scored = fresh(docs.columns, "_scored")
    return docs.select("*", scorer(model)(F.col(text_col).cast("string")).alias(scored)).select(
        *[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{scored}.{n}") for n in names])
