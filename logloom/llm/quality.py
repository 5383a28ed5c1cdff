"""Quality by an interpolated modified Kneser-Ney model of characters, trained on trusted text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import with_row_id
from logloom.scale import exact_quantiles
from logloom.session import discard, materialize

ORDER = 5
#: Share of the trusted documents of a language that its threshold keeps.
QUANTILE = 0.97
#: Rows of a file whose n-grams are looked up together.
CHUNK_ROWS = 4096
#: Distinct n-grams that a task holds at most.
HELD_GRAMS = 500_000
#: Characters that are looked at together.
HELD_CHARS = 2_000_000
START, END = "\x02", "\x03"


def plain_words(text: str | None) -> list[str]:
    """White-space separated words; a start or end mark inside a text parts words too."""
    if text and (START in text or END in text):
        text = text.replace(START, " ").replace(END, " ")
    return (text or "").split()


def running(text: str | None, order: int = ORDER) -> str:
    """The text as the model reads it: its words with single blanks, start marks before and an end mark behind it.
    Empty without words."""
    words = plain_words(text)
    return START * (order - 1) + " ".join(words) + END if words else ""


def grams_of(marked: str, order: int) -> list[str]:
    """The n-gram that ends at each character, in the order of the text."""
    return [marked[i:i + order] for i in range(len(marked) - order + 1)]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed_grams(marked: list[str], order: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Of all n-grams of the texts together: the texts joined, where in them each n-gram starts, its 64-bit hash, and how
    many n-grams each text has. Texts are empty or have at least `order` characters."""
    whole = "".join(marked)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    counts = np.maximum(sizes - order + 1, 0)
    firsts = np.cumsum(sizes) - sizes
    at = np.repeat(firsts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    h = np.zeros(max(len(codes) - order + 1, 0), np.uint64)
    for k in range(order):
        h = (h ^ codes[k:k + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    return whole, at, h[at].view(np.int64), counts


def _parts(texts: Iterable[str | None], order: int) -> Iterator[list[str]]:
    """Running texts, about HELD_CHARS at a time."""
    held, size = [], 0
    for text in texts:
        held.append(running(text, order))
        size += len(held[-1])
        if size >= HELD_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) of the running texts: summed in the tasks first, so that the shuffle carries distinct n-grams."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: Counter = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame({"gram": pd.Series(list(grams), dtype=object), "n": list(grams.values())})

        for batch in batches:
            for part in _parts(batch["text"], order):
                whole, at, h, _ = hashed_grams(part, order)
                _, first, n = np.unique(h, return_index=True, return_counts=True)
                for i, k in zip(at[first].tolist(), n.tolist()):
                    grams[whole[i:i + order]] += k
                if len(grams) > HELD_GRAMS:
                    yield out()
                    grams.clear()
        yield out()

    return texts.mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(table: DataFrame) -> list[float]:
    """D1, D2 and D3+ from how many n-grams were counted once, twice, three and four times."""
    got = {r["n"]: r["count"] for r in table.filter("n <= 4").groupBy("n").count().collect()}
    n1, n2, n3, n4 = (got.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(k + 0.9, max(0.05, d)) for k, d in enumerate(raw)]


def fit(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, p, gamma): the interpolated probability of the last character of each n-gram, and the
    weight that it leaves to shorter contexts where it is a context itself. Lower orders count the
    distinct characters before an n-gram instead of its occurrences. All counts come from joins of n-gram tables
    dealt by hash; n-grams run across the borders of words."""
    levels = {order: materialize(gram_counts(texts, order), "grams")}
    for n in range(order - 1, 0, -1):
        levels[n] = materialize(levels[n + 1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"grams-{n}")
    symbols = levels[1].count() + 1
    below, probs, gammas = None, [], []
    for n in range(1, order + 1):
        d = _discounts(levels[n])
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        table = levels[n].withColumns({"cut": F.least(cut, F.col("n")), "ctx": F.expr("substring(gram, 1, length(gram) - 1)")})
        ctx = table.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
        joined = table.join(ctx, "ctx")
        own, gamma = (F.col("n") - F.col("cut")) / F.col("total"), F.col("freed") / F.col("total")
        if below is None:
            p = joined.select("gram", (own + gamma / symbols).alias("p"))
        else:
            shorter = below.select(F.col("gram").alias("rest"), F.col("p").alias("q"))
            p = joined.withColumn("rest", F.expr("substring(gram, 2)")).join(shorter, "rest").select("gram", (own + gamma * F.col("q")).alias("p"))
        below = materialize(p, f"probability-{n}")
        probs.append(below)
        gammas.append(ctx.select(F.col("ctx").alias("gram"), gamma.alias("gamma")))
    p, g = probs[0], gammas[0]
    for more_p, more_g in zip(probs[1:], gammas[1:]):
        p, g = p.unionByName(more_p), g.unionByName(more_g)
    model = materialize(p.join(g, "gram", "full"), "model")
    discard(*levels.values(), *probs)
    return model


def log_probability(marked: str, known: dict[str, tuple[float, float]], unseen: float, order: int = ORDER) -> float:
    """Natural log-probability of all characters after the start marks, from a small model in memory. `known` has
    (p, gamma) by n-gram, with nan for what is missing; `unseen` is the probability of a new character."""
    total = 0.0
    for end in range(order, len(marked) + 1):
        weight = 1.0
        for begin in range(end - order, end):
            p = known.get(marked[begin:end], _NONE)[0]
            if p == p:
                total += math.log(weight * p)
                break
            gamma = known.get(marked[begin:end - 1], _NONE)[1]
            if gamma == gamma:
                weight *= gamma
        else:
            total += math.log(weight * unseen)
    return total


_NONE = (math.nan, math.nan)


def resolved(grams: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, logp) of distinct n-grams of the highest order: their own probability where the model has it, else that
    of the next shorter one times what the context leaves to it. The probability of a new character is what the
    empty context leaves to one symbol. Each length is one join over its distinct n-grams."""
    empty = model.filter("gram = ''").first()
    symbols = model.filter(F.length("gram") == 1).filter("p is not null").count() + 1
    unseen = (empty["gamma"] if empty and empty["gamma"] is not None else 1.0) / symbols
    p = model.filter("p is not null").select("gram", "p")
    gamma = model.filter("gamma is not null").select(F.col("gram").alias("ctx"), "gamma")
    below = None
    for n in range(1, order + 1):
        here = grams.select(F.expr(f"substring(gram, {order - n + 1})").alias("gram")).distinct()
        joined = here.join(p.filter(F.length("gram") == n), "gram", "left")
        if below is None:
            below = joined.select("gram", F.coalesce("p", F.lit(unseen)).alias("q"))
            continue
        joined = joined.withColumns({"ctx": F.expr(f"substring(gram, 1, {n - 1})"), "rest": F.expr("substring(gram, 2)")})
        joined = joined.join(gamma.filter(F.length("ctx") == n - 1), "ctx", "left").join(below.withColumnRenamed("gram", "rest"), "rest")
        below = joined.select("gram", F.coalesce("p", F.coalesce("gamma", F.lit(1.0)) * F.col("q")).alias("q"))
    return below.select("gram", F.log("q").alias("logp"))


def perplexities(docs: DataFrame, model: DataFrame, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """(_f, _r, perplexity) per document: of the characters of its running text and its end; null without words.

    Documents are taken in chunks of neighbouring rows. The distinct n-grams of all chunks meet the model once, and
    the answers meet their chunks again; neither the model nor a chunk's table is ever broadcast."""
    rows = with_row_id(docs.select(text_col)).select(
        "_f", "_r", F.col(text_col).cast("string").alias("text"), F.floor(F.col("_r") / CHUNK_ROWS).cast("long").alias("_c"))
    rows = rows.select("_f", "_r", "text", F.xxhash64("_f", "_c").alias("_c"))

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, chunk = np.empty(0, np.int64), None
        for batch in batches:
            for c, part in batch.groupby("_c", sort=False):
                if c != chunk or len(seen) > HELD_GRAMS:
                    seen, chunk = np.empty(0, np.int64), c
                for texts in _parts(part["text"], order):
                    whole, at, h, _ = hashed_grams(texts, order)
                    unique, first = np.unique(h, return_index=True)
                    new = ~np.isin(unique, seen, assume_unique=True)
                    seen = np.concatenate([seen, unique[new]])
                    grams = [whole[i:i + order] for i in at[first[new]].tolist()]
                    yield pd.DataFrame({"_c": c, "gram": pd.Series(grams, dtype=object)})

    asked = materialize(rows.mapInPandas(wanted, "_c long, gram string"), "asked")
    known = materialize(resolved(asked.select("gram").distinct(), model, order), "resolved")
    answers = materialize(asked.join(known, "gram").select("_c", "gram", "logp"), "answers")
    discard(asked, known)

    def score(docs: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        _, _, keys, _ = hashed_grams(table["gram"].to_list(), order)
        keys, first = np.unique(keys, return_index=True)
        logp, out = table["logp"].to_numpy(float)[first], []
        for texts in _parts(docs["text"], order):
            _, _, h, counts = hashed_grams(texts, order)
            sums = np.concatenate([[0.0], np.cumsum(logp[np.searchsorted(keys, h)] if len(h) else [])])
            ends = np.cumsum(counts)
            total = sums[ends] - sums[ends - counts]
            out += [math.exp(min(700.0, -x / n)) if n else None for x, n in zip(total.tolist(), counts.tolist())]
        return pd.DataFrame({"_f": docs["_f"], "_r": docs["_r"], "perplexity": pd.Series(out, index=docs.index, dtype="float64")})

    scored = rows.groupBy("_c").cogroup(answers.groupBy("_c")).applyInPandas(score, "_f long, _r long, perplexity double")
    return scored.withColumn("perplexity", F.when(~F.isnan("perplexity"), F.col("perplexity")))


def judge(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> DataFrame:
    """id, lang, perplexity, threshold, kept per document; `trusted` holds the ids of trusted ones (id_col).

    The model is trained on all trusted texts. A language's threshold is the exact quantile of the
    perplexities of its trusted documents; languages (null is one) without any take that of all
    trusted documents. Documents without words have no perplexity and are not kept; without any
    trusted text nothing is kept. Repeated rows are judged each; an empty table gives no rows."""
    ids = trusted.select(F.col(id_col).cast("string").alias("_id")).filter("_id is not null").distinct()
    rows = materialize(with_row_id(docs.select(id_col, text_col, lang_col)).select(
        "_f", "_r", F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
        .join(ids.withColumn("trusted", F.lit(True)), F.col("id").cast("string") == F.col("_id"), "left").drop("_id"), "judged")
    place = with_row_id(docs.select(text_col)).select("_f", "_r", F.col(text_col).cast("string").alias("text"))
    model = fit(place.join(rows.filter("trusted").select("_f", "_r"), ["_f", "_r"]).select("text"))
    scored = rows.join(perplexities(docs, model, text_col=text_col), ["_f", "_r"])
    scored = materialize(scored, "scored")
    good = scored.filter("trusted and perplexity is not null").select("lang", "perplexity")
    by_lang = exact_quantiles(good, ["lang"], "perplexity", [quantile]).withColumnRenamed("q_0", "own")
    overall = exact_quantiles(good, [], "perplexity", [quantile]).first()
    limit = F.coalesce("own", F.lit(overall["q_0"] if overall else None).cast("double"))
    joined = scored.alias("s").join(by_lang.alias("t"), F.col("s.lang").eqNullSafe(F.col("t.lang")), "left")
    return joined.select(F.col("s.id").alias(id_col), F.col("s.lang").alias(lang_col), "perplexity", limit.alias("threshold"),
                         F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("kept"))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """Ids with the quality label 1."""
    good: Column = F.col(quality_col) == 1
    return labels.filter(good).select(id_col)
