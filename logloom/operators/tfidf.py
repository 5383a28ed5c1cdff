"""TF-IDF over word 1- and 2-grams with a bounded vocabulary.

A document is one row, so its terms are counted and its weights scaled inside the row: nothing is grouped by document,
and the memory of a task does not grow with the documents it reads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import fixed
from logloom.functions.text import log_tokens, word_ngrams
from logloom.session import materialize

MAX_FEATURES = 5000


def grams(docs: DataFrame, text: str, name: str = "_grams") -> DataFrame:
    """Adds the word 1- and 2-grams of every document, with repeats."""
    return docs.withColumn(name, word_ngrams(log_tokens(F.col(text))))


def tfidf_fit(docs: DataFrame, key: str, text: str, max_features: int = MAX_FEATURES, min_df: int = 2) -> DataFrame:
    """term, df, idf of the most frequent terms; ties by term. At most max_features rows."""
    n = docs.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))
    terms = grams(docs.select(text), text).select(F.explode(F.array_distinct("_grams")).alias("term")).filter("term IS NOT NULL")
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)
    top = df.orderBy(F.col("df").desc(), "term").limit(max_features).withColumn("_k", F.lit(1))
    return top.join(n, "_k").select("term", "df", (F.log((F.col("_n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def numbered(vocabulary: DataFrame) -> tuple[list[str], np.ndarray]:
    """The sorted terms and their idf; at most MAX_FEATURES of them."""
    rows = sorted((r["term"], r["idf"]) for r in vocabulary.select("term", "idf").collect())
    return [t for t, _ in rows], np.array([i for _, i in rows], float)


def as_lists(rows: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """One list per row from flat values that are sorted by row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of every list entry, and the entries."""
    return np.asarray(pc.list_parent_indices(lists)), np.asarray(pc.list_flatten(lists))


VECTOR = "struct<terms: array<int>, values: array<double>>"


def _weighed(row: np.ndarray, term: np.ndarray, counts: np.ndarray, idf: np.ndarray, n: int, damped: bool = True) -> pa.StructArray:
    """The vectors of n rows from the counts of their terms, sorted by row and term."""
    weight = (1 + np.log(counts) if damped else counts) * idf[term]
    norms = np.sqrt(np.bincount(row, weight * weight, n))
    return pa.StructArray.from_arrays([as_lists(row, term, n, pa.int32()), as_lists(row, weight / norms[row], n, pa.float64())], ["terms", "values"])


def _counted(found: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the vocabulary and count of every known term, sorted by row and place."""
    rows = np.asarray(pc.list_parent_indices(found)).astype(np.int64)
    places = pc.index_in(pc.list_flatten(found).cast(pa.string()), value_set=known)
    hit = np.asarray(pc.is_valid(places))
    cells, counts = np.unique(rows[hit] * len(known) + np.asarray(places.drop_null()).astype(np.int64), return_counts=True)
    return *np.divmod(cells, max(len(known), 1)), counts


def tfidf_vectors(docs: DataFrame, text: str, terms: list[str], idf: np.ndarray, name: str = "_x", found: F.Column | None = None,
                  damped: bool = True) -> DataFrame:
    """Adds struct<terms: array<int>, values: array<double>>: the places of the known terms of every document in the
    sorted vocabulary, ascending, and their weights, with unit length; empty without a known term. `found` gives the grams
    of a text in place of its word 1- and 2-grams; without `damped` a term weighs by its plain count."""
    shared = docs.sparkSession.sparkContext.broadcast((pa.array(terms, pa.string()), idf))

    @F.arrow_udf(VECTOR)
    def weigh(found: pa.Array) -> pa.Array:
        known, idf = shared.value
        return _weighed(*_counted(found, known), idf, len(found), damped)

    return docs.withColumn(name, weigh(word_ngrams(log_tokens(F.col(text))) if found is None else found))


def content_grams(text: F.Column) -> F.Column:
    """1- and 2-grams of the words of two letters or more that are no English stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return word_ngrams(F.filter(words, lambda w: ~w.isin(fixed.ENGLISH_STOP_WORDS)), sep=" ")


def content_fit(docs: DataFrame, text: str, max_features: int = MAX_FEATURES, min_df: int = 5, max_share: float = 0.95) -> DataFrame:
    """term, df, idf of the content_grams that stand in at least min_df documents and in at most max_share of them: the most
    often used ones, ties by term. At most max_features rows."""
    n = docs.count()
    found = docs.select(content_grams(F.col(text)).alias("_g"))
    each, once = (F.transform(g, lambda t: F.struct(t.alias("term"), F.lit(new).alias("new"))) for g, new in ((F.col("_g"), 0), (F.array_distinct("_g"), 1)))
    uses = found.select(F.explode(F.concat(each, once)).alias("_u")).groupBy("_u.term").agg(
        F.sum("_u.new").alias("df"), F.sum(1 - F.col("_u.new")).alias("_times"))
    top = uses.filter((F.col("df") >= min_df) & (F.col("df") <= max_share * n)).orderBy(F.col("_times").desc(), "term").limit(max_features)
    return top.select("term", "df", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf"))


# --- several vocabularies over nested subsets, each text read twice in all --------------
def nested_fits(docs: DataFrame, text: str, since: str, steps: list[float], max_features: int = MAX_FEATURES, min_df: int = 2) -> list[DataFrame]:
    """tfidf_fit of the rows whose `since` is at most s, for each s of `steps`; the texts are read once for all."""
    taken = [F.count_if(F.col(since) <= s) for s in steps]
    sizes = docs.agg(*taken).first()
    terms = grams(docs.select(text, since), text).select(since, F.explode(F.array_distinct("_grams")).alias("term")).filter("term IS NOT NULL")
    df = terms.groupBy("term").agg(*[c.alias(f"_df{i}") for i, c in enumerate(taken)])
    df = materialize(df.filter(F.greatest(F.lit(0), *[f"_df{i}" for i in range(len(steps))]) >= min_df), "term-counts")
    return [df.select("term", F.col(f"_df{i}").alias("df")).filter(F.col("df") >= min_df).orderBy(F.col("df").desc(), "term").limit(max_features)
            .select("term", "df", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf")) for i, n in enumerate(sizes)]


def term_counts(docs: DataFrame, text: str, terms: list[str], name: str = "_counts") -> DataFrame:
    """Adds struct<terms, values>: the places of the known terms of every document in the sorted list, ascending, and their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(terms, pa.string()))

    @F.arrow_udf("struct<terms: array<int>, values: array<int>>")
    def count(found: pa.Array) -> pa.Array:
        row, term, counts = _counted(found, shared.value)
        return pa.StructArray.from_arrays([as_lists(row, term, len(found), pa.int32()), as_lists(row, counts, len(found), pa.int32())], ["terms", "values"])

    return docs.withColumn(name, count(word_ngrams(log_tokens(F.col(text)))))


def weigh_counts(docs: DataFrame, counts: str, terms: list[str], part: list[str], idf: np.ndarray, name: str = "_x") -> DataFrame:
    """tfidf_vectors over the sorted terms `part`, from the term_counts over the sorted terms `terms`, which hold them."""
    place = {t: i for i, t in enumerate(part)}
    shared = docs.sparkSession.sparkContext.broadcast((np.array([place.get(t, -1) for t in terms], np.int64), idf))

    @F.arrow_udf(VECTOR)
    def weigh(found: pa.Array, counts: pa.Array) -> pa.Array:
        places, idf = shared.value
        row, term = flat(found)
        term = places[term]
        hit = term >= 0
        return _weighed(row[hit], term[hit], flat(counts)[1][hit], idf, len(found))

    return docs.withColumn(name, weigh(F.col(f"{counts}.terms"), F.col(f"{counts}.values")))


def class_sums(vectors: str, weights: np.ndarray) -> F.Column:
    """array<double>: of every class, the sum of value * weight over the terms of a vector column; `weights` is terms x classes."""
    shared = SparkSession.active().sparkContext.broadcast(weights)

    @F.arrow_udf("array<double>")
    def sums(terms: pa.Array, values: pa.Array) -> pa.Array:
        weights = shared.value
        rows, term = flat(terms)
        value = flat(values)[1]
        out = np.stack([np.bincount(rows, value * column[term], len(terms)) for column in weights.T], axis=1) if len(term) else np.zeros((len(terms), weights.shape[1]))
        return as_lists(np.repeat(np.arange(len(terms)), weights.shape[1]), out.ravel(), len(terms), pa.float64())

    return sums(F.col(f"{vectors}.terms"), F.col(f"{vectors}.values"))


def tfidf_transform(docs: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """key, term, weight with unit length per document. Documents without a known term have no rows."""
    terms, idf = numbered(vocabulary)
    if not terms:
        return docs.select(key, F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("weight")).filter("false")
    names = docs.sparkSession.createDataFrame(list(enumerate(terms)), "_t int, term string")
    pairs = tfidf_vectors(docs, text, terms, idf).select(key, F.explode(F.arrays_zip("_x.terms", "_x.values")).alias("_p"))
    return pairs.select(key, F.col("_p.terms").alias("_t"), F.col("_p.values").alias("weight")).join(
        F.broadcast(names), "_t").select(key, "term", "weight")
