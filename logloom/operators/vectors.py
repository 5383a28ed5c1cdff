"""Vector search, semantic search, embedding of templates, evidence for questions."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import log_tokens, word_ngrams
from logloom.operators.logs import newest, sample_logs, template_count
from logloom.scale import top_n
from logloom.session import discard, materialize, spread
from logloom.schema import TEMPLATE_KEY

#: Bytes, as doubles, of the queries of one pass over the vectors.
QUERY_BYTES = 64 << 20
#: A task multiplies at most so many queries and vectors at a time, and emits its answers in batches of so many queries.
QUERIES_PER_CHUNK, QUERIES_PER_STEP, VECTORS_PER_STEP, ROWS_PER_BATCH = 4_096, 1_024, 1_024, 10_000


def same_dimension(vectors: DataFrame, dimension: int, column: str = "vector") -> DataFrame:
    """Rows of the given dimension; others raise, as they cannot be compared."""
    checked = F.when(F.size(column) == dimension, F.col(column)).otherwise(
        F.raise_error(F.concat(F.lit("vector dimension "), F.size(column).cast("string"))))
    return vectors.withColumn(column, checked)


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    norms[norms == 0] = 1
    return m / norms


def _offer(kept: tuple[np.ndarray, np.ndarray], ids: np.ndarray, sims: np.ndarray, k: int) -> None:
    """Merges similarities (queries x rows) into the kept scores and ids (queries x k, best first, ties by lower id).
    Only what reaches the k-th score kept so far is sorted."""
    scores, places = kept
    if sims.shape[1] > k:
        floor = np.maximum(scores[:, -1], np.partition(sims, sims.shape[1] - k, axis=1)[:, -k]) if np.isneginf(scores[0, -1]) else scores[:, -1]
    else:
        floor = scores[:, -1]
    q, at = np.nonzero(sims >= floor[:, None])
    if not len(q):
        return
    touched = np.unique(q)
    row = np.concatenate([np.repeat(touched, k), q])
    s = np.concatenate([scores[touched].ravel(), sims[q, at]])
    i = np.concatenate([places[touched].ravel(), ids[at]])
    order = np.lexsort((i, -s, row))
    first = np.searchsorted(row[order], touched)
    take = order[first[:, None] + np.arange(k)]
    scores[touched], places[touched] = s[take], i[take]


def _chunks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries as (ids, unit vectors), at most QUERY_BYTES at a time; the driver holds one such part."""
    ids, vectors, size = [], [], None
    for r in queries.toLocalIterator():
        if r.vector is None:
            continue
        if size is None:
            size = len(r.vector)
        elif len(r.vector) != size:
            raise ValueError(f"vector dimension {len(r.vector)} among queries of {size}")
        ids.append(r.query_id)
        vectors.append(np.array(r.vector, np.float64))
        if len(ids) * size * 8 >= QUERY_BYTES:
            yield np.array(ids), _unit(np.stack(vectors))
            ids, vectors = [], []
    if ids:
        yield np.array(ids), _unit(np.stack(vectors))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "vector",
                broadcast_limit: int = QUERIES_PER_CHUNK) -> DataFrame:
    """query_id, <key>, score, rank: exact cosine top-k of every query (query_id, vector).

    Queries go in parts of bounded bytes; each part is one pass over the vectors, which are written once if there are
    several. A task multiplies at most `broadcast_limit` queries with VECTORS_PER_STEP vectors at a time and keeps the k
    best of every query, so pairs are never emitted; the answer of a part is written before the next one starts.
    Vectors and queries of another dimension are an error; null ones take no part."""
    spark = vectors.sparkSession
    q = materialize(queries.select("query_id", "vector").filter("vector IS NOT NULL"), "vector-queries")
    v = vectors.select(F.col(key).alias("vec_id"), F.col(column).alias("vector")).filter("vector IS NOT NULL")
    v = materialize(v, "vectors")
    out = None
    for q_ids, mat in _chunks(q):
        shared = spark.sparkContext.broadcast((q_ids, mat))

        def local(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, right = shared.value
            scores = np.full((len(ids), k), -np.inf)
            places = np.full((len(ids), k), np.iinfo(np.int64).max)
            for b in batches:
                for low in range(0, len(b), VECTORS_PER_STEP):
                    part = b.iloc[low:low + VECTORS_PER_STEP]
                    left = _unit(np.stack(part["vector"].to_numpy()).astype(np.float64)).T
                    found = part["vec_id"].to_numpy()
                    for at in range(0, len(ids), step):
                        cut = slice(at, at + step)
                        _offer((scores[cut], places[cut]), found, right[cut] @ left, k)
            for at in range(0, len(ids), ROWS_PER_BATCH):
                here, rank = np.nonzero(scores[at:at + ROWS_PER_BATCH] > -np.inf)
                yield pd.DataFrame({"query_id": ids[at + here], "vec_id": places[at + here, rank], "score": scores[at + here, rank]})

        step = max(1, min(broadcast_limit, QUERIES_PER_STEP))
        best = same_dimension(spread(v), mat.shape[1]).mapInPandas(local, "query_id long, vec_id long, score double")
        ranked = materialize(top_n(best, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k, "rank"), "vector-topk")
        shared.destroy()
        out = ranked if out is None else out.unionByName(ranked)
    discard(q, v)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    return out.withColumnRenamed("vec_id", key) if key != "vec_id" else out


def hashed_embedding(text: Column, dimension: int = 64) -> Column:
    """Deterministic unit vector: words, word pairs and character 3-grams counted in hashed places
    with a hashed sign. Null for a blank text."""
    @F.pandas_udf("array<float>")
    def embed(words: pd.Series, texts: pd.Series) -> pd.Series:
        def one(grams, t):
            if t is None or not t.strip():
                return None
            low = t.lower()
            codes = np.array([zlib.crc32(g.encode()) for g in [*grams, *(low[i:i + 3] for i in range(len(low) - 2))]],
                             dtype=np.int64)
            out = np.zeros(dimension)
            np.add.at(out, (codes >> 1) % dimension, np.where(codes & 1, 1.0, -1.0))
            norm = np.linalg.norm(out)
            return (out / norm if norm else out).astype(np.float32)

        return pd.Series([one(g, t) for g, t in zip(words, texts)])

    return embed(word_ngrams(log_tokens(text)), text)


def embed_pending(templates: DataFrame, embedder: Callable[[Column], Column] = hashed_embedding, n: int | None = 1000,
                  model: str = "hashed-ngrams", now=None) -> tuple[DataFrame, DataFrame]:
    """(templates, vectors): embeds up to n waiting templates, latest first (None: all). `embedder` is a column
    function, for example a pandas UDF; a null or empty result marks the template failed."""
    from logloom.operators.logs import pending_templates
    stamp = F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()
    done = pending_templates(templates, n).select(*TEMPLATE_KEY, embedder(F.col("template_text")).alias("vector"))
    ok = F.col("vector").isNotNull() & (F.size("vector") > 0)
    state = done.select(*TEMPLATE_KEY, F.when(ok, "ready").otherwise("failed").alias("_state"))
    out = templates.join(state, TEMPLATE_KEY, "left")
    ready = F.coalesce(F.col("_state") == "ready", F.lit(False))
    for c, t in (("embedding_model", "string"), ("embedding_updated_utc", "timestamp")):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    out = (out.withColumn("embedding_model", F.when(ready, F.lit(model)).otherwise(F.col("embedding_model")))
           .withColumn("embedding_updated_utc", F.when(F.col("_state").isNotNull(), stamp).otherwise(F.col("embedding_updated_utc")))
           .withColumn("embedding_state", F.coalesce("_state", "embedding_state")).drop("_state"))
    return out, done.filter(ok).withColumn("updated_utc", stamp)


def upsert_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    cols = [*TEMPLATE_KEY, "vector", "updated_utc"]
    return vectors.select(*cols).unionByName(new.select(*cols)).groupBy(*TEMPLATE_KEY).agg(
        F.max_by("vector", "updated_utc").alias("vector"), F.max("updated_utc").alias("updated_utc"))


def delete_vectors(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    return vectors.join(keys.select(*TEMPLATE_KEY), TEMPLATE_KEY, "left_anti")


def semantic_search(vectors: DataFrame, templates: DataFrame, logs: DataFrame, queries: DataFrame, k: int,
                    tenant: str | None = None, service: str | None = None, start=None, end=None, samples: int = 3) -> DataFrame:
    """query_id, rank, score, template key and text, count in the window, sample ids. Tenant and
    service are filtered before the search, so k rows come back when k exist."""
    v = vectors
    if tenant is not None:
        v = v.filter(F.col("tenant_id") == tenant)
    if service is not None:
        v = v.filter(F.col("service_name") == service)
    v = v.join(templates.select(*TEMPLATE_KEY), TEMPLATE_KEY, "left_semi")
    keyed = v.withColumn("vec_id", F.xxhash64(*TEMPLATE_KEY))
    hits = vector_topk(keyed, queries, k).join(keyed.select("vec_id", *TEMPLATE_KEY), "vec_id").drop("vec_id")
    keys = hits.select(*TEMPLATE_KEY).distinct()
    counts = template_count(logs, keys, start=start, end=end)
    latest = sample_logs(logs, keys, samples, start=start, end=end).groupBy(*TEMPLATE_KEY).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rn", "id"))), lambda s: s["id"]).alias("sample_ids"))
    return (hits.join(templates.select(*TEMPLATE_KEY, "template_text"), TEMPLATE_KEY)
            .join(counts, TEMPLATE_KEY, "left").join(latest, TEMPLATE_KEY, "left"))


def evidence(logs: DataFrame, templates: DataFrame, vectors: DataFrame, questions: DataFrame, top: int = 5,
             matches: int = 3, sample_rows: int = 5, **filters) -> DataFrame:
    """question_id, kind (top, semantic, sample), place, template_hash, log_id, relevance per
    question (question_id, vector): the most frequent templates, semantic matches not among
    them, and up to 2 latest rows of the first 3 templates, at most `sample_rows`."""
    from logloom.operators.logs import filter_logs
    counts = (filter_logs(logs, **filters).groupBy(*TEMPLATE_KEY).agg(F.count(F.lit(1)).alias("n"))
              .join(templates.select(*TEMPLATE_KEY), TEMPLATE_KEY, "left_semi")
              .orderBy(F.col("n").desc(), *TEMPLATE_KEY).limit(top))
    best = counts.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), *TEMPLATE_KEY, "n"))).alias("b"))
    best = best.select(F.posexplode_outer("b").alias("place", "b")).filter("b IS NOT NULL").select(
        (F.col("place") + 1).alias("place"), "b.tenant_id", "b.service_name", "b.template_hash", "b.n")
    asked = questions.select("question_id").withColumn("_k", F.lit(1))

    def each(rows):  # a handful of rows for every question
        return asked.join(F.broadcast(rows.withColumn("_k", F.lit(1))), "_k").drop("_k")

    tops = each(best).select("question_id", F.lit("top").alias("kind"), "place", "template_hash",
                             F.lit(None).cast("bigint").alias("log_id"), F.col("n").cast("double").alias("relevance"))
    found = semantic_search(vectors, templates, logs, questions.withColumnRenamed("question_id", "query_id"), matches,
                            filters.get("tenant"), filters.get("service"), filters.get("start"), filters.get("end"))
    similar = found.join(best.select("template_hash"), "template_hash", "left_anti").select(
        F.col("query_id").alias("question_id"), F.lit("semantic").alias("kind"), F.col("rank").alias("place"), "template_hash",
        F.lit(None).cast("bigint").alias("log_id"), F.col("score").alias("relevance"))
    lead = best.filter(F.col("place") <= 3)
    rows = top_n(filter_logs(logs, **filters).join(lead.select(*TEMPLATE_KEY, F.col("place").alias("_tp")), TEMPLATE_KEY),
                 TEMPLATE_KEY, newest(), 2).select("_tp", "rn", "id", "template_hash")
    rows = rows.orderBy("_tp", "rn").limit(sample_rows)
    samples = each(rows).select("question_id", F.lit("sample").alias("kind"), (F.col("_tp") * 2 + F.col("rn") - 2).cast("int").alias("place"),
                                "template_hash", F.col("id").alias("log_id"), F.lit(0.0).alias("relevance"))
    return tops.unionByName(similar).unionByName(samples)
