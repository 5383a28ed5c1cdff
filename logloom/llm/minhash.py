"""Near-duplicate documents: DartMinHash signatures, banded joining, exact check."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import graph
from logloom.llm.common import drop_rows, with_row_id, words_of, worker_store
from logloom.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 25
BAND_ROWS = 5
COORDINATES = BANDS * BAND_ROWS
#: Estimated similarity below which a pair is not checked: over five standard deviations under 0.8.
ESTIMATE = 0.6
KEPT_WORDS = 400_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3 | 1 << 63)


class WordHashes(dict):
    """64-bit hash of each word; the store is emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and how often each occurs. A text with fewer words than a
    shingle is one shingle; one without words is its stripped self; a blank or null text has none."""
    words = words_of(text)
    if not words:
        rest = (text or "").strip()
        one = [xxhash.xxh64_intdigest(rest, 7)] if rest else []
        return np.array(one, np.uint64), np.ones(len(one), np.int64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - size + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(size, len(w))):
        h = h * _PRIME + w[i:i + n]
    return np.unique(mixed(h), return_counts=True)


def darts(elements: np.ndarray, weights: np.ndarray, horizon: float) -> tuple[np.ndarray, np.ndarray]:
    """(rank, hash) of all darts that hit the regions [0, weight) x [0, horizon) of the elements.

    Darts of an element fall as a Poisson process of rate one per unit of area, drawn from hashes of
    the element alone: any two sets that share it share its darts. Weights are cut into layers
    [0, 1), [1, 2), [2, 4), [4, 8), ...; a dart of the topmost layer counts if it lies below the weight."""
    ranks, marks = [], []
    low, width, layer = 0.0, 1.0, 0
    while True:
        inside = weights > low
        if not inside.any():
            break
        e, w = elements[inside], weights[inside]
        seed = mixed(e ^ np.uint64((layer + 1) * int(_GOLD) % 2 ** 64))
        first = -np.log(((seed >> np.uint64(11)).astype(float) + 1) / 2.0 ** 53) / width
        hit = first < horizon
        e, w, seed = e[hit], w[hit], seed[hit]
        mean = horizon * width
        cols = int(mean + 6 * math.sqrt(mean) + 6)
        while len(e):
            x = mixed(seed[:, None] + np.arange(cols, dtype=np.uint64) * _GOLD)
            x[:, 0] = seed
            at = np.cumsum(-np.log(((x >> np.uint64(11)).astype(float) + 1) / 2.0 ** 53) / width, axis=1)
            if (at[:, -1] >= horizon).all():
                x = mixed(x ^ _GOLD)
                height = low + width * ((mixed(x ^ np.uint64(layer + 77)) >> np.uint64(11)).astype(float) / 2.0 ** 53)
                keep = (at < horizon) & (height < w[:, None])
                ranks.append(at[keep])
                marks.append(x[keep])
                break
            cols *= 2
        low, width, layer = (1.0, 1.0, 1) if layer == 0 else (low * 2, width * 2, layer + 1)
    if not ranks:
        return np.zeros(0), np.zeros(0, np.uint64)
    return np.concatenate(ranks), np.concatenate(marks)


def signature(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each of k coordinates. Two signatures agree in a coordinate with the
    probability of the weighted Jaccard similarity. The horizon grows until no coordinate is empty."""
    total = float(weights.sum())
    wanted = k * (math.log(k) + 3)
    while True:
        rank, mark = darts(elements, weights, wanted / total)
        order = np.argsort(-rank, kind="stable")
        at = (mark[order] >> np.uint64(32)).astype(np.int64) % k
        out = np.zeros(k, np.uint64)
        full = np.zeros(k, bool)
        out[at], full[at] = mark[order], True  # the last one written is the earliest
        if full.all():
            return out
        wanted *= 2


def agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of equal coordinates of all pairs."""
    return np.stack([(right == row).mean(axis=1) for row in left])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weighted: bool) -> float:
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not weighted:
        return len(common) / max(1, len(a[0]) + len(b[0]) - len(common))
    least = np.minimum(a[1][i], b[1][j]).sum()
    return least / max(1, a[1].sum() + b[1].sum() - least)


def signed(docs: DataFrame, id_col: str, text_col: str, size: int, weighted: bool) -> DataFrame:
    """One row per document: place, id, key (128-bit hash of its shingles and weights), signature."""
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = worker_store("words", WordHashes)
        for batch in batches:
            keys, sigs = [], []
            for text in batch["text"]:
                e, n = shingles(text, hashes, size)
                w = n.astype(float) if weighted else np.ones(len(e))
                keys.append(blake2b(e.tobytes() + (n.tobytes() if weighted else b""), digest_size=16).digest() if len(e) else None)
                sigs.append(signature(e, w).astype(np.uint32).tobytes() if len(e) else None)  # the low half
            yield pd.DataFrame({"_f": batch["_f"], "_r": batch["_r"], "id": batch["id"], "set": keys, "sig": sigs})

    rows = with_row_id(docs.select(F.col(id_col), F.col(text_col))).select(
        "_f", "_r", F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(sign, "_f long, _r long, id string, set binary, sig binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY,
                    size: int = SHINGLE, weighted: bool = False) -> DataFrame:
    """One row per document: its place (_f, _r), id, class_id (the smallest id in its class), class_size
    and kept (true for exactly one row of each class).

    A class joins documents through links of (weighted) Jaccard similarity `threshold` or more over
    word shingles. Equal texts and repeated rows share a class. Blank and null texts are alike to
    nothing: each is a class of its own. Rows whose id is null come last when one is kept. Texts of
    any length are read whole. An empty table gives no rows.

    Copies collapse to one node before the join; bands of the signature propose links inside buckets
    (see graph.candidate_links: no bucket emits all its pairs), and every link is checked on the
    shingles themselves."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = materialize(signed(docs, id_col, text_col, size, weighted), "signed")
    nodes = materialize(
        rows.filter("set is not null").groupBy("set").agg(
            F.min(F.struct("_f", "_r")).alias("at"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))
        .select("set", "at", "sig", "copies", F.monotonically_increasing_id().alias("node")), "nodes")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            s = np.stack([np.frombuffer(x, np.uint32) for x in batch["sig"]]).astype(np.uint64).reshape(len(batch), BANDS, BAND_ROWS)
            h = np.zeros((len(batch), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64) * _GOLD
            for i in range(BAND_ROWS):
                h = mixed(h * _PRIME + s[:, :, i])
            yield pd.DataFrame({"key": h.astype(np.int64).ravel(), "node": np.repeat(batch["node"].to_numpy(), BANDS)})

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "sig": [
                np.frombuffer(x, np.uint32).astype(np.uint16).tobytes() for x in batch["sig"]]})

    entries = nodes.select("node", "sig").mapInPandas(cut, "key long, node long")
    payload = nodes.select("node", "sig").mapInPandas(short, "node long, sig binary")
    texts = with_row_id(docs.select(text_col)).select("_f", "_r", F.col(text_col).cast("string").alias("text"))
    ends: dict[str, DataFrame] = {}

    def verify(links: DataFrame) -> DataFrame:
        wanted = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        at = nodes.select("node", "at._f", "at._r").join(wanted, "node")
        ends["t"] = materialize(texts.join(at, ["_f", "_r"]).select("node", "text"), "ends")
        both = (links.join(ends["t"].select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
                .join(ends["t"].select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"))

        def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashes = worker_store("words", WordHashes)
            for batch in batches:
                ok = [similarity(shingles(x, hashes, size), shingles(y, hashes, size), weighted) >= threshold
                      for x, y in zip(batch["ta"], batch["tb"])]
                yield batch.loc[np.array(ok, bool), ["a", "b"]]

        return both.mapInPandas(check, "a long, b long")

    def whole(wanted: DataFrame) -> DataFrame:
        def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashes = worker_store("words", WordHashes)
            for batch in batches:
                out = []
                for text in batch["text"]:
                    e, n = shingles(text, hashes, size)
                    out.append(e.tobytes() + n.astype(np.int64).tobytes())
                yield pd.DataFrame({"node": batch["node"], "full": out})

        at = nodes.select("node", "at._f", "at._r").join(wanted, "node")
        return texts.join(at, ["_f", "_r"]).select("node", "text").mapInPandas(sets, "node long, full binary")

    def same(a: bytes, b: bytes) -> bool:
        both = [(np.frombuffer(x, np.uint64, len(x) // 16), np.frombuffer(x, np.int64, offset=len(x) // 2)) for x in (a, b)]
        return similarity(both[0], both[1], weighted) >= threshold

    roots, _ = graph.grouped_links(entries, payload, agreement, ESTIMATE, verify, "minhash", whole=whole, same=same)
    labels = nodes.select("set", "node").join(roots, "node", "left").select(
        "set", F.coalesce("root", "node").alias("root"))
    member = rows.select("_f", "_r", F.col("id").cast(kind).alias("id"), "set").join(
        materialize(labels, "labels"), "set", "left")
    rank = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("_f"), F.col("_r"))
    member = materialize(member, "members")
    best = member.filter("root is not null").groupBy("root").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("class_size"))
    out = member.join(materialize(best, "best"), "root", "left")
    return out.select(
        "_f", "_r", "id", F.coalesce(F.col("best.id"), F.col("id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce((F.col("best._f") == F.col("_f")) & (F.col("best._r") == F.col("_r")), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without all but one of each class, with all their columns."""
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = materialize(found.filter(~F.col("kept")).select(F.col("_f").alias("_gone_f"), F.col("_r").alias("_gone_r")), "gone")
    return drop_rows(docs, gone)
