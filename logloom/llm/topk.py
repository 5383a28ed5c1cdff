"""Exact top-k inner products by a bit-sliced index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bit slices of an attribute that take part in the bitmap sum; the rest only widens the boundary.
SLICES = 6
#: Rows of a bitmap.
BLOCK_ROWS = 8192
#: Queries that one pass over the vectors answers.
QUERY_CHUNK = 1024


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as long; null for a vector that is null or holds a null or
    non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return F.when(vector.isNotNull() & good, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


class SlicedBlock:
    """Rows of a block as bitmaps: one per attribute and kept bit, most rows' worth of work per
    operation. A bitmap is an integer whose bit r stands for row r."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, self.full = ids, rows, (1 << len(ids)) - 1
        self.low = rows.min(axis=0)
        above = rows - self.low
        self.shift = max(0, int(above.max()).bit_length() - SLICES)
        self.slices = [[self._bitmap((above[:, d] >> (self.shift + k)) & 1) for k in range(SLICES)] for d in range(rows.shape[1])]

    @staticmethod
    def _bitmap(bits: np.ndarray) -> int:
        return int.from_bytes(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes(), "little")

    def _members(self, bitmap: int) -> np.ndarray:
        raw = np.frombuffer(bitmap.to_bytes((len(self.ids) + 7) // 8, "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(raw, bitorder="little", count=len(self.ids)))

    def weighted_sum(self, query: list[int]) -> list[int]:
        """Slices, least significant first, of sum |q| * attribute over the kept bits; the attributes of
        negative weights are complemented. Three bitmaps of one place become one there and one above."""
        places: list[list[int]] = [[]]
        for q, own in zip(query, self.slices):
            w, flip = abs(q), self.full if q < 0 else 0
            own = [s ^ flip for s in own]
            at = 0
            while w:
                if w & 1:
                    while len(places) < at + SLICES:
                        places.append([])
                    for k, s in enumerate(own):
                        places[at + k].append(s)
                w >>= 1
                at += 1
        out, p = [], 0
        while p < len(places):
            held = places[p]
            while len(held) > 1:
                a, b = held.pop(), held.pop()
                c = held.pop() if held else 0
                x = a ^ b
                held.append(x ^ c)
                carry = (a & b) | (c & x)
                if carry:
                    if p + 1 == len(places):
                        places.append([])
                    places[p + 1].append(carry)
            out.append(held[0] if held else 0)
            p += 1
        return out

    def boundary(self, sums: list[int], k: int, allowed: int, slack: int) -> int:
        """Rows among `allowed` whose sum is at most `slack` below the k-th largest. The k-th largest is
        read off from the most significant slice downward, then compared with in the same order."""
        more, equal, value = 0, allowed, 0
        for p in range(len(sums) - 1, -1, -1):
            both = more | (equal & sums[p])
            if both.bit_count() >= k:
                equal &= sums[p]
                value |= 1 << p
            else:
                more, equal = both, equal & ~sums[p]
        least = max(0, value - slack)
        more, equal = 0, allowed
        for p in range(len(sums) - 1, -1, -1):
            if least >> p & 1:
                equal &= sums[p]
            else:
                more |= equal & sums[p]
                equal &= ~sums[p]
        return more | equal

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows other than the query's own; fewer if there are fewer. What the
        bits left out can add is the slack; rows inside it are scored exactly."""
        allowed = self.full
        for r in np.flatnonzero(self.ids == query_id):
            allowed &= ~(1 << int(r))
        if not allowed:
            return self.ids[:0], np.zeros(0, np.int64)
        if allowed.bit_count() > k:
            slack = int(np.abs(query).sum()) * ((1 << self.shift) - 1)
            allowed = self.boundary(self.weighted_sum(query.tolist()), k, allowed, -(-slack >> self.shift))
        at = self._members(allowed)
        scores = self.rows[at] @ query
        order = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at][order], scores[order]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a task in blocks of about BLOCK_ROWS, so that a bitmap operation has enough of them."""
    held: list[pd.DataFrame] = []
    for batch in chain(batches, [None]):
        if batch is not None and len(batch):
            held.append(batch)
        if held and (batch is None or sum(map(len, held)) >= BLOCK_ROWS):
            rows = pd.concat(held)
            yield rows["id"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(np.int64)
            held = []


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that meets `is_query` the k rows of highest
    integer inner product other than itself, ties to the smaller id; all rows, if there are fewer.

    Rows whose vector is null, or holds null or non-finite components, and rows with a null id take no
    part; vectors of another length than most (of equally many: the longest) neither. If a query id
    repeats, its smallest vector asks; rows that share the query's id are not answers. Repeated rows
    of other ids are answers each. An empty table gives no rows.

    Queries are read in chunks of QUERY_CHUNK, each of which scans the vectors once: tasks index their
    rows block by block and hand on k rows per query."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("q"))
    rows = rows.filter("id is not null and v is not null")
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dims = width["n"] if width else 0
    rows = rows.filter(F.size("v") == dims)
    asked = rows.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    chunks = max(1, math.ceil(asked.count() / QUERY_CHUNK))
    schema = "query_id long, vec_id long, score long"
    found = None
    for c in range(chunks):
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c).collect()  # about QUERY_CHUNK rows
        shared = vectors.sparkSession.sparkContext.broadcast(
            (np.array([r["id"] for r in own], np.int64), np.array([r["v"] for r in own], np.int64).reshape(len(own), dims)))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, queries = shared.value
            best: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
            for at, v in _blocks(batches) if dims else ():
                block = SlicedBlock(at, v)
                for i, (q, x) in enumerate(zip(ids.tolist(), queries)):
                    at, scores = (np.concatenate(p) for p in zip(best[i], block.top(q, x, k)))
                    order = np.lexsort((at, -scores))[:k]
                    best[i] = at[order], scores[order]
            for q, (at, scores) in zip(ids.tolist(), best):
                yield pd.DataFrame({"query_id": np.full(len(at), q), "vec_id": at, "score": scores})

        part = rows.select("id", "v").mapInPandas(search, schema)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
