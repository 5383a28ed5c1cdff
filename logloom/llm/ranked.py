"""Ranked lexical search of every item over all documents by a dual-tree search.

One tree stands over the items, one over each batch of documents. A node holds, for every term, the largest
value below it: of an item node the largest weight times repeats, of a document node the largest share a
document can add. Their product bounds every score of the pair, so a pair of nodes goes when its bound is below
the weakest k-th score among the items under it; other pairs are split further, down to exact scores. All
figures are whole numbers; they are summed in doubles while every sum stays below 2^53, else in 64-bit
integers, so bounds and scores are exact.

Null texts have no terms and take no part. Repeated documents and items count as often as they stand there;
a null doc_id is placed after all others of its score. Texts of any length are read in slices."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import worker_store
from logloom.scale import top_n
from logloom.session import materialize

K = 20
#: Items that are searched together hold at most this many items and terms; more items go in further rounds.
BLOCK_ITEMS, BLOCK_TERMS = 2_000, 40_000
#: Documents under one document tree, under one leaf, children of an item node.
BATCH, LEAF, BRANCH = 4_096, 32, 8
#: Postings of a batch, so that few but very long documents do not gather either.
BATCH_POSTINGS = 2_000_000
#: One in so many documents is searched first; its k-th scores are where the search over all starts.
SEED = 64
SLICE = 1 << 20
#: Letters, digits and everything outside ASCII belong to terms; capital letters of ASCII become small.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a slice at a time."""
    at = 0
    while at < len(text):
        part = text[at:at + SLICE].translate(_FOLD)
        if at + SLICE < len(text) and part[-1] != 32:
            cut = part.rfind(b" ")
            if cut < 0:  # one term reaches over the whole slice
                end = at + SLICE
                while end < len(text) and text[end:end + 1].translate(_FOLD) != b" ":
                    end += 1
                part = text[at:end].translate(_FOLD)
            else:
                part = part[:cut + 1]
        at += len(part)
        yield part.split()


def counted(text: bytes | None) -> Counter:
    found = Counter()
    for part in term_slices(text or b""):
        found.update(part)
    return found


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms, counts): the terms of each item row with their repeats."""
    def split(batches):
        for batch in batches:
            found = [counted(t) for t in _texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([
                batch.column("item_id"), pa.array([[t.decode("utf-8", "replace") for t in c] for c in found], pa.list_(pa.string())),
                pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["item_id", "terms", "counts"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        split, "item_id long, terms array<string>, counts array<long>")


def blocks_of(found: DataFrame) -> Iterator[list[tuple]]:
    """Item rows in bounded blocks; the driver holds one block."""
    block, terms = [], set()
    for row in found.filter(F.size("terms") > 0).toLocalIterator():
        new = set(row["terms"])
        if block and (len(block) >= BLOCK_ITEMS or len(terms | new) > BLOCK_TERMS):
            yield block
            block, terms = [], set()
        block.append((row["item_id"], row["terms"], row["counts"]))
        terms |= new
    if block:
        yield block


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, ids, tfs, seed) of every document with at least one term: its number of terms and, of
    those that the block's items use, the repeats."""
    name = f"terms-{uuid.uuid4().hex}"

    def read(batches):
        known = worker_store(name, lambda: {t.encode(): i for i, t in enumerate(vocabulary.value)})
        for batch in batches:
            keep, sizes, ids, tfs, ends = [], [], [], [], [0]
            for row, text in enumerate(_texts(batch.column("text"))):
                n, here = 0, Counter()
                for part in term_slices(text or b""):
                    n += len(part)
                    here.update(map(known.get, part))
                if not n:
                    continue
                here.pop(None, None)
                keep.append(row)
                sizes.append(n)
                ids.extend(here.keys())
                tfs.extend(here.values())
                ends.append(len(ids))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))],
                names=["doc_id", "n", "ids", "tfs"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        read, "doc_id long, n long, ids array<int>, tfs array<long>")
    return found.withColumn("seed", F.pmod(F.xxhash64("doc_id", "n", "ids"), F.lit(SEED)) == 0)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class ItemTree:
    """Items of one block with the coordinate maxima of their groups, as sparse vectors over term numbers."""

    def __init__(self, vectors: list[dict[int, int]], common: np.ndarray):
        # neighbours share their most common terms, which mostly tell their language
        self.order = sorted(range(len(vectors)), key=lambda i: sorted(vectors[i], key=lambda t: (-common[t], t))[:4])
        level = [(dict(vectors[i]), [place]) for place, i in enumerate(self.order)]
        self.levels = [[(*self._arrays(v), m) for v, m in level]]
        while len(level) > 1:
            merged = []
            for at in range(0, len(level), BRANCH):
                most: dict[int, int] = {}
                for v, _ in level[at:at + BRANCH]:
                    for t, x in v.items():
                        most[t] = max(x, most.get(t, 0))
                merged.append((most, [p for _, m in level[at:at + BRANCH] for p in m]))
            level = merged
            self.levels.append([(*self._arrays(v), m) for v, m in level])
        self.levels.reverse()
        # the largest sum that can occur decides on the number type
        top = max((sum(v.values()) for v in vectors), default=0) * 1_000_000
        root = sum(level[0][0].values()) * 1_000_000 if level else 0
        self.kind = np.float64 if max(top, root) < 1 << 53 else np.int64

    @staticmethod
    def _arrays(v: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.fromiter(v.keys(), np.int64, len(v))
        return terms, np.fromiter(v.values(), np.int64, len(v))


class Best:
    """The k best (score, document) of each item; equal scores by ascending document."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.scores = [np.empty(0, np.int64)] * n
        self.docs = [np.empty(0, np.int64)] * n
        self.none = [np.empty(0, bool)] * n

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray, none: np.ndarray) -> None:
        good = scores >= max(self.floor[item], 1)
        if not good.any():
            return
        s, d, o = (np.concatenate(x) for x in ((self.scores[item], scores[good]), (self.docs[item], docs[good]), (self.none[item], none[good])))
        first = np.lexsort((d, o, -s))[:self.k]
        self.scores[item], self.docs[item], self.none[item] = s[first], d[first], o[first]
        if len(first) == self.k:
            self.floor[item] = max(self.floor[item], s[first[-1]])


def dual_search(tree: ItemTree, n: np.ndarray, offsets: np.ndarray, ids: np.ndarray, tfs: np.ndarray, docs: np.ndarray, none: np.ndarray,
                n_docs: int, n_terms: int, width: int, best: Best) -> int:
    """Searches one batch of documents for all items of the tree; returns how many exact scores were taken."""
    rows = np.repeat(np.arange(len(n)), np.diff(offsets))
    m = 75 + _product_div(n, 25 * n_docs, n_terms)
    share = _product_div(tfs, 1_000_000_000, 1000 * tfs + 12 * m[rows])
    # documents of one leaf look alike: by the term that adds most, then by length
    strongest = np.full(len(n), -1, np.int64)
    by_share = np.lexsort((share, rows))
    strongest[rows[by_share]] = ids[by_share]
    place = np.empty(len(n), np.int64)
    place[np.lexsort((n, strongest))] = np.arange(len(n))
    used, column = np.unique(ids, return_inverse=True)
    where = np.full(width, len(used), np.int64)  # the last column is empty: terms that no document here has
    where[used] = np.arange(len(used))
    leaves = -(-len(n) // LEAF)
    in_order = np.argsort(place)

    low = np.zeros((leaves, len(used) + 1), tree.kind)
    np.maximum.at(low, (place[rows] // LEAF, column), share.astype(tree.kind))
    levels = [low]
    while len(levels[0]) > 1:
        below = levels[0]
        starts = np.arange(0, len(below), BRANCH)
        levels.insert(0, np.maximum.reduceat(below, starts, axis=0))
    # postings by leaf, for the exact scores
    order = np.argsort(place[rows], kind="stable")
    leaf_of, row_of, col_of, share_of = place[rows][order] // LEAF, place[rows][order] % LEAF, column[order], share[order].astype(tree.kind)
    bounds = np.searchsorted(leaf_of, np.arange(leaves + 1))
    dense: dict[int, np.ndarray] = {}

    def leaf(at: int) -> np.ndarray:
        if at not in dense:
            if len(dense) > 64:
                dense.clear()
            block = np.zeros((LEAF, len(used) + 1), tree.kind)
            part = slice(bounds[at], bounds[at + 1])
            block[row_of[part], col_of[part]] = share_of[part]
            dense[at] = block
        return dense[at]

    scored = 0

    def visit(item_level: int, item: int, doc_level: int, nodes: np.ndarray) -> None:
        nonlocal scored
        terms, values, members = tree.levels[item_level][item]
        cols = where[terms]
        here = cols < len(used)
        cols, values = cols[here], values[here].astype(tree.kind)
        if not len(cols):
            return
        bound = levels[doc_level][np.ix_(nodes, cols)] @ values
        weakest = max(1, min(best.floor[p] for p in members))
        alive = nodes[bound >= weakest]
        if not len(alive):
            return
        # the most promising first: it raises the k-th scores for the others
        alive = alive[np.argsort(-bound[bound >= weakest], kind="stable")]
        last_items, last_docs = item_level == len(tree.levels) - 1, doc_level == len(levels) - 1
        if last_items and last_docs:
            own = members[0]
            for at in alive.tolist():
                block = leaf(at)
                scores = (block[:, cols] @ values).astype(np.int64)
                d = in_order[at * LEAF:(at + 1) * LEAF]
                scored += len(d)
                best.add(own, scores[:len(d)], docs[d], none[d])
            return
        if not last_docs:
            alive = (alive[:, None] * BRANCH + np.arange(BRANCH)).ravel()
            alive = alive[alive < len(levels[doc_level + 1])]
            doc_level += 1
        if last_items:
            visit(item_level, item, doc_level, alive)
        else:
            for child in range(item * BRANCH, min((item + 1) * BRANCH, len(tree.levels[item_level + 1]))):
                visit(item_level + 1, child, doc_level, alive)

    visit(0, 0, 0, np.arange(len(levels[0])))
    return scored


def _product_div(a: np.ndarray, b: int, by) -> np.ndarray:
    """(a * b) div by, in Python's whole numbers where 64 bits would not hold the product."""
    if len(a) and int(a.max()) * b >= 1 << 63:
        low = by.tolist() if isinstance(by, np.ndarray) else [by] * len(a)
        return np.array([x * b // y for x, y in zip(a.tolist(), low)], np.int64)
    return a * b // by


def _search(found: DataFrame, model, k: int) -> DataFrame:
    """(item, doc_id, score): of each task, the k best documents of each item."""
    name = f"items-{uuid.uuid4().hex}"

    def run(batches):
        def build():
            made = model.value
            return ItemTree(made["vectors"], np.array(made["df"])), made

        tree, made = worker_store(name, build)
        back = np.argsort(np.array(tree.order)) if tree.order else np.empty(0, int)
        best = Best(len(tree.order), k, np.array(made["floor"], np.int64)[tree.order])
        held: list[tuple] = []

        def flush():
            if held:
                n, sizes, ids, tfs, docs, none = (np.concatenate(x) for x in zip(*held))
                dual_search(tree, n, np.concatenate([[0], np.cumsum(sizes)]), ids, tfs, docs, none, made["N"], made["L"], len(made["df"]), best)
                held.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                ids, tfs, doc = part.column("ids"), part.column("tfs"), part.column("doc_id")
                sizes = np.diff(ids.offsets.to_numpy())
                held.append((part.column("n").to_numpy(), sizes, ids.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy(),
                             doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False)))
                if sum(len(x[0]) for x in held) >= BATCH or sum(len(x[2]) for x in held) >= BATCH_POSTINGS:
                    flush()
        flush()
        for item in range(len(back)):
            p = int(back[item])
            if len(best.scores[p]):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(best.scores[p]), item), pa.int32()), pa.array(best.docs[p], pa.int64(), mask=best.none[p]),
                    pa.array(best.scores[p], pa.int64())], names=["item", "doc_id", "score"])

    found = found.filter(F.size("ids") > 0).select("doc_id", "n", "ids", "tfs")
    return found.mapInArrow(run, "item int, doc_id long, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    return top_n(rows, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, "rank")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item row, scores above 0 only."""
    spark = docs.sparkSession
    out = None
    for block in blocks_of(item_terms(items)):
        terms = sorted({t for _, ts, _ in block for t in ts})
        vocabulary = spark.sparkContext.broadcast(terms)
        found = materialize(postings(docs, vocabulary), "postings")
        n_docs, n_terms = found.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = [0] * len(terms)
        for row in found.select(F.explode("ids").alias("t")).groupBy("t").count().toLocalIterator():
            df[row["t"]] = row["count"]
        number = {t: i for i, t in enumerate(terms)}
        vectors = [{number[t]: c * w for t, c in zip(ts, cs) if (w := weight(n_docs, df[number[t]])) > 0 and df[number[t]]}
                   for _, ts, cs in block]
        floor = [0] * len(block)
        made = {"vectors": vectors, "df": df, "N": n_docs, "L": n_terms or 0, "floor": floor}
        first = spark.sparkContext.broadcast(made)
        # the k-th score over a part of the documents is a lower bound of the one over all
        for row in _best(_search(found.filter("seed"), first, k), k).filter(F.col("rank") == k).collect():
            floor[row["item"]] = row["score"]
        model = spark.sparkContext.broadcast({**made, "floor": floor})
        names = spark.createDataFrame([(i, item) for i, (item, _, _) in enumerate(block)], "item int, item_id long")
        ranked = _best(_search(found, model, k), k).join(F.broadcast(names), "item")
        ranked = materialize(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
        for b in (vocabulary, first, model):
            b.unpersist()
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
