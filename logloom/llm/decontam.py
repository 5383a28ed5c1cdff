"""Benchmark decontamination: block-max WAND over a BM25 index of test items, then overlap checks."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import words_of, with_row_id
from logloom.session import materialize

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach to be looked at.
RETRIEVE = 0.5
#: Share of the word n-grams of the question and of the answer that the passage must hold.
QUESTION, ANSWER = 0.6, 0.6
GRAM = 5
#: Consecutive items, ordered by length, that share one bound per term.
BLOCK = 8
#: Items and words of one pass over the documents at most (about); more items take more passes.
PASS_ITEMS, PASS_WORDS = 1024, 200_000
#: Words of a document that are scored together; longer ones go on with an overlap.
SLICE = 20_000
_SENTENCE = re.compile(r"[^.!?\n]+")


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The answer is the last sentence of an item (its last three words, if that is shorter), the
    question what comes before; an item of one sentence is both."""
    parts = [w for w in map(words_of, _SENTENCE.findall(text or "")) if w]
    words = [w for p in parts for w in p]
    if len(parts) < 2 or len(words) < 6:
        return words, words
    cut = len(words) - max(3, len(parts[-1]))
    return words[:cut], words[cut:]


def grams(words: list[str], size: int) -> set[tuple[str, ...]]:
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the distinct n-grams of `part` (n is GRAM, or its length if shorter) in the passage."""
    n = min(GRAM, len(part))
    own = grams(part, n)
    return len(own & grams(passage, n)) / len(own) if own else 0.0


def impacts(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words, impacts): BM25 weight of each distinct word of an item, divided by the sum over
    the item, so that a passage with all its words scores one. Counted over all items."""
    base = items.filter(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("no"))
    base = materialize(base, "items")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"no": batch["no"], "word": [words_of(t) for t in batch["text"]]})

    bag = base.select("no", "text").mapInPandas(split, "no long, word array<string>")
    sized = bag.select("no", F.size("word").alias("len"), F.explode("word").alias("word"))
    tf = sized.groupBy("no", "len", "word").agg(F.count(F.lit(1)).alias("tf"))
    total = bag.filter(F.size("word") > 0).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("word")).alias("mean")).first()
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n, mean = total["n"], total["mean"] or 1.0
    weight = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (
        F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    by_item = tf.join(df, "word").withColumn("w", weight).groupBy("no").agg(
        F.sum("w").alias("own"), F.collect_list(F.struct("word", "w")).alias("ws"))
    return base.join(by_item, "no").select("no", "item_id", "text", F.col("ws.word").alias("words"),
                                           F.transform("ws.w", lambda w: w / F.col("own")).alias("impacts"))


@dataclass
class Index:
    """Postings of one pass. Items are numbered by length; `bound[t, b]` is the largest impact of
    term t on an item of block b."""

    ids: list
    questions: list[list[str]]
    answers: list[list[str]]
    lengths: list[int]
    terms: dict[str, int]
    postings: list[tuple[list[int], list[float]]]
    bound: np.ndarray


def build_index(rows: list) -> Index:
    rows = sorted(rows, key=lambda r: (len(words_of(r["text"])), r["no"]))
    terms: dict[str, int] = {}
    lists: list[list[tuple[int, float]]] = []
    for i, r in enumerate(rows):
        for w, x in zip(r["words"], r["impacts"]):
            if w not in terms:
                terms[w] = len(terms)
                lists.append([])
            lists[terms[w]].append((i, x))
    bound = np.zeros((len(terms), -(-len(rows) // BLOCK)), np.float32)
    postings = []
    for t, own in enumerate(lists):
        at, x = [p[0] for p in own], [p[1] for p in own]
        np.maximum.at(bound[t], np.array(at) // BLOCK, np.array(x) * (1 + 1e-6))
        postings.append((at, x))
    both = [question_and_answer(r["text"]) for r in rows]
    return Index([r["item_id"] for r in rows], [q for q, _ in both], [a for _, a in both],
                 [len(words_of(r["text"])) for r in rows], terms, postings, bound)


def block_max_wand(index: Index, terms: list[int], least: float, first: int, last: int) -> list[tuple[int, float]]:
    """All items numbered first to last - 1 whose summed impacts over `terms` reach `least`.

    Cursors are kept in the order of their items. The pivot is the first item that the largest
    impacts of the cursors up to it could lift to `least`. If the block bounds at the pivot cannot,
    the cursors leap past the blocks; otherwise they move up to the pivot, which is then scored."""
    least -= 1e-9
    cursors = []
    b0, b1 = first // BLOCK, -(-last // BLOCK)
    for t in terms:
        at, x = index.postings[t]
        k, end = bisect_left(at, first), bisect_left(at, last)
        if k < end:
            bounds = index.bound[t, b0:b1].tolist()
            cursors.append([at[k], k, end, at, x, max(bounds), bounds])

    def leap(cursor: list, item: int) -> None:
        cursor[1] = bisect_left(cursor[3], item, cursor[1], cursor[2])
        cursor[0] = cursor[3][cursor[1]] if cursor[1] < cursor[2] else last

    found = []
    while True:
        cursors = sorted((c for c in cursors if c[0] < last), key=lambda c: c[0])
        total, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            total += c[5]
            if total >= least:
                pivot = k
                break
        if pivot < 0:
            return found
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        upto = cursors[:pivot + 1]
        if sum(c[6][item // BLOCK - b0] for c in upto) < least:
            goal = (item // BLOCK + 1) * BLOCK
            if pivot + 1 < len(cursors):
                goal = min(goal, cursors[pivot + 1][0])
            for c in upto:
                leap(c, goal)
        elif cursors[0][0] == item:
            score = sum(c[4][c[1]] for c in upto)
            if score >= least:
                found.append((item, score))
            for c in upto:
                leap(c, item + 1)
        else:
            for c in upto:
                if c[0] < item:
                    leap(c, item)


def contaminated_items(words: list[str], index: Index, classes: list[tuple[int, int, int]], retrieve: float) -> dict[int, tuple]:
    """Per item found in a document: best (question overlap, answer overlap, score, first word).

    `classes` are (length limit, first block, end block): passages are windows of twice the limit
    that start at every multiple of it, so that each holds any item of the class whole. The
    bounds of all passages and blocks come first, from running sums; only passages that may reach
    the threshold are searched."""
    known = np.fromiter(map(index.terms.get, words, repeat(-1)), np.int64, len(words))
    at = np.flatnonzero(known >= 0)
    best: dict[int, tuple] = {}
    if not len(at):
        return best
    terms = known[at]
    order = np.argsort(terms, kind="stable")
    before = np.full(len(at), -1)  # where the same term stood last
    same = terms[order][1:] == terms[order][:-1]
    before[order[1:][same]] = at[order[:-1][same]]
    for limit, b0, b1 in classes:
        begin = np.arange(0, max(1, len(words) - limit), limit)
        part = at // limit
        for s in range(0, len(begin), max(1, SLICE // limit)):
            own = begin[s:s + max(1, SLICE // limit)] // limit
            lo, hi = np.searchsorted(part, (own[0], own[-1] + 2))
            rows = index.bound[terms[lo:hi], b0:b1]
            # a term counts once in a passage: where it did not stand before since the passage began
            first = np.where((before[lo:hi] < part[lo:hi] * limit)[:, None], rows, 0)
            second = np.where((before[lo:hi] < (part[lo:hi] - 1) * limit)[:, None], rows, 0)
            cuts = np.searchsorted(part[lo:hi], np.arange(own[0], own[-1] + 3))
            sums = [np.vstack([np.zeros(b1 - b0), np.cumsum(x, axis=0, dtype=float)])[cuts] for x in (first, second)]
            reach = (np.diff(sums[0], axis=0)[:-1] + np.diff(sums[1], axis=0)[1:]) >= retrieve - 1e-6
            for k in np.flatnonzero(reach.any(axis=1)).tolist():
                start = int(own[k]) * limit
                passage = words[start:start + 2 * limit]
                held = np.unique(terms[lo + cuts[k]:lo + cuts[k + 2]]).tolist()
                for block in np.flatnonzero(reach[k]).tolist():
                    one = (b0 + block) * BLOCK
                    for i, score in block_max_wand(index, held, retrieve, one, min(one + BLOCK, len(index.ids))):
                        got = (overlap(index.questions[i], passage), overlap(index.answers[i], passage), score, start)
                        best[i] = max(best.get(i, got), got, key=lambda g: (min(g[0], g[1]), g[2], -g[3]))
    return best


def length_classes(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Blocks by the length of their longest item: up to 32 words, up to 64, and so on."""
    tops = [max(lengths[b:b + BLOCK]) for b in range(0, len(lengths), BLOCK)]
    out, b, limit = [], 0, 32
    while b < len(tops):
        end = b
        while end < len(tops) and tops[end] <= limit:
            end += 1
        if end > b:
            out.append((limit, b, end))
        b, limit = end, limit * 2
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", retrieve: float = RETRIEVE,
                  question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """One row per document (place _f, _r; id) and test item it holds: item_id, score (BM25 of the
    best passage over the item's own), question_overlap, answer_overlap, at_word (of the passage).

    Every passage of every document is a query. Null and empty texts and items without words match
    nothing; repeated items and documents are reported each. Empty tables give no rows."""
    ready = materialize(impacts(items, item_col, item_text), "impacts")
    size = ready.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).alias("w")).first()
    passes = max(1, math.ceil(size["n"] / PASS_ITEMS), math.ceil((size["w"] or 0) / PASS_WORDS))
    rows = with_row_id(docs.select(F.col(id_col), F.col(text_col))).select(
        "_f", "_r", F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = "_f long, _r long, id string, item_id string, score double, question_overlap double, answer_overlap double, at_word long"
    found = None
    for k in range(passes):
        own = ready.filter(F.pmod(F.xxhash64("no"), F.lit(passes)) == k).withColumn("item_id", F.col("item_id").cast("string"))
        shared = docs.sparkSession.sparkContext.broadcast(own.collect())  # about PASS_ITEMS items

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = build_index(shared.value)
            classes = length_classes(index.lengths)
            for batch in batches:
                out = []
                for f, r, doc, text in zip(batch["_f"], batch["_r"], batch["id"], batch["text"]):
                    for i, (q, a, score, at) in contaminated_items(words_of(text), index, classes, retrieve).items():
                        if q >= question and a >= answer:
                            out.append((f, r, doc, index.ids[i], score, q, a, at))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

        part = rows.mapInPandas(search, schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumns({"id": F.col("id").cast(id_kind), "item_id": F.col("item_id").cast(item_kind)})
