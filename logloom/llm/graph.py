"""Links between members of hash buckets, and the groups that links form, without emitting all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.session import discard, materialize

#: Members of one bucket that one task compares with one another.
CHUNK = 512
#: Members of a larger bucket that every chunk of it sees, so that its chunks join one another.
PIVOTS = 16

#: Rows that one call compares; many small buckets share a call.
CALL_ROWS = 2_000
#: Pairs that wait to be checked together.
WAITING = 20_000

#: Keys of buckets (16 bytes each) that are broadcast at most.
BROADCAST_KEYS = 1_000_000

#: Likeness of all pairs: (left payloads, right payloads) -> matrix, higher is more alike.
Likeness = Callable[[np.ndarray, np.ndarray], np.ndarray]


def forest(likeness: np.ndarray, least: float, group: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a most-alike spanning forest over pairs that reach `least`. Members that share a
    group (0 or more) count as joined already."""
    n = len(likeness)
    near = np.full(n, -np.inf)
    parent = np.full(n, -1)
    todo = np.ones(n, bool)
    out = []
    for _ in range(n):
        i = int(np.argmax(np.where(todo, near, -np.inf)))
        if not todo[i] or near[i] == -np.inf:
            i = int(np.flatnonzero(todo)[0])
        elif parent[i] >= 0 and near[i] < np.inf:
            out.append((int(parent[i]), i))
        todo[i] = False
        ok = todo & (likeness[i] >= least) & (likeness[i] > near)
        near[ok], parent[ok] = likeness[i][ok], i
        if group[i] >= 0:
            near[todo & (group == group[i])] = np.inf
    return out


#: Makes links of the rows of a group: (their columns as arrays, their signatures) -> entries.
Link = Callable[[dict[str, np.ndarray], np.ndarray], list]


def _by_group(part: pd.DataFrame, keys: list[str], link: Link) -> list:
    """What `link` gives for each group of rows that are sorted by their keys."""
    marks, columns = part[keys].to_numpy(), {c: part[c].to_numpy() for c in part.columns}
    cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
    sig = np.stack([np.frombuffer(s, np.uint16) for s in part["sig"]])
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(part)]):
        if b - a > 1:
            out += link({c: x[a:b] for c, x in columns.items()}, sig[a:b])
    return out


def _in_calls(rows: DataFrame, keys: list[str], total: int, link: Link) -> DataFrame:
    """Applies `link` (rows, their signatures) to each group of `keys`, many groups in a call."""
    calls = max(1, total // CALL_ROWS)

    def each(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_by_group(part.sort_values(keys, kind="stable"), keys, link), columns=["a", "b"], dtype="int64")

    call = F.pmod(F.xxhash64(F.lit(9), *keys), F.lit(calls))
    return rows.withColumn("call", call).groupBy("call").applyInPandas(each, "a long, b long")


def _in_line(rows: DataFrame, keys: list[str], link: Link, settle: Callable[[list], list]) -> DataFrame:
    """As _in_calls, but what `link` gives waits, up to WAITING entries or one batch of rows, for `settle`, which makes links of it."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, waiting = None, []
        for batch in chain(batches, [None]):
            part = pd.concat([x for x in (rest, batch) if x is not None], ignore_index=True) if rest is not None or batch is not None else None
            if part is None or not len(part):
                continue
            if batch is not None:  # the last group may go on in the next batch
                marks = part[keys].to_numpy()
                same = (marks == marks[-1]).all(axis=1)
                cut = len(part) - int(np.argmin(same[::-1])) if not same.all() else 0
                rest, part = part.iloc[cut:], part.iloc[:cut]
            waiting += _by_group(part, keys, link) if len(part) else []
            if waiting and (batch is None or len(waiting) >= WAITING):
                yield pd.DataFrame(settle(waiting), columns=["a", "b"], dtype="int64")
                waiting = []

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(each, "a long, b long")


def _if_small(keys: DataFrame) -> DataFrame:
    """A written table of keys, marked for broadcast if its rows were counted to be few enough; larger
    ones are joined by a shuffle."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def bucket_sizes(entries: DataFrame) -> DataFrame:
    """(key, node, ...) -> per key with two nodes or more: n, the smallest and the largest node, and
    a mark of the set of nodes. The mark lets equal buckets of several bands be handled once."""
    return entries.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"),
        F.bit_xor(F.xxhash64("node")).alias("mark")).filter(F.col("n") > 1)


def candidate_links(entries: DataFrame, payload: DataFrame, likeness: Likeness, least: float, name: str,
                    chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """First round: links to verify, as distinct (a, b) with a < b, and the bucket table.

    `entries` (key, node) says which buckets a node is in, `payload` (node, sig) what is compared.
    A bucket of two gives its pair; a larger one the edges of a most-alike spanning forest, so the
    number of links follows the number of entries. Buckets beyond `chunk` are cut into chunks that
    share a few pivots. Whether the links that were left out matter is settled by `missing_links`."""
    sizes = materialize(bucket_sizes(entries), f"{name}-buckets")
    once = sizes.groupBy("n", "mark", "a", "b").agg(F.min("key").alias("key"))
    large = materialize(once.filter("n > 2").select("key", "n"), f"{name}-large")
    members = entries.join(_if_small(large), "key").withColumn("c", F.ceil(F.col("n") / chunk).cast("int"))
    home = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("c")).cast("int")
    pivot = F.pmod(F.xxhash64(F.lit(5), "key", "node"), F.col("n")) < PIVOTS
    spread = members.withColumn("part", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("c") - 1)).otherwise(F.array(home))))
    compared = spread.select("key", "part", "node").join(payload, "node")

    def link(rows: dict[str, np.ndarray], sig: np.ndarray) -> list:
        nodes = rows["node"]
        like = likeness(sig, sig)
        np.fill_diagonal(like, -np.inf)
        if like.max() < least:
            return []
        return [(nodes[i], nodes[j]) for i, j in forest(like, least, np.full(len(nodes), -1))]

    total = large.agg(F.sum("n")).first()[0] or 0
    trees = _in_calls(compared, ["key", "part"], total, link)
    pairs = once.filter("n = 2").select("a", "b").unionByName(trees)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sizes


def missing_links(entries: DataFrame, sizes: DataFrame, payload: DataFrame, roots: DataFrame, tried: DataFrame,
                  likeness: Likeness, least: float, name: str, chunk: int = CHUNK,
                  whole: Callable[[DataFrame], DataFrame] | None = None, same: Callable | None = None,
                  agree: Callable[[list, list], np.ndarray] | None = None) -> DataFrame:
    """Second round: links between different groups inside the buckets whose nodes are not all in one
    group yet, so that no link between groups is lost. Each pair of such a bucket meets in a chunk
    pair. Without `whole`, every pair from different groups that is alike enough and was not tried
    is returned. With it, whole(nodes) gives (node, full), and same(full, full) settles the pairs
    inside the task: a link is returned only where it joins groups that are still apart there.
    agree(fulls, fulls) settles many pairs of a task at once instead; all true links are returned."""
    large = sizes.filter("n > 2").groupBy("n", "mark", "a", "b").agg(F.min("key").alias("key"))
    large = _if_small(materialize(large.select("key", "n"), f"{name}-large"))
    grouped = entries.join(large, "key").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    split = grouped.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    left = grouped.join(materialize(split, f"{name}-split"), "key").withColumn("c", F.ceil(F.col("n") / chunk).cast("int"))
    home = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("c")).cast("int")
    # chunk pairs (i, j): a member of chunk h takes part in all pairs that name h
    each = left.withColumn("h", home).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    each = materialize(each.select("key", F.least("h", "o").alias("i"), F.greatest("h", "o").alias("j"), "h", "node", "root"),
                       f"{name}-chunks")
    compared = each.join(payload, "node")
    if whole is not None:
        compared = compared.join(materialize(whole(each.select("node").distinct()), f"{name}-whole"), "node")

    def link(rows: dict[str, np.ndarray], sig: np.ndarray) -> list:
        nodes, root, h = (rows[c] for c in ("node", "root", "h"))
        like = likeness(sig, sig)
        i, j = np.nonzero(np.triu((like >= least) & (root[:, None] != root[None, :]), 1))
        if rows["i"][0] != rows["j"][0]:
            cross = h[i] != h[j]
            i, j = i[cross], j[cross]
        if agree is not None:
            full = rows["full"]
            return list(zip(np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j]), full[i], full[j]))
        if same is not None:
            full, label = rows["full"], root.copy()
            joined = []
            for k in np.argsort(-like[i, j], kind="stable"):
                x, y = i[k], j[k]
                if label[x] != label[y] and same(full[x], full[y]):
                    joined.append(k)
                    label[label == label[y]] = label[x]
            i, j = i[joined], j[joined]
        return list(zip(np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j])))

    def settle(pairs: list) -> list:
        once = list({p[:2]: p for p in pairs}.values())
        return [p[:2] for p, ok in zip(once, agree([p[2] for p in once], [p[3] for p in once])) if ok]

    if agree is not None:  # a pair that agrees was not tried, else both ends were in one group
        found = _in_line(compared, ["key", "i", "j"], link, settle).distinct()
    else:
        found = _in_calls(compared, ["key", "i", "j"], each.count(), link).distinct().join(tried, ["a", "b"], "left_anti")
    out = materialize(found, f"{name}-more")
    discard(each)
    return out


def connected(edges: DataFrame, name: str) -> DataFrame:
    """(a, b) -> (node, root): the smallest node of its group for every node that has a link. Large
    and small stars in turn; each round is written to the shared folder."""
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = materialize(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-links")
    e_table = e
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        star = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.filter("u <> v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u")
        e = small.select("u", F.col("m").alias("v")).unionByName(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        last, e = e_table, materialize(e, f"{name}-stars")
        e_table = e
        discard(last)
        after = mark(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def grouped_links(entries: DataFrame, payload: DataFrame, likeness: Likeness, least: float,
                  verify: Callable[[DataFrame], DataFrame], name: str, chunk: int = CHUNK,
                  whole: Callable[[DataFrame], DataFrame] | None = None, same: Callable | None = None,
                  agree: Callable[[list, list], np.ndarray] | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, root) of all groups, and the verified links they came from. `verify` keeps the true links, and `agree`, where
    it is given, those of the second round; for it, `whole` and `same` see missing_links."""
    first, sizes = candidate_links(entries, payload, likeness, least, name, chunk)
    tried = materialize(first, f"{name}-tried")
    held = materialize(verify(tried), f"{name}-held")
    roots = connected(held, name)
    more = missing_links(entries, sizes, payload, roots, tried, likeness, least, name, chunk, whole, same, agree)
    discard(tried, sizes)
    if more.isEmpty():
        return roots, held
    both = materialize(held.unionByName(more if agree is not None else verify(more)), f"{name}-held")
    discard(held, more)
    return connected(both, name), both
