"""Prefix trie of rebuilt conversations, by collapsing whole sequences.

Equal conversations become one weighted sequence with the list of those that end there; sequences that are
proper prefixes of others drop out by an anti-join, which leaves the leaves; the nodes and all their figures
are sums over the prefixes of the weighted sequences. A prefix is named by its depth and two 64-bit xors of
hashes of (depth, role, text), so prefixes are running xors and no conversation is ever gathered in one place.

Rows are ordered by turn (null first), then by role and text; a null role or text counts as empty. Rows
without a conversation id take no part. An empty table has no node, not even a root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.common import text_or_empty
from logloom.scale import running_totals
from logloom.session import materialize

#: Turns whose order is settled in one task; longer conversations are cut into such pieces.
GRAIN = 4096
#: Conversation ids that are written as one piece of an end list.
IDS = 4096
#: Everything but a blank, as the words are defined.
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "p1", "p2"]
#: The first rows of a group of so many conversations come from the group's first conversation.
GROUP = 20
MOST_SHARED = 4


def turns_of(rows: DataFrame) -> DataFrame:
    """(c, b, rn, t1, t2, words): the turns of each conversation without their texts. rn counts inside the
    piece b of the conversation."""
    piece = F.coalesce(F.floor(F.col("turn") / GRAIN), F.lit(-(1 << 60)))
    seen = rows.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), piece.alias("b"), F.col("turn").cast("long").alias("turn"),
        text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    order = W.partitionBy("c", "b").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return seen.select("c", "b", F.row_number().over(order).cast("long").alias("rn"), F.xxhash64(F.lit(11), "role", "text").alias("t1"),
                       F.xxhash64(F.lit(29), "role", "text").alias("t2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (c, depth, t1, t2, words) after every conversation took its first h = crc32(id) mod 4 turns from
    the first of its group of 20 ids, and the lengths (c, n) of all conversations, of those without a turn too."""
    pieces = turns.groupBy("c", "b").agg(F.count(F.lit(1)).alias("_n"))
    by_piece = W.partitionBy("c").orderBy("b")
    pieces = pieces.select("c", "b", F.coalesce(F.sum("_n").over(by_piece.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                           F.sum("_n").over(W.partitionBy("c")).alias("n"))
    placed = turns.join(pieces.select("c", "b", "before"), ["c", "b"]).select(
        "c", (F.col("rn") + F.col("before")).alias("pos"), "t1", "t2", "words")
    convs = pieces.groupBy("c").agg(F.max("n").alias("n")).select(
        "c", "n", (F.crc32(F.col("c").cast("string")) % MOST_SHARED).alias("h"), (F.col("c") - F.col("c") % GROUP).alias("d"))
    givers = convs.select(F.col("c").alias("d"), F.col("n").alias("given"))
    convs = convs.join(givers, "d", "left").select(
        "c", "d", "n", "h", F.least(F.col("h"), F.coalesce(F.col("given"), F.lit(0))).alias("k"))
    # at most three rows of a giver for at most twenty conversations
    heads = placed.filter(F.col("pos") < MOST_SHARED).withColumnRenamed("c", "d")
    taken = convs.filter("k > 0").select("c", "d", "k").join(heads, "d").filter(F.col("pos") <= F.col("k"))
    own = placed.join(convs.select("c", "h", "k"), "c").filter(F.col("pos") > F.col("h"))
    both = taken.select("c", F.col("pos").alias("depth"), "t1", "t2", "words").unionByName(
        own.select("c", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "t1", "t2", "words"))
    return both, convs.select("c", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Adds the names of the prefix that ends at each turn (p1, p2) and of the one before it (q1, q2)."""
    piece = F.floor((F.col("depth") - 1) / GRAIN)
    marked = turns.select("c", "depth", piece.alias("b"), "words", F.xxhash64("depth", "t1").alias("x1"), F.xxhash64("depth", "t2").alias("x2"))
    order = W.partitionBy("c", "b").orderBy("depth")
    inside = marked.withColumns({"r1": F.bit_xor("x1").over(order), "r2": F.bit_xor("x2").over(order)})
    # what the pieces before add; a conversation of one piece has no such row
    sums = marked.groupBy("c", "b").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    before = W.partitionBy("c").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select("c", "b", F.bit_xor("s1").over(before).alias("s1"), F.bit_xor("s2").over(before).alias("s2")).filter("b > 0")
    zero = F.lit(0).cast("long")
    p1, p2 = (F.col(f"r{i}").bitwiseXOR(F.coalesce(F.col(f"s{i}"), zero)) for i in (1, 2))
    named = inside.join(carried, ["c", "b"], "left").select("c", "depth", "words", p1.alias("p1"), p2.alias("p2"), "x1", "x2")
    return named.select("c", "depth", "words", "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"),
                        F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over the pieces of each end list, which follow one another; only the running state is held."""
    key, state = None, None
    for batch in batches:
        out = []
        for *here, ids in batch[[*KEY, "ids"]].itertuples(index=False):
            if here != key:
                if state is not None:
                    out.append((*key, state.hexdigest()))
                key, state = here, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=[*KEY, "ends"])
    if state is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=[*KEY, "ends"])


def end_lists(members: DataFrame) -> DataFrame:
    """Digest of the ascending ids of each group (KEY, c). Ids are joined in pieces of neighbouring ids, of at
    most IDS each; a list of one piece is hashed where it is, the pieces of a longer list pass one after
    another through one running hash."""
    listed = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")))
    pieces = members.groupBy(*KEY, F.floor(F.col("c") / IDS).alias("at")).agg(listed.alias("ids"))
    pieces = materialize(pieces, "ends")
    lists = pieces.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_pieces"), F.min("ids").alias("ids"))
    short = lists.filter("_pieces = 1").select(*KEY, F.sha2("ids", 256).alias("ends"))
    many = pieces.join(lists.filter("_pieces > 1").select(*KEY), KEY, "left_semi")
    long = many.repartition(*KEY).sortWithinPartitions(*KEY, "at").select(*KEY, "ids").mapInPandas(
        _digests, "depth long, p1 long, p2 long, ends string")
    return short.unionByName(long)


def nodes_of(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """All nodes of the trie over conversations given as turns (c, depth, t1, t2, words) and lengths (c, n)."""
    zero = F.lit(0).cast("long")
    named = materialize(prefixes(turns), "prefixes")
    last = named.groupBy("c").agg(F.max(F.struct(*KEY)).alias("e")).select("c", "e.*").unionByName(
        lengths.filter("n = 0").select("c", *[zero.alias(k) for k in KEY]))
    last = materialize(last, "whole")
    # equal conversations: one sequence with their number and the smallest id, which stands for them
    sequences = materialize(last.groupBy(*KEY).agg(F.count(F.lit(1)).alias("weight"), F.min("c").alias("c")), "sequences")
    ends = end_lists(last)

    standing = sequences.select("c", "weight", F.col("depth").alias("n"))
    paths = named.join(standing, "c").unionByName(standing.select(
        "c", zero.alias("depth"), zero.alias("words"), *[zero.alias(x) for x in ("p1", "p2", "q1", "q2")], "weight", "n"))
    paths = materialize(paths, "paths")
    proper = paths.filter(F.col("depth") < F.col("n")).select(*KEY).distinct()
    leaves = sequences.join(proper, KEY, "left_anti").select("c", F.lit(1).cast("long").alias("leaf"))

    nodes = materialize(paths.groupBy(*KEY).agg(
        F.sum("weight").alias("n_convs"), F.min("c").alias("conv_id"), F.max("words").alias("words"), F.max("q1").alias("q1"), F.max("q2").alias("q2")), "nodes")
    # every node belongs to its smallest conversation, which owns the lower end of its own path; what a node
    # saves with all below it is the sum over the sequences through it: all they own, from this node on for the owner
    owned = nodes.select(F.col("conv_id").alias("c"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = owned.groupBy("c").agg(F.sum("saved").alias("total"), F.min("depth").alias("top"))
    upto = running_totals(owned, ["c"], "depth", ["saved"], GRAIN).select("c", "depth", (F.col("run_saved") - F.col("saved")).alias("above"))
    sums = paths.select("c", *KEY).join(totals.select("c", "total"), "c", "left").join(leaves, "c", "left").groupBy(*KEY).agg(
        F.sum(F.coalesce("total", zero)).alias("below"), F.sum(F.coalesce("leaf", zero)).alias("n_leaves"))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    # only the top node that a conversation owns has a parent of another conversation
    tops = nodes.join(totals.select(F.col("c").alias("conv_id"), F.col("top").alias("depth")), ["conv_id", "depth"]).filter("depth > 0")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))
    other = tops.select("conv_id", "depth", "q1", "q2").join(parents, ["depth", "q1", "q2"]).select(
        F.col("conv_id").alias("c"), "depth", "parent")

    full = (nodes.join(sums, KEY).join(children, KEY, "left").join(ends, KEY, "left")
            .withColumnRenamed("conv_id", "c").join(upto, ["c", "depth"]).join(other, ["c", "depth"], "left"))
    parent: Column = F.when(F.col("depth") > 0, F.coalesce("parent", "c"))
    return full.select(F.col("c").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs",
                       F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
                       (F.col("below") - F.col("above")).alias("saved_tokens"),
                       F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def prefix_trie(rows: DataFrame) -> DataFrame:
    """The trie over the rebuilt conversations of `rows` (conv_id, turn, role, text; other columns are ignored)."""
    turns, lengths = rebuilt(materialize(turns_of(rows), "turns"))
    return nodes_of(turns, lengths)
