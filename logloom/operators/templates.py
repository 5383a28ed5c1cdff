"""Template mining: distinct token arrays follow leaders of their (service, length, prefix)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.text import mask_fast, template_hash
from logloom.schema import TEMPLATE_KEY
from logloom.scale import top_n
from logloom.session import materialize

WILD = "<*>"
DELIMITERS = r"[_:=/\\\[\]()]"
GROUP_LIMIT = 1_000
GROUP = ["service_name", "n_tokens", "prefix"]


def spaced_text(text: Column) -> Column:
    """The message with the extra delimiters as blanks and single blanks between tokens."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, DELIMITERS, " "), r"\s+", " "))


def message_tokens(text: Column) -> Column:
    """Tokens of the spaced message; a blank message gives an empty array."""
    spaced = spaced_text(text)
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def masked_text(spaced: Column) -> Column:
    """Tokens that hold a digit become wildcards; one regex over the text, without arrays."""
    return F.regexp_replace(spaced, r"[^ ]*[0-9][^ ]*", WILD)


class Leaders:
    """The leaders of one group in their order, all of one length, as a table of token numbers."""

    def __init__(self, sim_th: float):
        self.sim_th, self.numbers, self.rows, self.wild, self.n = sim_th, {WILD: -1}, np.empty((0, 0), np.int64), np.empty(0, np.int64), 0

    def _coded(self, tokens: list[str]) -> np.ndarray:
        return np.array([self.numbers.setdefault(t, len(self.numbers)) for t in tokens], np.int64)

    def best(self, tokens: list[str]) -> int | None:
        """The most alike leader (equal tokens, wildcards not counted; then more wildcards, then the earlier one)
        of those that reach the similarity."""
        if not self.n:
            return None
        row = self._coded(tokens)
        same = ((self.rows[:self.n] == row) & (row >= 0)).sum(axis=1)
        first = np.lexsort((-self.wild[:self.n], -same))[0]
        return int(first) if same[first] >= self.sim_th * len(tokens) else None

    def add(self, tokens: list[str]) -> int:
        row = self._coded(tokens)
        if self.n == len(self.rows):
            self.rows = np.vstack([self.rows.reshape(self.n, len(row)), np.full((max(8, self.n), len(row)), -2)])
            self.wild = np.concatenate([self.wild, np.zeros(max(8, self.n), np.int64)])
        self.rows[self.n], self.wild[self.n] = row, (row < 0).sum()
        self.n += 1
        return self.n - 1


def widened(template: list[str], tokens: list[str]) -> list[str]:
    return [x if x == y else WILD for x, y in zip(template, tokens)]


def _leaders_of(sim_th: float):
    def lead(group: pd.DataFrame) -> pd.DataFrame:
        """The shapes that no earlier leader of the group is similar to; a group has at most group_limit shapes here."""
        known, out = Leaders(sim_th), []
        for sid, tokens in group.sort_values(["at", "text"])[["sid", "tokens"]].itertuples(index=False):
            if known.best(list(tokens)) is None:
                known.add(list(tokens))
                out.append(sid)
        return pd.DataFrame({"sid": out})

    return lead


def _postings(shapes: DataFrame, name: str) -> DataFrame:
    """(group, pos, token) of every token that is no wildcard, with the shape's id as `name`."""
    return shapes.select(*GROUP, F.col("sid").alias(name), F.posexplode("tokens").alias("pos", "token")).filter(F.col("token") != WILD)


def similar_pairs(shapes: DataFrame, leaders: DataFrame, sim_th: float) -> DataFrame:
    """(sid, lid, same) of shapes and earlier leaders of their group with at least sim_th of all places equal.

    Similar arrays share at least t postings (position, token). Of the postings that a shape shares with any
    leader its t - 1 most common ones are left out of the search: two similar arrays still share one of the
    others. So a token that all leaders hold makes no pairs on its own. Pairs are then compared in full."""
    index = _postings(leaders, "lid")
    common = index.groupBy(*GROUP, "pos", "token").agg(F.count(F.lit(1)).alias("_n"))
    shared = _postings(shapes, "sid").join(common, [*GROUP, "pos", "token"])
    needed = F.greatest(F.ceil(F.col("n_tokens") * F.lit(sim_th) - F.lit(1e-9)), F.lit(1))
    by_heat = W.partitionBy("sid").orderBy(F.col("_n").desc(), "pos")
    rare = shared.withColumn("_rank", F.row_number().over(by_heat)).filter(F.col("_rank") >= needed)
    met = rare.select(*GROUP, "pos", "token", "sid").join(index, [*GROUP, "pos", "token"]).select("sid", "lid").distinct()
    pairs = met.join(shapes.select("sid", "n_tokens", "tokens", "at", "text"), "sid").join(
        leaders.select(F.col("sid").alias("lid"), F.col("tokens").alias("_l"), F.col("at").alias("_at"), F.col("text").alias("_text")), "lid")
    equal = F.aggregate(F.zip_with("tokens", "_l", lambda x, y: ((x == y) & (x != WILD)).cast("int")), F.lit(0), lambda n, x: n + x)
    earlier = (F.col("_at") < F.col("at")) | ((F.col("_at") == F.col("at")) & (F.col("_text") < F.col("text")))
    return pairs.filter(earlier).withColumn("same", equal).filter(F.col("same") >= needed).select("sid", "lid", "same")


def find_leaders(shapes: DataFrame, sim_th: float, group_limit: int) -> DataFrame:
    """The rows of `shapes` that no earlier leader of their group is similar to, by order (at, text).

    Each round decides the first `group_limit` open shapes of every group in one task each: which of them lead
    depends on nothing that comes later. Shapes similar to a new leader are then settled by a join over postings,
    and the rest goes to the next round. So the answer does not depend on group_limit."""
    left, found = shapes, None
    while True:
        first = materialize(top_n(left, GROUP, [F.col("at"), F.col("text")], group_limit).drop("rn"), "first-shapes")
        ids = first.select(*GROUP, "sid", "at", "text", "tokens").groupBy(*GROUP).applyInPandas(_leaders_of(sim_th), "sid string")
        new = materialize(first.join(ids, "sid", "left_semi"), "leaders")
        found = new if found is None else found.unionByName(new)
        rest = left.join(first.select("sid"), "sid", "left_anti")
        if rest.isEmpty():
            return found
        left = materialize(rest.join(similar_pairs(rest, new, sim_th).select("sid").distinct(), "sid", "left_anti"), "open-shapes")
        if left.isEmpty():
            return found


def shapes_of(rows: DataFrame, depth: int) -> DataFrame:
    """One row per (service, masked text) with its tokens, group and place in the order."""
    shapes = rows.filter(F.col("_text") != "").groupBy("service_name", F.col("_text").alias("text")).agg(
        F.min("timestamp_utc").alias("first_seen"), F.count(F.lit(1)).alias("_rows"))
    return grouped(shapes, depth).withColumn("at", F.coalesce(F.unix_micros("first_seen"), F.lit(-(1 << 62)))).drop("first_seen")


def grouped(shapes: DataFrame, depth: int) -> DataFrame:
    """Adds sid, tokens, n_tokens and prefix to rows with service_name and text."""
    return (shapes.withColumn("sid", F.md5(F.concat_ws("\x01", F.coalesce("service_name", F.lit("\x02")), "text")))
            .withColumn("tokens", F.split("text", " ")).withColumn("n_tokens", F.size("tokens"))
            .withColumn("prefix", F.array_join(F.slice("tokens", 1, max(depth - 3, 1)), " ")))


def mine_templates(logs: DataFrame, depth: int = 4, sim_th: float = 0.4, max_children: int = 100,
                   group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Log rows with template_text, template_hash and parameters.

    1. Tokens with digits are wildcards, and equal masked arrays are counted before anything is
       compared, so the search sees distinct shapes and not rows.
    2. Shapes are compared inside (service, length, first depth - 3 tokens). A prefix beyond the
       `max_children` most frequent of its (service, length) goes to the wildcard prefix.
    3. In order of (first seen, text) a shape joins the most alike leader before it with at least `sim_th` of all
       places equal, or leads itself. The template keeps the tokens that all shapes of a leader share.

    No group of shapes is ever in one task as a whole (see find_leaders); `group_limit` only bounds tasks."""
    rows = logs.withColumn("_text", masked_text(spaced_text(F.col("body_raw"))))
    shapes = materialize(_limit_children(shapes_of(rows, depth), max_children), "shapes")
    leaders = find_leaders(shapes, sim_th, group_limit)
    wilds = leaders.select(F.col("sid").alias("lid"), F.size(F.filter("tokens", lambda t: t == WILD)).alias("_wild"), F.col("at").alias("_at"),
                           F.col("text").alias("_lt"))
    others = shapes.join(leaders.select("sid"), "sid", "left_anti")
    ranked = similar_pairs(others, leaders, sim_th).join(wilds, "lid").groupBy("sid").agg(
        F.min(F.struct((-F.col("same")).alias("a"), (-F.col("_wild")).alias("b"), "_at", "_lt", "lid"))["lid"].alias("lid"))
    members = materialize(leaders.select("sid", F.col("sid").alias("lid")).unionByName(ranked), "members")
    places = members.join(shapes.select("sid", "tokens"), "sid").select("lid", F.posexplode("tokens").alias("pos", "token"))
    agreed = places.groupBy("lid", "pos").agg(F.min("token").alias("_a"), F.max("token").alias("_b")).select(
        "lid", "pos", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(WILD).alias("token"))
    templates = agreed.groupBy("lid").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("template"))
    named = shapes.select("service_name", F.col("text").alias("_text"), "sid").join(members, "sid").join(templates, "lid").select(
        F.col("service_name").alias("_service"), F.col("_text").alias("_shape"), "template")
    out = rows.join(named, rows["service_name"].eqNullSafe(named["_service"]) & (rows["_text"] == named["_shape"]), "left").withColumn(
        "template_text", F.coalesce("template", F.lit(WILD)))
    return (out.withColumn("template_hash", template_hash(F.col("service_name"), F.col("template_text")))
            .withColumn("parameters", extract_parameters(
                F.col("body_raw"), message_tokens(F.col("body_raw")), F.col("template_text")))
            .drop("_text", "template", "_service", "_shape"))


def _limit_children(shapes: DataFrame, max_children: int) -> DataFrame:
    weight = shapes.groupBy("service_name", "n_tokens", "prefix").agg(F.sum("_rows").alias("_w"))
    kept = top_n(weight.filter(F.col("prefix") != WILD), ["service_name", "n_tokens"], [F.col("_w").desc(), F.col("prefix")],
                 max_children).select("service_name", "n_tokens", "prefix", F.lit(True).alias("_kept"))
    return shapes.join(kept, ["service_name", "n_tokens", "prefix"], "left").withColumn(
        "prefix", F.when(F.col("_kept"), F.col("prefix")).otherwise(WILD)).drop("_kept")


def extract_parameters(message: Column, tokens: Column, template: Column) -> Column:
    """Tokens at the wildcard places of the template; a blank message is its own parameter."""
    pairs = F.arrays_zip(tokens.alias("t"), F.split(template, " ").alias("w"))
    found = F.transform(F.filter(pairs, lambda p: p["w"] == WILD), lambda p: p["t"])
    return F.when(F.size(tokens) == 0, F.array(message)).otherwise(found)


def mine_fast(logs: DataFrame) -> DataFrame:
    """Log rows with the masked template and its hash; no parameters."""
    masked = mask_fast(F.col("body_raw"))
    return (logs.withColumn("template_text", masked)
            .withColumn("template_hash", template_hash(F.col("service_name"), masked))
            .withColumn("parameters", F.array().cast("array<string>")))


def template_counts(templates: DataFrame) -> DataFrame:
    return templates.groupBy("service_name").agg(F.count(F.lit(1)).alias("templates"))


def templates_of(mined: DataFrame) -> DataFrame:
    """One row per template key with first and last event time, state queued."""
    return mined.groupBy(*TEMPLATE_KEY).agg(
        F.min("template_text").alias("template_text"), F.min("timestamp_utc").alias("first_seen_utc"),
        F.max("timestamp_utc").alias("last_seen_utc")).withColumn("embedding_state", F.lit("queued"))


def new_templates(mined: DataFrame, templates: DataFrame) -> DataFrame:
    return templates_of(mined).join(templates.select(*TEMPLATE_KEY), TEMPLATE_KEY, "left_anti")


def upsert_templates(templates: DataFrame, new: DataFrame) -> DataFrame:
    """Keeps the first first_seen and the stored state, refreshes last_seen, adds unknown keys."""
    cols = [*TEMPLATE_KEY, "template_text", "first_seen_utc", "last_seen_utc", "embedding_state"]
    both = templates.select(*cols, F.lit(0).alias("_o")).unionByName(new.select(*cols, F.lit(1).alias("_o")))
    return both.groupBy(*TEMPLATE_KEY).agg(
        F.min_by("template_text", "_o").alias("template_text"), F.min("first_seen_utc").alias("first_seen_utc"),
        F.max("last_seen_utc").alias("last_seen_utc"), F.min_by("embedding_state", "_o").alias("embedding_state"))
