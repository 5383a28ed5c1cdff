"""URL filter: rules over hosts and paths first, a character language-model ratio for the rest.

Two variable-order Markov models, one of the URLs that a rule allows and one of those that a rule
blocks, are smoothed by Witten-Bell interpolation down to a uniform order. The log-likelihood
difference per character decides on URLs that no rule fits, against a threshold calibrated on a fifth
of the ruled URLs that no model has seen. Everything is DataFrame functions.

Null URLs and URLs without `://` have an empty host and path; the model then reads the URL itself
(null: empty). Every row of the input gives one row, repeated rows repeat. If no rule allows or no rule
blocks any URL there is nothing to learn: all scores are 0 and the verdict is allow."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.common import fresh, hash_pair
from logloom.session import materialize


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Fixed values of the query: who may pass and who may not.
RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)

#: Characters of context of the highest order.
ORDER = 5
#: One in so many ruled URLs calibrates instead of training.
HOLD_OUT = 5
#: A gram that makes up at least one in so many of the grams to score is broadcast: there are at most as many such grams.
HEAVY = 10_000
#: Scores are summed in millionths; the threshold is looked for in steps of a thousandth within +-20.
MICRO, STEP, BINS = 1_000_000, 1_000, 20_000
START, END = "\x02", "\x03"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and the text that the models read."""
    found = F.instr(url, "://") > 0
    rest = F.when(found, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(raw) + 1, F.length(rest))
    host = F.translate(raw, UPPER, LOWER)
    path = F.regexp_extract(after, "^[^?#]*", 0)
    text = F.when(found, F.concat(host, after)).otherwise(F.coalesce(url, F.lit("")))
    return (F.coalesce(host, F.lit("")), F.coalesce(path, F.lit("")), text)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.host + rule.path).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def grams_of(text: Column, order: int = ORDER) -> Column:
    """The gram that ends at each character of a text and at its end: `order` characters and the one after.
    Shifted copies of one character array are zipped, so the work is linear in the length."""
    chars = F.concat(F.array_repeat(F.lit(START), order), F.filter(F.split(text, ""), lambda c: c != ""), F.array(F.lit(END)))
    n = F.size(chars) - order
    shifted = [F.slice(chars, i + 1, n) for i in range(order + 1)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), shifted)


def gram_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """Log-likelihood difference (in millionths) of each gram's last character given those before it.

    `counts` holds g, na, nr: every gram to be scored, with its counts among allowed and rejected URLs.
    Each order mixes its own relative frequency with the order below; the weight of the lower order is the
    number of different characters that followed the context. A context that was never seen leaves all
    the weight to the lower order."""
    below = None
    for k in range(order + 1):
        s = F.substring("g", order - k + 1, k + 1)
        here = counts.groupBy(s.alias("s")).agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
        # a context has at most as many rows as there are characters
        same = W.partitionBy(F.substring("s", 1, k))
        seen = {}
        for c in ("a", "r"):
            seen[f"all_{c}"] = F.sum(f"n{c}").over(same)
            seen[f"kinds_{c}"] = F.sum((F.col(f"n{c}") > 0).cast("long")).over(same)
        here = here.withColumns(seen)
        if below is None:
            here = here.withColumns({"low_a": F.lit(1.0) / F.count(F.lit(1)).over(same), "low_r": F.lit(1.0) / F.count(F.lit(1)).over(same)})
        else:
            here = here.join(below.select(F.col("s").alias("tail"), F.col("pa").alias("low_a"), F.col("pr").alias("low_r")),
                             F.substring("s", 2, k) == F.col("tail"))
        mixed = {}
        for c in ("a", "r"):
            total = F.col(f"all_{c}") + F.col(f"kinds_{c}")
            mixed[f"p{c}"] = F.when(total > 0, (F.col(f"n{c}") + F.col(f"kinds_{c}") * F.col(f"low_{c}")) / total).otherwise(F.col(f"low_{c}"))
        below = here.withColumns(mixed).select("s", "pa", "pr")
    ratio = F.round((F.log("pa") - F.log("pr")) * MICRO).cast("long")
    return below.select(F.col("s").alias("g"), ratio.alias("ratio"))


def scores_of(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """Mean ratio per gram of each text (`u1`, `u2`, `label`, `role`), in millionths, rounded down. The few
    frequent grams are broadcast; the others meet their ratios by a shuffle. No row carries the whole text."""
    rows = texts.select("u1", "u2", "label", "role", F.explode(grams_of(F.col("text"))).alias("g"))
    heavy = F.broadcast(ratios.filter("heavy").select("g", "ratio"))
    light = ratios.filter("not heavy").select("g", "ratio")
    keys = ["u1", "u2", "label", "role"]
    hit = rows.join(heavy, "g").select(*keys, "ratio")
    miss = rows.join(heavy, "g", "left_anti").join(light, "g").select(*keys, "ratio")
    return hit.unionByName(miss).groupBy(*keys).agg(F.floor(F.sum("ratio") / F.count(F.lit(1))).alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row `least`: the score from which a URL is allowed. It makes the share of allowed URLs above it
    less the share of rejected ones greatest (of equal ones the lowest), half-way to the next score below.
    0 where one kind has no URL to calibrate with. Works on at most 2 * BINS + 1 counts."""
    bin_of = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") / STEP)))
    bins = scored.groupBy(bin_of.alias("bin")).agg(
        F.sum((F.col("label") == "allow").cast("long")).alias("a"), F.sum((F.col("label") == "block").cast("long")).alias("r"))
    whole = W.partitionBy(F.lit(0))
    above = whole.orderBy(F.desc("bin"))
    cut = bins.select("bin", F.sum("a").over(above).alias("a"), F.sum("r").over(above).alias("r"), F.lead("bin").over(above).alias("next"),
                      F.sum("a").over(whole).alias("all_a"), F.sum("r").over(whole).alias("all_r"))
    usable = cut.filter((F.col("all_a") > 0) & (F.col("all_r") > 0))
    # compared as whole numbers: both shares over the common denominator
    gain = F.col("a") * F.col("all_r") - F.col("r") * F.col("all_a")
    best = usable.agg(F.max(F.struct(gain.alias("gain"), (-F.col("bin")).alias("low"), F.col("next").alias("next"))).alias("b"))
    at = -F.col("b.low")
    middle = F.floor((at + F.coalesce(F.col("b.next"), at) + 1) / 2) * STEP
    return best.select(F.coalesce(middle, F.lit(0)).cast("long").alias("least"))


def judge(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds host, path, rule, verdict and score (millionths of a nat per character; null where a rule decides)
    to every row of `pages`. Columns of these names give way."""
    added = ["host", "path", "rule", "verdict", "score"]
    keep = [c for c in pages.columns if c.lower() not in added]
    host, path, text = parts(F.col(f"`{url}`").cast("string"))
    t, v, h1, h2 = (fresh(keep + added, x) for x in ("text", "by_rule", "hash1", "hash2"))
    seen = pages.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"), text.alias(t))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": rule, v: verdict})

    # equal URLs are read once, however many rows repeat them
    fold = F.crc32(F.col("text")) % HOLD_OUT
    role = F.when(F.col("label") == "judge", "judge").when(fold == 0, "calibrate").otherwise("train")
    texts = materialize(seen.select(F.col(t).alias("text"), F.coalesce(F.col(v), F.lit("judge")).alias("label")).distinct()
                        .withColumns({"role": role, **dict(zip(("u1", "u2"), hash_pair(F.col("text"))))}), "urls")
    one = {c: F.sum(((F.col("role") == "train") & (F.col("label") == kind)).cast("long")).alias(c) for c, kind in (("na", "allow"), ("nr", "block"))}
    counts = materialize(texts.select("label", "role", F.explode(grams_of(F.col("text"))).alias("g")).groupBy("g").agg(
        one["na"], one["nr"], F.sum((F.col("role") != "train").cast("long")).alias("n")), "url_grams")
    total, accepted, rejected = counts.agg(F.sum("n"), F.sum("na"), F.sum("nr")).first()
    if not accepted or not rejected:
        nothing = F.when(F.col(v).isNull(), F.lit(0).cast("long"))
        return seen.select(*[F.col(f"`{c}`") for c in keep], "host", "path", "rule", F.coalesce(F.col(v), F.lit("allow")).alias("verdict"),
                           nothing.alias("score"))
    ratios = gram_ratios(counts).join(counts.filter("n > 0").select("g", (F.col("n") * HEAVY >= (total or 0)).alias("heavy")), "g")
    scored = materialize(scores_of(texts.filter("role <> 'train'"), materialize(ratios, "url_ratios")), "url_scores")
    least = threshold(scored.filter("role = 'calibrate'")).first()["least"]

    of_text = scored.filter("role = 'judge'").select(F.col("u1").alias(h1), F.col("u2").alias(h2), "score")
    rest = seen.filter(F.col(v).isNull()).withColumns(dict(zip((h1, h2), hash_pair(F.col(t))))).drop(t).join(of_text, [h1, h2], "left")
    ruled = seen.filter(F.col(v).isNotNull()).select(*[F.col(f"`{c}`") for c in keep], "host", "path", "rule", F.col(v).alias("verdict"),
                                                     F.lit(None).cast("long").alias("score"))
    return ruled.unionByName(rest.select(*[F.col(f"`{c}`") for c in keep], "host", "path", "rule",
                                         F.when(F.col("score") >= least, "allow").otherwise("block").alias("verdict"), "score"))
