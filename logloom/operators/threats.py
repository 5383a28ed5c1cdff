"""Threat detection: sequences, brute force, injection, reconnaissance, and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import fixed
from logloom.functions.labels import event_signature, extract_source, extract_target, is_auth_failure
from logloom.functions.text import char_entropy, char_ngrams, contains_any
from logloom.injection_rules import INJECTION_RULES
from logloom.scale import bucket_of, lagged, positions, top_n, trailing_distinct, trailing_sums

SECOND = 1_000_000  # event times are ordered as microseconds
UNSEEN = 0.01


def _micros() -> Column:
    return F.unix_micros("timestamp_utc")


SLOT = 10 * SECOND  # ordered work is cut into slots of ten seconds


def _slot() -> Column:
    return bucket_of(_micros(), SLOT)


# --- sequences --------------------------------------------------------------------------
def transitions(logs: DataFrame, key: str = "service_name", order: int = 2) -> DataFrame:
    """key, state, next, n: how often `next` followed the `order` events of `state`."""
    rows = logs.select(F.col(key).alias("key"), "timestamp_utc", "id",
                       event_signature(F.col("body_raw"), F.col("service_name")).alias("sig"))
    seq = lagged(rows, ["key"], ["timestamp_utc", "id"], _slot(), F.col("sig"), order)
    full = seq.filter(F.col(f"prev_{order}").isNotNull())
    state = F.concat_ws("|", *[F.col(f"prev_{i}") for i in range(order, 0, -1)])
    return full.groupBy("key", state.alias("state"), F.col("sig").alias("next")).agg(F.count(F.lit(1)).alias("n"))


def markov_fit(normal: DataFrame, attack: DataFrame, key: str = "service_name", order: int = 2) -> DataFrame:
    """kind, state, next, n, total, distinct_next for the normal and the attack rows."""
    def table(rows, kind):
        t = transitions(rows, key, order).groupBy("state", "next").agg(F.sum("n").alias("n"))
        s = t.groupBy("state").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_next"))
        return t.join(s, "state").select(F.lit(kind).alias("kind"), "state", "next", "n", "total", "distinct_next")

    return table(normal, "normal").unionByName(table(attack, "attack"))


def markov_score(logs: DataFrame, model: DataFrame, key: str = "service_name", order: int = 2) -> DataFrame:
    """key, transitions, score in [0, 1] per key; 0.5 for keys too short to score. Repeated
    transitions are counted once before the model join."""
    seen = transitions(logs, key, order)
    for kind in ("normal", "attack"):
        m = model.filter(F.col("kind") == kind)
        pair = m.select("state", "next", F.col("n").alias(f"{kind}_n"))
        state = m.select("state", (F.col("total") + F.col("distinct_next")).alias(f"{kind}_t")).distinct()
        seen = seen.join(pair, ["state", "next"], "left").join(state, "state", "left")

    def log_p(kind):
        return F.when(F.col(f"{kind}_t").isNotNull(), F.log((F.coalesce(F.col(f"{kind}_n"), F.lit(0)) + 1) / F.col(f"{kind}_t"))
                      ).otherwise(F.log(F.lit(UNSEEN)))

    diff = F.sum(F.col("n") * (log_p("attack") - log_p("normal")))
    scored = seen.groupBy("key").agg(F.sum("n").alias("transitions"), diff.alias("_d"))
    keys = logs.select(F.col(key).alias("key")).distinct()
    return keys.join(scored, "key", "left").select(
        "key", F.coalesce("transitions", F.lit(0)).alias("transitions"),
        F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.col("_d") / 10)), F.lit(0.5)).alias("score"))


# --- brute force ------------------------------------------------------------------------
def auth_failures(logs: DataFrame) -> DataFrame:
    body = F.col("body_raw")
    return (logs.filter(is_auth_failure(body)).withColumn("source", extract_source(body, F.col("service_name")))
            .filter(F.col("source").isNotNull()).withColumn("at", _micros()))


def bruteforce_fit(logs: DataFrame, window: int = 300, baseline: str = "window") -> DataFrame:
    """One row: mean and standard deviation (+0.1) of failures per source, per window of the
    source (`window`) or over all time (`total`)."""
    keys = ["source"] if baseline == "total" else ["source", bucket_of(F.col("at"), window * SECOND).alias("w")]
    counts = auth_failures(logs).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.avg("n").alias("baseline_rate"), (F.stddev_pop("n") + 0.1).alias("baseline_std"))


def bruteforce_ticks(logs: DataFrame, baseline: DataFrame | None, window: int = 300, multiplier: float = 3.0) -> DataFrame:
    """source, at, failure_count, z_score, is_brute_force, threat_score per source and instant."""
    ticks = trailing_sums(auth_failures(logs).select("source", "at", F.lit(1).alias("failure_count")),
                          ["source"], "at", ["failure_count"], window * SECOND, SLOT)
    if baseline is None:
        scored = ticks.withColumn("z_score", F.col("failure_count") / 5.0).withColumn(
            "is_brute_force", F.col("failure_count") > 5)
    else:
        one = F.broadcast(baseline.withColumn("_k", F.lit(1)))  # a single row
        scored = (ticks.withColumn("_k", F.lit(1)).join(one, "_k").drop("_k")
                  .withColumn("z_score", (F.col("failure_count") - F.col("baseline_rate")) / F.col("baseline_std"))
                  .withColumn("is_brute_force", F.col("z_score") > multiplier).drop("baseline_rate", "baseline_std"))
    return scored.withColumn("threat_score", F.least(F.lit(1.0), F.col("z_score") / (2 * multiplier)))


def bruteforce_detect(logs: DataFrame, baseline: DataFrame | None = None, window: int = 300,
                      multiplier: float = 3.0) -> DataFrame:
    """Each authentication failure with the failures of its source in the trailing window."""
    ticks = bruteforce_ticks(logs, baseline, window, multiplier)
    return auth_failures(logs).join(ticks, ["source", "at"]).drop("at")


def active_sources(logs: DataFrame, window: int = 300) -> DataFrame:
    """Sources with a failure in the window that ends at the last failure of all, by count."""
    fails = auth_failures(logs)
    end = F.broadcast(fails.agg(F.max("at").alias("_end")).withColumn("_k", F.lit(1)))  # a single row
    recent = fails.withColumn("_k", F.lit(1)).join(end, "_k").filter(F.col("at") >= F.col("_end") - window * SECOND)
    return (recent.groupBy("source").agg(F.count(F.lit(1)).alias("failure_count"),
                                         F.min("timestamp_utc").alias("first_failure"),
                                         F.max("timestamp_utc").alias("last_failure"))
            .orderBy(F.col("failure_count").desc(), "source"))


# --- injection --------------------------------------------------------------------------
def injection_fit(bad: DataFrame, good: DataFrame, text: str = "body_raw") -> tuple[DataFrame, DataFrame]:
    """(ngram, score): log odds of character 3-grams, and one row with the entropy threshold
    mean + 2 standard deviations of the good texts."""
    def counts(df, name):
        grams = df.select(F.explode_outer(char_ngrams(F.col(text))).alias("ngram")).filter("ngram IS NOT NULL")
        return grams.groupBy("ngram").agg(F.count(F.lit(1)).alias(name))

    both = counts(bad, "_m").join(counts(good, "_b"), "ngram", "full")
    odds = both.select("ngram", F.log((F.coalesce("_m", F.lit(0)) + 1) / (F.coalesce("_b", F.lit(0)) + 1)).alias("score"))
    h = good.select(char_entropy(F.col(text)).alias("h"))
    return odds, h.agg((F.avg("h") + 2 * F.stddev_pop("h")).alias("entropy_threshold"))


def needed_literal(pattern: str) -> str:
    """The longest run of plain characters, in lower case, that every match of a pattern holds; empty if none is certain."""
    runs, run, i = [""], "", 0
    while i < len(pattern):
        c, step = pattern[i], 1
        if c == "\\":
            e, step = pattern[i + 1:i + 2], 2
            if e in "rnt":
                run += {"r": "\r", "n": "\n", "t": "\t"}[e]
            elif e and e in "swdSWDbB":
                runs, run = [*runs, run], ""
            elif e.isalnum() or not e:
                return ""
            else:
                run += e
        elif c == "|":
            return ""
        elif c in "*?{":  # the last character may be missing
            runs, run = [*runs, run[:-1]], ""
            step = pattern.index("}", i) - i + 1 if c == "{" else 1
        elif c in "([":  # leave out the whole group or class
            runs, run, depth, j = [*runs, run], "", 0, i
            while j < len(pattern):
                if pattern[j] == "\\":
                    j += 1
                elif c == "[" and pattern[j] == "]" and j > i + 1 and pattern[i + 1:j] != "^":
                    break
                elif c == "(" and pattern[j] == "[":
                    return ""
                elif c == "(" and pattern[j] in "()":
                    depth += 1 if pattern[j] == "(" else -1
                    if not depth:
                        break
                j += 1
            step = j - i + 1
        elif c in ".^$+":
            runs, run = [*runs, run], ""
        else:
            run += c
        i += step
    found = max([*runs, run], key=len)
    return found.lower() if found.isascii() else ""


def matched_rules(text: Column, rules: dict[str, list[str]] | None = None, strict: bool = False, low: Column | None = None) -> Column:
    """array<array<string>>: the patterns that match, per attack type in rule order. A pattern is tried only on texts that
    hold its needed literal in lower case. `strict` lower-cases the text and keeps the case of the patterns; `low` is
    the lower-cased text where a column has it."""
    low = F.lower(text) if low is None else low
    target, flag = (low, "") if strict else (text, "(?i)")

    def hit(pattern: str) -> Column:
        literal = needed_literal(pattern)
        return low.contains(literal) & target.rlike(flag + pattern) if literal else target.rlike(flag + pattern)

    return F.array(*[F.array_compact(F.array(*[F.when(hit(p), F.lit(p)) for p in patterns])) for patterns in (rules or INJECTION_RULES).values()])


def ngram_scores(df: DataFrame, text: str, model: DataFrame) -> DataFrame:
    """(_h1, _h2, ngram_score) per distinct text: the sum of the scores of its 3-grams. Equal texts
    are counted once, and n-grams of a text are counted before the model is joined."""
    texts = df.select(F.col(text).alias("_t")).filter("_t IS NOT NULL").distinct()
    keyed = texts.select(*text_key(F.col("_t")), F.explode(char_ngrams(F.col("_t"))).alias("ngram"))
    counted = keyed.groupBy("_h1", "_h2", "ngram").agg(F.count(F.lit(1)).alias("_n"))
    return counted.join(model, "ngram").groupBy("_h1", "_h2").agg(F.sum(F.col("_n") * F.col("score")).alias("ngram_score"))


def text_key(text: Column) -> list[Column]:
    """Two independent hashes that stand for a text in joins."""
    return [F.xxhash64(F.lit(1), text).alias("_h1"), F.xxhash64(F.lit(2), text).alias("_h2")]


def with_injection(df: DataFrame, text: str, model: DataFrame | None = None,
                   entropy_threshold: float | DataFrame = 4.5, rules: dict[str, list[str]] | None = None,
                   strict: bool = False) -> DataFrame:
    """Adds matched, pattern_count, attack_type, ngram_score, entropy, high_entropy, is_injection
    and injection_score. `model` is the (ngram, score) table; without it the n-gram score is 0."""
    types = list(rules or INJECTION_RULES)
    out = df.withColumn("_low", F.lower(F.col(text)))
    out = out.withColumn("matched", matched_rules(F.col(text), rules, strict, F.col("_low"))).drop("_low")
    out = out.withColumn("_sizes", F.transform("matched", lambda m: F.size(m)))
    out = out.withColumn("pattern_count", F.aggregate("_sizes", F.lit(0), lambda a, n: a + n))
    names = F.array(*[F.lit(x) for x in types])
    best = F.array_position("_sizes", F.array_max("_sizes")).cast("int")
    out = out.withColumn("attack_type", F.when(F.col("pattern_count") > 0, F.element_at(names, best)).otherwise("unknown"))
    out = out.withColumn("entropy", char_entropy(F.col(text))).drop("_sizes")
    if isinstance(entropy_threshold, DataFrame):
        one = F.broadcast(entropy_threshold.withColumn("_k", F.lit(1)))  # a single row
        out = out.withColumn("_k", F.lit(1)).join(one, "_k").drop("_k")
    else:
        out = out.withColumn("entropy_threshold", F.lit(float(entropy_threshold)))
    if model is None:
        out = out.withColumn("ngram_score", F.lit(0.0))
    else:
        scores = ngram_scores(df, text, model)
        out = out.withColumns(dict(zip(("_h1", "_h2"), text_key(F.col(text))))).join(scores, ["_h1", "_h2"], "left")
        out = out.withColumn("ngram_score", F.coalesce("ngram_score", F.lit(0.0))).drop("_h1", "_h2")
    over = F.col("entropy") - F.col("entropy_threshold")
    score = (F.when(F.col("pattern_count") > 0, 0.4 * F.least(F.col("pattern_count"), F.lit(3)) / 3).otherwise(0.0)
             + F.when(F.col("ngram_score") > 0, 0.3 * F.least(F.col("ngram_score") / 5.0, F.lit(1.0))).otherwise(0.0)
             + F.when(over > 0, 0.3 * F.least(over / 2.0, F.lit(1.0))).otherwise(0.0))
    return (out.withColumn("high_entropy", over > 0)
            .withColumn("is_injection", (F.col("pattern_count") > 0) | (F.col("ngram_score") > 2.0) | F.col("high_entropy"))
            .withColumn("injection_score", F.least(score, F.lit(1.0))).drop("entropy_threshold"))


# --- reconnaissance ---------------------------------------------------------------------
def target_accesses(logs: DataFrame) -> DataFrame:
    body = F.col("body_raw")
    source = F.coalesce(F.nullif(F.regexp_extract(body, fixed.IP_PATTERN, 0), F.lit("")), F.col("service_name"))
    return (logs.withColumn("source", source).withColumn("target", extract_target(body))
            .withColumn("at", _micros()).filter(F.col("source").isNotNull() & F.col("target").isNotNull()))


def recon_ticks(logs: DataFrame, window: int = 60, diversity: int = 10) -> DataFrame:
    """source, at, unique_targets, is_recon, recon_type, threat_score per source and instant."""
    kinds = {k: F.col("target").startswith(k + ":") for k in ("port", "path", "user")}
    ticks = trailing_distinct(target_accesses(logs).select("source", "target", "at"), ["source"], "target", "at",
                              window * SECOND, SLOT, kinds)
    is_recon = F.col("distinct_items") >= diversity
    kind = (F.when(~is_recon, "unknown").when(F.col("port") > 3, "port_scan").when(F.col("path") > 5, "directory_enum")
            .when(F.col("user") > 3, "user_enum").otherwise("general_scan"))
    return ticks.select("source", "at", F.col("distinct_items").alias("unique_targets"), is_recon.alias("is_recon"),
                        kind.alias("recon_type"),
                        F.least(F.col("distinct_items") / (2.0 * diversity), F.lit(1.0)).alias("threat_score"))


def recon_detect(logs: DataFrame, window: int = 60, diversity: int = 10) -> DataFrame:
    """Each access with the distinct targets its source touched in the trailing window."""
    return target_accesses(logs).join(recon_ticks(logs, window, diversity), ["source", "at"]).drop("at")


def recon_target_samples(logs: DataFrame, window: int = 60, diversity: int = 10, n: int = 10) -> DataFrame:
    """source, targets: n targets of the window behind the first detection of each source."""
    first = recon_ticks(logs, window, diversity).filter("is_recon").groupBy("source").agg(F.min("at").alias("_first"))
    seen = (target_accesses(logs).select("source", "target", "at").join(first, "source")
            .filter((F.col("at") <= F.col("_first")) & (F.col("at") >= F.col("_first") - window * SECOND))
            .select("source", "target").distinct())
    return top_n(seen, ["source"], [F.col("target")], n).groupBy("source").agg(
        F.sort_array(F.collect_list("target")).alias("targets"))


# --- fusion -----------------------------------------------------------------------------
def detect_threats(logs: DataFrame, baseline: DataFrame | None = None, markov: DataFrame | None = None,
                   ngrams: DataFrame | None = None, entropy_threshold: float | DataFrame = 4.5,
                   brute_window: int = 300, recon_window: int = 60, sequence_key: str = "service_name",
                   strict: bool = False) -> DataFrame:
    """Every log row with is_threat, threat_score, threat_type, severity level, confidence and
    indicators. A sequence without a model, or of 3 rows or fewer, adds 0 (0.5 with `strict`
    and no model)."""
    rows = with_injection(logs, "body_raw", ngrams, entropy_threshold, strict=strict)
    body = F.col("body_raw")
    rows = (rows.withColumn("_at", _micros())
            .withColumn("_fs", F.when(is_auth_failure(body), extract_source(body, F.col("service_name"))))
            .withColumn("_rs", F.when(extract_target(body).isNotNull(), F.coalesce(
                F.nullif(F.regexp_extract(body, fixed.IP_PATTERN, 0), F.lit("")), F.col("service_name")))))
    brute = bruteforce_ticks(logs, baseline, brute_window).select(
        F.col("source").alias("_fs"), F.col("at").alias("_at"), "failure_count", "is_brute_force",
        F.col("threat_score").alias("brute_score"))
    recon = recon_ticks(logs, recon_window).select(
        F.col("source").alias("_rs"), F.col("at").alias("_at"), "unique_targets", "is_recon", "recon_type",
        F.col("threat_score").alias("recon_score"))
    rows = rows.join(brute, ["_fs", "_at"], "left").join(recon, ["_rs", "_at"], "left")
    if markov is None:
        rows = rows.withColumn("sequence_score", F.lit(0.5 if strict else 0.0))
    else:
        scores = markov_score(logs, markov, sequence_key).select(
            F.col("key").alias(sequence_key), F.when(F.col("transitions") > 1, F.col("score")).otherwise(0.0)
            .alias("sequence_score"))
        rows = rows.join(scores, sequence_key, "left").withColumn(
            "sequence_score", F.coalesce("sequence_score", F.lit(0.0)))

    brute_hit = F.coalesce(F.col("is_brute_force"), F.lit(False))
    recon_hit = F.coalesce(F.col("is_recon"), F.lit(False))
    injected, seq = F.col("is_injection"), F.col("sequence_score")
    zero = F.lit(0.0)
    rule = F.greatest(F.coalesce("brute_score", zero), F.col("injection_score"), F.coalesce("recon_score", zero))
    rows = rows.withColumn("_rule", rule).withColumn("threat_score", F.greatest(F.col("_rule"), seq, zero))
    score = F.col("threat_score")
    return (rows.withColumn("is_threat", (injected & (F.col("_rule") > 0.1)) | (brute_hit & (F.col("_rule") > 0.3))
                            | (recon_hit & (F.col("_rule") > 0.3)) | (seq > 0.70))
            .withColumn("threat_type", F.when(brute_hit, "brute_force").when(injected, F.col("attack_type"))
                        .when(recon_hit, F.col("recon_type")).when(seq > 0.75, "attack_pattern").otherwise("none"))
            .withColumn("threat_level", F.when(score > 0.8, "critical").when(score > 0.6, "high")
                        .when(score > 0.4, "medium").when(score > 0.2, "low").otherwise("none"))
            .withColumn("threat_confidence", F.lit(0.8 if baseline is not None or markov is not None else 0.5))
            .withColumn("indicators", F.array_compact(F.array(
                F.when(brute_hit, "brute_force"), F.when(F.col("pattern_count") > 0, "injection"),
                F.when(recon_hit, "reconnaissance"))))
            .drop("_rule", "_at", "_fs", "_rs"))


def threat_actions(df: DataFrame, limit: int = 5) -> DataFrame:
    """Adds `actions`: the urgent code above 0.8, then the codes of the threat type."""
    kind = F.col("threat_type")

    def codes(name):
        return F.array(*[F.lit(a) for a in fixed.THREAT_ACTIONS[name]])

    own = (F.when(kind == "brute_force", codes("brute_force"))
           .when(kind.isin(*fixed.INJECTION_ACTION_TYPES), codes("injection"))
           .when(kind.isin(*fixed.RECON_ACTION_TYPES), codes("reconnaissance"))
           .when(kind == "attack_pattern", codes("attack_pattern")).otherwise(F.array().cast("array<string>")))
    urgent = F.when(F.col("threat_score") > 0.8, F.array(F.lit(fixed.URGENT_ACTION))).otherwise(
        F.array().cast("array<string>"))
    return df.withColumn("actions", F.slice(F.concat(urgent, own), 1, limit))


def threat_training_sets(logs: DataFrame) -> dict[str, DataFrame]:
    """Training rows without labels: attack and normal by word, authentication rows, and the
    first tenth of the rows in time order as malicious texts, the rest as good ones."""
    low = F.lower("body_raw")
    attack = contains_any(low, fixed.ATTACK_WORDS)
    placed = positions(logs, [], ["timestamp_utc", "id"], _slot(), "_pos", "_all")
    cut = F.floor(F.col("_all") / 10)
    return {
        "attack": logs.filter(attack), "normal": logs.filter(~attack),
        "auth": logs.filter(contains_any(low, fixed.AUTH_WORDS)),
        "malicious": placed.filter(F.col("_pos") <= cut).drop("_pos", "_all"),
        "benign": placed.filter(F.col("_pos") > cut).drop("_pos", "_all"),
    }
