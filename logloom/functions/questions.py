"""Expressions over a table of natural-language questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import fixed
from logloom.functions.text import contains_any


def _literals(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def is_search_question(question: Column) -> Column:
    return contains_any(F.lower(question), fixed.SEARCH_INDICATORS)


def service_filter(question: Column) -> Column:
    """A service named in the question: known alias, else the first captured word that is at
    least 3 letters and not a common word; null when none."""
    low = F.lower(question)
    alias = F.when(F.lit(False), F.lit(None).cast("string"))
    for phrase, name in fixed.SERVICE_ALIASES:
        alias = alias.when(low.contains(phrase), name)
    found = F.concat(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in fixed.SERVICE_MENTIONS])
    usable = F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*fixed.NOT_A_SERVICE))
    return F.coalesce(alias, F.try_element_at(usable, F.lit(1)))


def search_terms(question: Column, limit: int = 5) -> Column:
    """Sorted distinct search terms, at most `limit`: phrase table, else captured words and
    keywords, else the first three longer words."""
    low = F.trim(F.lower(question))
    mapped = F.when(F.lit(False), F.lit(None).cast("array<string>"))
    for phrase, terms in fixed.SEARCH_PHRASES:
        mapped = mapped.when(low.contains(phrase), _literals(terms))

    captured = F.flatten(F.transform(
        F.concat(*[F.regexp_extract_all(low, F.lit("(?i)" + p), F.lit(1)) for p in fixed.SEARCH_MENTIONS]),
        lambda m: F.split(F.trim(m), r"\s+")))
    words = F.filter(captured, lambda w: (F.length(w) > 2) & ~w.isin(*fixed.MENTION_STOP_WORDS))
    keywords = F.filter(_literals(fixed.SEARCH_KEYWORDS), lambda k: F.contains(low, k))
    direct = F.concat(words, keywords)
    nouns = F.slice(F.filter(F.regexp_extract_all(low, F.lit(r"\b[a-z]{4,}\b"), F.lit(0)),
                             lambda w: ~w.isin(*fixed.NOUN_STOP_WORDS)), 1, 3)
    chosen = F.coalesce(mapped, F.when(F.size(direct) > 0, direct), nouns)
    return F.slice(F.sort_array(F.array_distinct(chosen)), 1, limit)


def tag_questions(df: DataFrame, text: str = "text") -> DataFrame:
    q = F.col(text)
    return (df.withColumn("is_search", is_search_question(q))
            .withColumn("service_filter", service_filter(q))
            .withColumn("search_terms", search_terms(q)))


def score_domains(df: DataFrame, text: Column) -> DataFrame:
    """Adds `domains`, an array of struct(domain, score) by falling score; the default is
    application 0.5. The rule table is a fixed literal, so no join is needed. Each step is a
    column of its own, so that it is computed once per row."""
    names = list(fixed.DOMAIN_KEYWORDS)
    hits = F.array(*[sum((F.col("_low").contains(w.lower()).cast("int") for w in words), F.lit(0))
                     for words in fixed.DOMAIN_KEYWORDS.values()])
    sizes = _literals([float(len(w)) for w in fixed.DOMAIN_KEYWORDS.values()])
    entries = F.transform(F.arrays_zip(F.col("_hits").alias("h"), sizes.alias("n"), _literals(names).alias("d")),
                          lambda e, i: F.struct((-(e["h"] / e["n"]) * (1 + 0.1 * e["h"])).alias("rank"),
                                                i.alias("position"), e["d"].alias("domain")))
    kept = F.sort_array(F.filter(entries, lambda e: e["rank"] < 0))
    named = F.transform(F.col("_kept"), lambda e: F.struct(e["domain"].alias("domain"), (-e["rank"]).alias("score")))
    default = F.array(F.struct(F.lit("application").alias("domain"), F.lit(0.5).alias("score")))
    return (df.withColumn("_low", F.lower(text)).withColumn("_hits", hits).withColumn("_kept", kept)
            .withColumn("domains", F.when(F.size("_kept") > 0, named).otherwise(default))
            .drop("_low", "_hits", "_kept"))


def rank_examples(df: DataFrame, question: str, n: int = 3) -> DataFrame:
    """Adds `examples`, the best `n` struct(example, score) of the fixed examples. Needs the
    `domains` column of score_domains."""
    types = F.array(*[contains_any(F.col("_low"), words).cast("int") for _, words in fixed.QUESTION_TYPES])
    entries = []
    for order, (name, source, applicable, text) in enumerate(fixed.EXAMPLES):
        own = [i for i, (_, words) in enumerate(fixed.QUESTION_TYPES) if any(w in text.lower() for w in words)]
        shared = sum((F.col("_types")[i] for i in own), F.lit(0))
        weighted = sum((F.coalesce(F.try_element_at("_scores", F.lit(d)), F.lit(0.0)) * 2 for d in applicable), F.lit(0.0))
        entries.append(F.struct((F.when(F.col("_primary") == source, 3.0).otherwise(0.0) + weighted + shared).alias("score"),
                                F.lit(order).alias("position"), F.lit(name).alias("example")))
    ranked = F.sort_array(F.transform(F.filter(F.array(*entries), lambda e: e["score"] > 0), lambda e: F.struct(
        (-F.round(e["score"], 9)).alias("rank"), e["position"].alias("position"), e["example"].alias("example"),
        e["score"].alias("score"))))
    return (df.withColumn("_low", F.lower(F.col(question))).withColumn("_types", types)
            .withColumn("_primary", F.element_at("domains", 1)["domain"])
            .withColumn("_scores", F.map_from_entries("domains"))
            .withColumn("_ranked", F.slice(ranked, 1, n))
            .withColumn("examples", F.transform("_ranked", lambda e: F.struct(
                e["example"].alias("example"), e["score"].alias("score"))))
            .drop("_low", "_types", "_primary", "_scores", "_ranked"))


def transfer_rules(df: DataFrame) -> DataFrame:
    """Adds `rules`, the transfer patterns whose source or target domain was detected, or whose
    target is all."""
    names = F.transform(F.col("domains"), lambda d: d["domain"])
    picks = []
    for _, source, target, pattern in fixed.TRANSFER_RULES:
        hit = F.lit(target == "all") | F.array_contains(names, source) | F.array_contains(names, target)
        picks.append(F.when(hit, F.lit(pattern)))
    return df.withColumn("rules", F.array_compact(F.array(*picks)))
