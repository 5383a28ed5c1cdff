"""Severity, category, domain and event labels from names and message words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom import fixed
from logloom.functions.text import contains_any, first_group, first_label


def clamp_severity(level: Column) -> Column:
    return F.least(F.lit(5), F.greatest(F.lit(0), level))


def map_severity(value: Column) -> Column:
    """Severity 0-5 from an integer, numeric text or a level name; 2 when unknown."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    names = F.create_map(*[F.lit(x) for kv in fixed.SEVERITY_LEVELS.items() for x in kv])
    named = F.try_element_at(names, F.lower(text))
    return F.coalesce(F.when(number.isNotNull(), clamp_severity(number)).cast("int"), named, F.lit(fixed.DEFAULT_SEVERITY))


def severity_name(level: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in fixed.SEVERITY_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, level), F.lit("UNKNOWN"))


def model_severity_name(level: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in fixed.MODEL_SEVERITY_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, level), F.lit("INFO"))


def severity_word(text: Column) -> Column:
    """The first level name in the text, else an empty text."""
    return F.regexp_extract(text, "(?i)" + fixed.SEVERITY_WORD, 1)


def severity_of_word(word: Column) -> Column:
    return F.when(word == "", F.lit(fixed.DEFAULT_SEVERITY)).otherwise(map_severity(word))


def severity_from_text(text: Column) -> Column:
    return severity_of_word(severity_word(text))


def keyword_labels(message: Column, source: Column) -> Column:
    """struct(category, domain, severity) by the first rule with a matching word."""
    text, src = F.lower(message), F.lower(source)
    return F.struct(
        first_label(fixed.CATEGORY_WORDS, "normal", text).alias("category"),
        first_label(fixed.DOMAIN_WORDS, "application", text, src).alias("domain"),
        first_label(fixed.LABEL_SEVERITY_WORDS, "info", text).alias("severity"),
    )


def infer_domain_from_text(message: Column) -> Column:
    return first_label(fixed.TEXT_DOMAIN_WORDS, "application", F.lower(message))


def infer_domain_from_service(service: Column) -> Column:
    rules = [(domain, [name.lower()]) for name, domain in fixed.DATASET_DOMAINS.items()]
    return first_label(rules, "application", F.lower(service))


def infer_severity(message: Column) -> Column:
    return first_label(fixed.MESSAGE_SEVERITY_WORDS, "INFO", F.lower(message))


def category_from_severity(severity_label: Column, message: Column) -> Column:
    sev, text = F.lower(severity_label), F.lower(message)
    return (F.when(sev.isin("critical", "error"), "error")
            .when(sev == "warning", "warning")
            .when(contains_any(text, ["security", "attack"]), "security")
            .otherwise("normal"))


def event_signature(message: Column, source: Column) -> Column:
    kind = first_label(fixed.EVENT_SIGNATURES, "OTHER", F.lower(message))
    tail = F.nullif(F.upper(F.substring(source, 1, 10)), F.lit(""))
    return F.concat_ws("_", kind, tail)


def extract_source(message: Column, source: Column) -> Column:
    """IP in the message, else the source column, else the user named in the message."""
    user = first_group(message, fixed.USER_PATTERN, 1)
    return F.coalesce(first_group(message, fixed.IP_PATTERN, 0), F.nullif(source, F.lit("")),
                      F.concat(F.lit("user:"), user))


def extract_target(message: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("path:"), first_group(message, fixed.PATH_PATTERN, 1)),
        F.concat(F.lit("port:"), first_group(message, fixed.PORT_PATTERN, 1)),
        F.concat(F.lit("user:"), first_group(message, fixed.USER_PATTERN, 1)),
    )


def is_auth_failure(message: Column) -> Column:
    return contains_any(F.lower(message), fixed.AUTH_FAILURE_WORDS)
