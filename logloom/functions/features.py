"""Numeric feature columns of one message. Each function returns (name, Column) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import fixed
from logloom.functions.text import clean_message, contains_any, word_count


def _flag(cond: Column) -> Column:
    return cond.cast("int").cast("double")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def derive_features(df: DataFrame, message: str = "message", severity: str = "severity") -> DataFrame:
    """Cleaned message, length, words, error and security flags, severity limited to 5 names."""
    text = F.lower(F.col(message))
    upper = F.upper(F.coalesce(F.col(severity), F.lit("INFO")))
    allowed = upper.isin("CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG")
    return (df.withColumn(message, clean_message(F.col(message)))
            .withColumn(severity, F.when(allowed, upper).otherwise("INFO"))
            .withColumn("message_length", F.length(F.col(message)))
            .withColumn("word_count", word_count(F.col(message)))
            .withColumn("has_error_keywords", contains_any(text, fixed.ERROR_WORDS))
            .withColumn("has_security_keywords", contains_any(text, fixed.SECURITY_WORDS)))


def message_features(message: Column, severity: Column) -> list[tuple[str, Column]]:
    """12 features; `severity` is a level name."""
    text, sev = F.lower(message), F.upper(severity)
    level = (F.when(sev == "DEBUG", 0).when(sev == "INFO", 1).when(sev == "WARNING", 2)
             .when(sev == "ERROR", 3).when(sev.isin("CRITICAL", "FATAL"), 4).otherwise(1))
    digits = _count(message, r"\d")
    return [
        ("length", F.length(message)),
        ("words", word_count(message)),
        ("severity_level", level),
        ("open_brackets", _count(message, r"\[")),
        ("close_brackets", _count(message, r"\]")),
        ("colons", _count(message, ":")),
        ("equals", _count(message, "=")),
        ("has_error", _flag(text.contains("error"))),
        ("has_failed", _flag(text.contains("failed"))),
        ("has_exception", _flag(text.contains("exception"))),
        ("has_warning", _flag(text.contains("warning"))),
        ("numeric_ratio", digits / F.greatest(F.length(message), F.lit(1))),
    ]


def threat_features(message: Column, severity: Column) -> list[tuple[str, Column]]:
    """13 features; `severity` is a level name."""
    text, sev = F.lower(message), F.upper(severity)
    return [
        ("length", F.length(message)),
        ("single_quotes", _count(message, "'")),
        ("double_quotes", _count(message, '"')),
        ("semicolons", _count(message, ";")),
        ("double_dashes", _count(message, "--")),
        ("less_than", _count(message, "<")),
        ("greater_than", _count(message, ">")),
        ("is_error", _flag(sev.isin("ERROR", "CRITICAL"))),
        ("is_warning", _flag(sev == "WARNING")),
        ("has_failure", _flag(contains_any(text, ["failed", "error", "denied"]))),
        ("has_sql", _flag(contains_any(text, ["select", "union", "drop", "insert"]))),
        ("has_script", _flag(contains_any(text, ["script", "alert", "onerror"]))),
        ("has_scan", _flag(contains_any(text, ["scan", "probe", "enum"]))),
    ]


def behaviour_features(message: Column) -> list[tuple[str, Column]]:
    """14 behavioural counts of the lower-cased message, with caps."""
    t = F.lower(message)

    def capped(pattern, cap):
        return F.least(_count(t, pattern), F.lit(cap))

    special = _count(t, r"""[<>'";=|&$`\\]""")
    longest = F.array_max(F.transform(F.split(t, r"\s+"), lambda w: F.length(w)))
    cols = [
        _count(t, r"\b4\d{2}\b"),
        _count(t, r"\b5\d{2}\b"),
        _count(t, r"\.\./") + _count(t, "%2e%2e"),
        _count(t, r"/(?:etc|bin|tmp|var|usr|proc)/"),
        _count(t, r"\.(php|sh|pl|py|rb|cgi|asp)\b"),
        capped(r"%[0-9a-fA-F]{2}", 20),
        F.least(special / F.greatest(F.length(t), F.lit(1)) * 100, F.lit(50.0)),
        capped(r"\b\d{4,}\b", 10),
        capped(r"[A-Za-z0-9+/]{20,}={0,2}", 5),
        capped(r"(?:0x[0-9a-fA-F]+|\\x[0-9a-fA-F]{2})", 10),
        capped(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 5),
        capped(r"[|><`$()]", 20),
        F.least(longest, F.lit(200)),
        t.rlike("user|login|auth|pass|session|token").cast("int"),
    ]
    return list(zip(fixed.BEHAVIOUR_FEATURES, [c.cast("double") for c in cols]))


def with_columns(df: DataFrame, pairs: list[tuple[str, Column]]) -> DataFrame:
    return df.withColumns({name: col for name, col in pairs})
