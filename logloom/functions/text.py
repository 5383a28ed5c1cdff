"""Text expressions: masking, hashing, tokens, n-grams, entropy, entities, sanitising."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom import fixed


def contains_any(text: Column, words: list[str]) -> Column:
    """True when the text holds any of the words (case as given)."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def first_contained(text: Column, words: list[str]) -> Column:
    """The first word of the list that the text holds, else null."""
    out = F.when(text.contains(words[0]), words[0])
    for w in words[1:]:
        out = out.when(text.contains(w), w)
    return out


def count_contained(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def first_label(rules: list[tuple[str, list[str]]], default: str, *texts: Column) -> Column:
    """Label of the first rule with a word in any of the texts."""
    def hit(words):
        return reduce(lambda a, b: a | b, [contains_any(t, words) for t in texts])

    out = F.when(hit(rules[0][1]), rules[0][0])
    for label, words in rules[1:]:
        out = out.when(hit(words), label)
    return out.otherwise(default)


def first_group(text: Column, pattern: str, group: int) -> Column:
    """Regex group of the first match, null when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def mask_fast(text: Column) -> Column:
    """Numbers, then hexadecimal runs of 8 or more, become placeholders."""
    numbers = F.regexp_replace(text, r"\b\d+\b", "<NUM>")
    return F.regexp_replace(numbers, r"\b[0-9a-fA-F]{8,}\b", "<HEX>")


def template_hash(service: Column, text: Column) -> Column:
    collapsed = F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")
    return F.xxhash64(F.concat_ws("|", F.lower(service), collapsed))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_message(text: Column) -> Column:
    return F.regexp_replace(collapse_spaces(text), r"(?i)[0-9a-f]{32,}", "[HEX_DATA]")


def word_count(text: Column) -> Column:
    t = collapse_spaces(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def log_tokens(text: Column, keep_placeholders: bool = False) -> Column:
    """Lower-cased identifier tokens. Placeholders are upper case, so the lower-case token
    pattern removes them unless `keep_placeholders` lowers them too."""
    out = F.lower(text)
    for pattern, placeholder in fixed.TOKEN_PLACEHOLDERS:
        out = F.regexp_replace(out, pattern, placeholder.lower() if keep_placeholders else placeholder)
    return F.regexp_extract_all(out, F.lit(fixed.TOKEN_PATTERN), F.lit(0))


def word_ngrams(tokens: Column, low: int = 1, high: int = 2, sep: str = "_") -> Column:
    """All n-grams of the token array for low <= n <= high, shorter ones first. Each step puts the
    next word behind the shorter grams; the place past the end gives null and drops out."""
    grams = {1: tokens}
    for n in range(2, high + 1):
        longer = F.zip_with(grams[n - 1], F.slice(tokens, n, 1_000_000_000), lambda g, w: F.concat(g, F.lit(sep), w))
        grams[n] = F.filter(longer, lambda g: g.isNotNull())
    return F.concat(*[grams[n] for n in range(low, high + 1)])


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Overlapping character n-grams of the lower-cased text: a look-ahead at every character. The
    match itself takes one whole character, so none begins inside a supplementary one."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def char_entropy(text: Column) -> Column:
    """Shannon entropy (bits) of the characters of one text: log2 T - sum(n log2 n) / T. The
    sorted characters are joined back and each run is one symbol."""
    joined = F.array_join(F.sort_array(F.split(text, "")), "")
    runs = F.regexp_extract_all(joined, F.lit(r"(?s)(.)\1*"), F.lit(0))
    weighted = F.aggregate(runs, F.lit(0.0), lambda acc, run: acc + F.length(run) * F.log2(F.length(run)))
    total = F.length(text).cast("double")
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.log2(total) - weighted / total)


def extract_entities(text: Column, limit: int = 10) -> Column:
    """Map entity type -> sorted distinct values, at most `limit` each; absent types left out."""
    entries = []
    for name, (pattern, group) in fixed.ENTITY_PATTERNS.items():
        values = F.slice(F.sort_array(F.array_distinct(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))), 1, limit)
        entries.append(F.struct(F.lit(name).alias("key"), values.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))


def sanitize_question(text: Column) -> Column:
    return collapse_spaces(F.replace(text, F.lit("\x00"), F.lit("")))


def sanitize_service(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\w\-.]", "")


def service_group(name: Column) -> Column:
    """Capitalised part before the first / \\ or -, else Other."""
    head = F.element_at(F.split(name, r"[/\\-]"), 1)
    return F.when(name.rlike(r"[/\\-]"), F.concat(F.upper(F.substring(head, 1, 1)), F.substring(head, 2, 1_000_000))
                  ).otherwise("Other")


def lower_keys(fields: Column) -> Column:
    """The string map with lower-cased keys; the first of equal keys wins."""
    names = F.transform(F.map_keys(fields), lambda k: F.lower(k))
    first = F.filter(F.map_entries(fields), lambda e, i: F.array_position(names, F.lower(e["key"])) == i + 1)
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def first_field(fields: Column, names: list[str], lowered: Column | None = None) -> Column:
    """Value of the first name present in a string map: exact name, then any letter case. Pass
    `lowered` (from lower_keys) when several fields are read from one map."""
    low = lower_keys(fields) if lowered is None else lowered

    def present(m, name):
        return F.when(F.map_contains_key(m, name), F.struct(F.try_element_at(m, F.lit(name)).alias("v")))

    return F.coalesce(*[x for n in names for x in (present(fields, n), present(low, n.lower()))])["v"]


def residual_map(fields: Column, known: list[str]) -> Column:
    names = F.array(*[F.lit(k.lower()) for k in dict.fromkeys(x.lower() for x in known)])
    return F.map_filter(fields, lambda k, v: ~F.array_contains(names, F.lower(k)))


def l2_normalize(vector: Column) -> Column:
    """Unit-length float vector; the zero vector stays as it is."""
    return F.aggregate(
        vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"),
        lambda total: F.when(total > 0, F.transform(vector, lambda x: (x.cast("double") / F.sqrt(total)).cast("float")))
        .otherwise(vector))
