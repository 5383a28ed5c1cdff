"""Registered queries: row expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom import fixed
from logloom.functions import features, labels, questions, text, times
from logloom.plans.logview import ISO_SQL, more, ts_text, with_logs
from logloom.plans.registry import query
from logloom.sources.files import format_of, service_from_path


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {sql_text(w)})" for w in words) + ")"


def sql_case(rules, default: str, *columns: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(sql_any(c, words) for c in columns) + f" THEN '{label}'"
                     for label, words in rules)
    return f"CASE {whens} ELSE '{default}' END"


# One line per event, its time written in one of eight forms.
STAMPED = """CASE id % 9 WHEN 0 THEN strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(timestamp_utc, '[%d/%b/%Y:%H:%M:%S +0000]')
 WHEN 2 THEN strftime(timestamp_utc, '%b %d %H:%M:%S') WHEN 3 THEN strftime(timestamp_utc, '%d/%b/%Y:%H:%M:%S')
 WHEN 4 THEN strftime(timestamp_utc, '%Y-%m-%d %H:%M:%S') WHEN 5 THEN strftime(timestamp_utc, '%m/%d/%Y %H:%M:%S')
 WHEN 6 THEN strftime(timestamp_utc, '%Y-%m-%d %H:%M:%S.%g') WHEN 7 THEN strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S+02:00')
 ELSE 'no time' END"""


def stamped(t):
    ts, k = F.col("timestamp_utc"), F.col("id") % 9
    def f(fmt):
        return F.date_format(ts, fmt)
    return t.logs.withColumn("stamp", F.when(k == 0, f("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 1, f("'['dd/MMM/yyyy:HH:mm:ss +0000']'")).when(k == 2, f("MMM dd HH:mm:ss"))
        .when(k == 3, f("dd/MMM/yyyy:HH:mm:ss")).when(k == 4, f("yyyy-MM-dd HH:mm:ss"))
        .when(k == 5, f("MM/dd/yyyy HH:mm:ss")).when(k == 6, f("yyyy-MM-dd HH:mm:ss.SSS"))
        .when(k == 7, f("yyyy-MM-dd'T'HH:mm:ss+02:00")).otherwise("no time"))


@query("extract_timestamp", more(f"s AS (SELECT id, body_raw, {STAMPED} AS stamp FROM logs)") + """
SELECT id, CASE WHEN id % 9 = 8 THEN NULL ELSE stamp END AS ts_str,
       CASE WHEN id % 9 = 8 THEN concat('no time ', body_raw) ELSE body_raw END AS rest FROM s""")
def _(t):
    return stamped(t).select("id", times.extract_ts(F.concat_ws(" ", "stamp", "body_raw")).alias("e")).select(
        "id", "e.ts_str", "e.rest")


@query("parse_timestamp", with_logs(f"""
SELECT id, strftime(CASE id % 9 WHEN 8 THEN NULL WHEN 6 THEN date_trunc('millisecond', timestamp_utc)
   WHEN 7 THEN date_trunc('second', timestamp_utc) - INTERVAL 2 HOUR
   ELSE date_trunc('second', timestamp_utc) END, {ISO_SQL}) AS parsed FROM logs"""))
def _(t):
    return stamped(t).select("id", ts_text(times.parse_ts(F.col("stamp"), default_year=2024)).alias("parsed"))


@query("parse_epoch", with_logs(f"""
SELECT id, strftime(CASE WHEN id % 2 = 0 THEN date_trunc('second', timestamp_utc)
   ELSE date_trunc('millisecond', timestamp_utc) END, {ISO_SQL}) AS parsed FROM logs"""))
def _(t):
    sec, ms = F.unix_seconds("timestamp_utc"), F.unix_millis("timestamp_utc")
    stamp = F.when(F.col("id") % 2 == 0, sec.cast("string")).otherwise(ms.cast("string"))
    return t.logs.select("id", ts_text(times.parse_ts(stamp)).alias("parsed"))


@query("utc_iso_text", with_logs("SELECT id, strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM logs"))
def _(t):
    return t.logs.select("id", times.to_utc_iso(F.col("timestamp_utc")).alias("iso"))


@query("time_range", with_logs("""
SELECT '7d' AS preset, count(*) AS n FROM logs WHERE timestamp_utc BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-15'
UNION ALL SELECT '1h', count(*) FROM logs WHERE timestamp_utc BETWEEN TIMESTAMP '2024-01-14 23:00:00' AND TIMESTAMP '2024-01-15'
UNION ALL SELECT 'other', count(*) FROM logs WHERE timestamp_utc BETWEEN TIMESTAMP '2024-01-14' AND TIMESTAMP '2024-01-15'
UNION ALL SELECT 'all', count(*) FROM logs"""))
def _(t):
    import datetime as dt
    now, out = dt.datetime(2024, 1, 15), None
    for preset in ("7d", "1h", "other", "all"):
        part = t.logs.filter(times.time_range(F.col("timestamp_utc"), preset, now)).agg(
            F.lit(preset).alias("preset"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


LEVEL_TEXT = "CASE id % 6 WHEN 0 THEN CAST(severity AS VARCHAR) WHEN 1 THEN 'Warning' WHEN 2 THEN ' crit ' WHEN 3 THEN '9' WHEN 4 THEN 'odd' ELSE '-3' END"


@query("map_severity", with_logs(f"""
SELECT id, CAST(CASE id % 6 WHEN 0 THEN severity WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 5 WHEN 4 THEN 2 ELSE 0 END AS INT) AS level,
  CASE severity WHEN 0 THEN 'TRACE' WHEN 1 THEN 'DEBUG' WHEN 2 THEN 'INFO' WHEN 3 THEN 'WARN' WHEN 4 THEN 'ERROR' ELSE 'FATAL' END AS name
FROM logs"""))
def _(t):
    raw = F.expr(LEVEL_TEXT.replace("VARCHAR", "STRING"))
    return t.logs.select("id", labels.map_severity(raw).alias("level"), labels.severity_name(F.col("severity")).alias("name"))


@query("severity_from_text", with_logs(f"""
SELECT id, CAST(CASE lower(w) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in fixed.SEVERITY_LEVELS.items())} ELSE 2 END AS INT) AS level
FROM (SELECT id, regexp_extract(body_raw, {sql_text('(?i)' + fixed.SEVERITY_WORD)}, 1) AS w FROM logs)"""))
def _(t):
    return t.logs.select("id", labels.severity_from_text(F.col("body_raw")).alias("level"))


@query("mask_fast", with_logs("SELECT id, masked FROM logs"))
def _(t):
    return t.logs.select("id", text.mask_fast(F.col("body_raw")).alias("masked"))


@query("template_hash_groups", with_logs("""
SELECT service_name, count(DISTINCT masked) AS templates, count(*) AS rows FROM logs GROUP BY service_name"""))
def _(t):
    return t.logs.groupBy("service_name").agg(F.count_distinct("template_hash").alias("templates"),
                                              F.count(F.lit(1)).alias("rows"))


@query("clean_message", """
SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '(?i)[0-9a-f]{32,}', '[HEX_DATA]', 'g') AS cleaned FROM documents""")
def _(t):
    return t.documents.select("doc_id", text.clean_message(F.col("text")).alias("cleaned"))


@query("derive_features", with_logs(f"""
SELECT id, CAST(length(c) AS INT) AS message_length, CAST(len(string_split(c, ' ')) AS INT) AS word_count,
  {sql_any('lower(body_raw)', fixed.ERROR_WORDS)} AS has_error_keywords,
  {sql_any('lower(body_raw)', fixed.SECURITY_WORDS)} AS has_security_keywords,
  CASE WHEN severity = 4 THEN 'ERROR' WHEN severity = 1 THEN 'DEBUG' ELSE 'INFO' END AS severity_name
FROM (SELECT *, regexp_replace(trim(regexp_replace(body_raw, '\\s+', ' ', 'g')), '(?i)[0-9a-f]{{32,}}', '[HEX_DATA]', 'g') AS c FROM logs)"""))
def _(t):
    rows = t.logs.withColumn("severity_name", labels.severity_name(F.col("severity")))
    return features.derive_features(rows, "body_raw", "severity_name").select(
        "id", "message_length", "word_count", "has_error_keywords", "has_security_keywords", "severity_name")


def _tokens_sql(col):
    out = f"lower({col})"
    for p, r in fixed.TOKEN_PLACEHOLDERS:
        out = f"regexp_replace({out}, {sql_text(p)}, {sql_text(r)}, 'g')"
    return f"regexp_extract_all({out}, {sql_text(fixed.TOKEN_PATTERN)})"


@query("log_tokens", with_logs(f"SELECT id, array_to_string({_tokens_sql('body_raw')}, ' ') AS tokens FROM logs"))
def _(t):
    return t.logs.select("id", F.array_join(text.log_tokens(F.col("body_raw")), " ").alias("tokens"))


@query("word_ngrams", with_logs(f"""
SELECT id, array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), ' ') AS grams
FROM (SELECT id, {_tokens_sql('body_raw')} AS w FROM logs)"""))
def _(t):
    return t.logs.select("id", F.array_join(text.word_ngrams(text.log_tokens(F.col("body_raw"))), " ").alias("grams"))


@query("char_ngrams", with_logs("""
SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))) AS g
  FROM (SELECT lower(body_raw) AS b FROM logs)) GROUP BY g"""))
def _(t):
    return t.logs.select(F.explode(text.char_ngrams(F.col("body_raw"))).alias("g")).groupBy("g").agg(
        F.count(F.lit(1)).alias("n"))


@query("char_entropy", """
SELECT page_id, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM (
  SELECT page_id, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY page_id) AS total
  FROM (SELECT page_id, unnest(list_transform(range(1, length(html) + 1), lambda i: ord(substr(html, i, 1)))) AS c FROM pages)
  GROUP BY page_id, c) GROUP BY page_id""")
def _(t):
    return t.pages.select("page_id", F.round(text.char_entropy(F.col("html")), 6).alias("entropy"))


def _entity_sql(name):
    pattern, group = fixed.ENTITY_PATTERNS[name]
    return (f"array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(body_raw, {sql_text(pattern)}, {group}))), 1, 10), ' ')"
            f" AS {name}")


@query("extract_entities", with_logs(f"SELECT id, {', '.join(_entity_sql(n) for n in fixed.ENTITY_PATTERNS)} FROM logs"))
def _(t):
    rows = t.logs.select("id", text.extract_entities(F.col("body_raw")).alias("e"))
    return rows.select("id", *[F.coalesce(F.array_join(F.try_element_at("e", F.lit(n)), " "), F.lit("")).alias(n)
                               for n in fixed.ENTITY_PATTERNS])


@query("keyword_labels", with_logs(f"""
SELECT id, {sql_case(fixed.CATEGORY_WORDS, 'normal', 'm')} AS category,
  {sql_case(fixed.DOMAIN_WORDS, 'application', 'm', 'service_name')} AS domain,
  {sql_case(fixed.LABEL_SEVERITY_WORDS, 'info', 'm')} AS severity FROM (SELECT id, service_name, lower(body_raw) AS m FROM logs)"""))
def _(t):
    return t.logs.select("id", labels.keyword_labels(F.col("body_raw"), F.col("service_name")).alias("k")).select(
        "id", "k.category", "k.domain", "k.severity")


@query("infer_domain", with_logs(f"""
SELECT id, {sql_case(fixed.TEXT_DOMAIN_WORDS, 'application', 'lower(body_raw)')} AS from_text,
  {sql_case([(d, [n.lower()]) for n, d in fixed.DATASET_DOMAINS.items()], 'application', "lower(concat('open', service_name, '-', host))")} AS from_service
FROM logs"""))
def _(t):
    name = F.concat(F.lit("open"), "service_name", F.lit("-"), "host")
    return t.logs.select("id", labels.infer_domain_from_text(F.col("body_raw")).alias("from_text"),
                         labels.infer_domain_from_service(name).alias("from_service"))


@query("infer_severity", with_logs(f"""
SELECT id, {sql_case(fixed.MESSAGE_SEVERITY_WORDS, 'INFO', 'lower(body_raw)')} AS severity FROM logs"""))
def _(t):
    return t.logs.select("id", labels.infer_severity(F.col("body_raw")).alias("severity"))


SIGNATURE_SQL = f"concat_ws('_', {sql_case(fixed.EVENT_SIGNATURES, 'OTHER', 'lower(body_raw)')}, upper(substr(service_name, 1, 10)))"


@query("event_signature", with_logs(f"SELECT id, {SIGNATURE_SQL} AS signature FROM logs"))
def _(t):
    return t.logs.select("id", labels.event_signature(F.col("body_raw"), F.col("service_name")).alias("signature"))


def _first(pattern, group=0):
    return f"nullif(regexp_extract(body_raw, {sql_text(pattern)}, {group}), '')"


TARGET_SQL = (f"coalesce('path:' || {_first(fixed.PATH_PATTERN, 1)}, 'port:' || {_first(fixed.PORT_PATTERN, 1)}, "
              f"'user:' || {_first(fixed.USER_PATTERN, 1)})")
SOURCE_SQL = f"coalesce({_first(fixed.IP_PATTERN)}, service_name)"
FAILURE_SQL = sql_any("lower(body_raw)", fixed.AUTH_FAILURE_WORDS)


@query("source_and_target", with_logs(f"""
SELECT id, {SOURCE_SQL} AS source, coalesce({_first(fixed.IP_PATTERN)}, 'user:' || {_first(fixed.USER_PATTERN, 1)}) AS source_without_column,
  {TARGET_SQL} AS target, {FAILURE_SQL} AS auth_failure FROM logs"""))
def _(t):
    body = F.col("body_raw")
    return t.logs.select("id", labels.extract_source(body, F.col("service_name")).alias("source"),
                         labels.extract_source(body, F.lit("")).alias("source_without_column"),
                         labels.extract_target(body).alias("target"), labels.is_auth_failure(body).alias("auth_failure"))


def _cnt(pattern, col="body_raw"):
    return f"len(regexp_extract_all({col}, {sql_text(pattern)}))"


@query("message_features", with_logs(f"""
SELECT id, CAST(length(body_raw) AS INT) AS length, CAST(len(string_split(trim(regexp_replace(body_raw, '\\s+', ' ', 'g')), ' ')) AS INT) AS words,
  CAST(CASE severity WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 4 END AS INT) AS severity_level,
  CAST({_cnt(':')} AS INT) AS colons, CAST({_cnt('=')} AS INT) AS equals,
  contains(lower(body_raw), 'error')::INT::DOUBLE AS has_error, contains(lower(body_raw), 'failed')::INT::DOUBLE AS has_failed,
  round({_cnt('[0-9]')} / length(body_raw), 6) AS numeric_ratio FROM logs"""))
def _(t):
    cols = dict(features.message_features(F.col("body_raw"), labels.model_severity_name(F.col("severity"))))
    cols["numeric_ratio"] = F.round(cols["numeric_ratio"], 6)
    return t.logs.select("id", *[cols[c].alias(c) for c in (
        "length", "words", "severity_level", "colons", "equals", "has_error", "has_failed", "numeric_ratio")])


@query("threat_features", f"""
SELECT page_id, CAST({_cnt("'", 'html')} AS INT) AS single_quotes, CAST({_cnt('"', 'html')} AS INT) AS double_quotes,
  CAST({_cnt(';', 'html')} AS INT) AS semicolons, CAST({_cnt('--', 'html')} AS INT) AS double_dashes,
  CAST({_cnt('<', 'html')} AS INT) AS less_than, {sql_any('lower(html)', ['script', 'alert', 'onerror'])}::INT::DOUBLE AS has_script,
  {sql_any('lower(html)', ['select', 'union', 'drop', 'insert'])}::INT::DOUBLE AS has_sql FROM pages""")
def _(t):
    cols = dict(features.threat_features(F.col("html"), F.lit("INFO")))
    return t.pages.select("page_id", *[cols[c].alias(c) for c in (
        "single_quotes", "double_quotes", "semicolons", "double_dashes", "less_than", "has_script", "has_sql")])


@query("behaviour_features", with_logs(f"""
SELECT id, {_cnt(r'\b4\d{2}\b', 'm')}::DOUBLE AS http_4xx, least({_cnt(r'\b\d{4,}\b', 'm')}, 10)::DOUBLE AS high_numbers,
  round(least({_cnt('[<>\'";=|&$`\\\\]', 'm')} / length(m) * 100, 50.0::DOUBLE), 6) AS special_char_ratio,
  least({_cnt(r'\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b', 'm')}, 5)::DOUBLE AS ip_count,
  least({_cnt('[|><`$()]', 'm')}, 20)::DOUBLE AS cmd_patterns,
  list_max(list_transform(string_split_regex(m, '\\s+'), lambda w: length(w)))::DOUBLE AS longest_word,
  regexp_matches(m, 'user|login|auth|pass|session|token')::INT::DOUBLE AS auth_context
FROM (SELECT id, lower(body_raw) AS m FROM logs)"""))
def _(t):
    cols = dict(features.behaviour_features(F.col("body_raw")))
    cols["special_char_ratio"] = F.round(cols["special_char_ratio"], 6)
    return t.logs.select("id", *[cols[c].alias(c) for c in (
        "http_4xx", "high_numbers", "special_char_ratio", "ip_count", "cmd_patterns", "longest_word", "auth_context")])


@query("l2_normalize", """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) , 4) AS norm,
  round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS first_value FROM embeddings""")
def _(t):
    unit = text.l2_normalize(F.col("embedding"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return t.embeddings.select("vec_id", F.round(norm, 4).alias("norm"),
                               F.round(F.element_at(unit, 1).cast("double"), 4).alias("first_value"))


@query("sanitize_text", """
SELECT conv_id, turn, trim(regexp_replace(replace(text, chr(0), ''), '\\s+', ' ', 'g')) AS question,
  regexp_replace(text, '[^A-Za-z0-9_\\-.]', '', 'g') AS service FROM conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", text.sanitize_question(F.col("text")).alias("question"),
                                  text.sanitize_service(F.col("text")).alias("service"))


@query("service_group", with_logs("""
SELECT DISTINCT name, CASE WHEN regexp_matches(name, '[/\\\\-]') THEN upper(substr(h, 1, 1)) || substr(h, 2) ELSE 'Other' END AS service_group
FROM (SELECT name, string_split_regex(name, '[/\\\\-]')[1] AS h FROM (SELECT CASE WHEN id % 2 = 0 THEN service_name ELSE concat(service_name, '-', host) END AS name FROM logs))"""))
def _(t):
    name = F.when(F.col("id") % 2 == 0, F.col("service_name")).otherwise(F.concat_ws("-", "service_name", "host"))
    return t.logs.select(name.alias("name")).distinct().withColumn("service_group", text.service_group(F.col("name")))


@query("first_field", with_logs("""
SELECT id, CASE WHEN id % 3 = 2 THEN NULL ELSE body_raw END AS message, host AS extra FROM logs"""))
def _(t):
    key = F.when(F.col("id") % 3 == 0, "msg").when(F.col("id") % 3 == 1, "MESSAGE").otherwise("other")
    rows = t.logs.select("id", F.map_from_arrays(F.array(key, F.lit("Rack")), F.array("body_raw", "host")).alias("m"))
    return rows.select("id", text.first_field(F.col("m"), fixed.MESSAGE_FIELDS).alias("message"),
                       F.try_element_at(text.residual_map(F.col("m"), fixed.MESSAGE_FIELDS), F.lit("Rack")).alias("extra"))


def _questions_cte():
    return """q AS (SELECT conv_id, turn, concat(CASE turn % 4 WHEN 0 THEN 'Show me ' WHEN 1 THEN 'Where is the password fail in '
  WHEN 2 THEN 'find ' ELSE 'why did errors happen: ' END, trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS question FROM conversations WHERE role = 'user')"""


def _question_rows(t):
    k = F.col("turn") % 4
    head = (F.when(k == 0, "Show me ").when(k == 1, "Where is the password fail in ").when(k == 2, "find ")
            .otherwise("why did errors happen: "))
    return t.conversations.filter("role = 'user'").select(
        "conv_id", "turn", F.concat(head, text.collapse_spaces(F.col("text"))).alias("question"))


def _list(words):
    return "[" + ", ".join(sql_text(w) for w in words) + "]"


def _tag_sql():
    alias = " ".join(f"WHEN contains(low, {sql_text(p)}) THEN {sql_text(s)}" for p, s in fixed.SERVICE_ALIASES)
    found = "list_concat(" + ", ".join(f"regexp_extract_all(low, {sql_text(p)}, 1)" for p in fixed.SERVICE_MENTIONS) + ")"
    mapped = " ".join(f"WHEN contains(low, {sql_text(p)}) THEN {_list(ts)}" for p, ts in fixed.SEARCH_PHRASES)
    caught = "list_concat(" + ", ".join(f"regexp_extract_all(low, {sql_text('(?i)' + p)}, 1)" for p in fixed.SEARCH_MENTIONS) + ")"
    words = (f"list_filter(flatten(list_transform({caught}, lambda m: string_split_regex(trim(m), '\\s+'))), "
             f"lambda w: length(w) > 2 AND NOT list_contains({_list(fixed.MENTION_STOP_WORDS)}, w))")
    keys = f"list_filter({_list(fixed.SEARCH_KEYWORDS)}, lambda k: contains(low, k))"
    nouns = (f"list_slice(list_filter(regexp_extract_all(low, '\\b[a-z]{{4,}}\\b'), "
             f"lambda w: NOT list_contains({_list(fixed.NOUN_STOP_WORDS)}, w)), 1, 3)")
    return f"""SELECT conv_id, turn, {sql_any('low', fixed.SEARCH_INDICATORS)} AS is_search,
  coalesce(CASE {alias} END, list_filter({found}, lambda w: length(w) >= 3 AND NOT list_contains({_list(fixed.NOT_A_SERVICE)}, w))[1]) AS service_filter,
  array_to_string(list_slice(list_sort(list_distinct(CASE {mapped} WHEN len(d) > 0 THEN d ELSE {nouns} END)), 1, 5), ' | ') AS terms
FROM (SELECT *, list_concat({words}, {keys}) AS d FROM (SELECT *, lower(question) AS low FROM q))"""


@query("tag_questions", f"WITH {_questions_cte()} {_tag_sql()}")
def _(t):
    return questions.tag_questions(_question_rows(t), "question").select(
        "conv_id", "turn", "is_search", "service_filter", F.array_join("search_terms", " | ").alias("terms"))


def _domain_score(name):
    words = fixed.DOMAIN_KEYWORDS[name]
    hits = " + ".join(f"contains(low, '{w.lower()}')::INT" for w in words)
    return f"(SELECT ({hits}) / {float(len(words))}::DOUBLE * (1 + 0.1::DOUBLE * ({hits}))) AS {name}"


DOMAIN_CTES = [
    "ds AS (SELECT id, lower(concat(body_raw, ' ', service_name)) AS low FROM logs)",
    "sc AS (SELECT id, low, " + ", ".join(_domain_score(d) for d in fixed.DOMAIN_KEYWORDS) + " FROM ds)",
    "dom AS (" + " UNION ALL ".join(f"SELECT id, '{d}' AS domain, {i} AS pos, {d} AS score FROM sc WHERE {d} > 0"
                                    for i, d in enumerate(fixed.DOMAIN_KEYWORDS)) +
    " UNION ALL SELECT id, 'application', 5, 0.5::DOUBLE FROM sc WHERE " +
    " AND ".join(f"{d} = 0" for d in fixed.DOMAIN_KEYWORDS) + ")",
]


def _domains(t):
    return questions.score_domains(t.logs, F.concat_ws(" ", "body_raw", "service_name"))


@query("score_domains", more(*DOMAIN_CTES) + """
SELECT id, domain, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS INT) AS rank FROM dom""")
def _(t):
    return _domains(t).select("id", F.posexplode_outer("domains")).select(
        "id", F.col("col.domain").alias("domain"), F.round("col.score", 6).alias("score"), (F.col("pos") + 1).alias("rank"))


def _example_cte():
    prim = "prim AS (SELECT id, arg_min(domain, (-score, pos)) AS domain FROM dom GROUP BY id)"
    parts = []
    for i, (name, source, applicable, text_) in enumerate(fixed.EXAMPLES):
        shared = " + ".join([f"{sql_any('lower(body_raw)', w)}::INT" for _, w in fixed.QUESTION_TYPES
                             if any(x in text_.lower() for x in w)] or ["0"])
        inlist = ", ".join(f"'{a}'" for a in applicable)
        parts.append(f"SELECT l.id, '{name}' AS example, {i} AS pos, CASE WHEN p.domain = '{source}' THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END + "
                     f"coalesce(d.s, 0.0::DOUBLE) + {shared} AS score FROM logs l JOIN prim p USING (id) LEFT JOIN "
                     f"(SELECT id, sum(2 * score) AS s FROM dom WHERE domain IN ({inlist}) GROUP BY id) d USING (id)")
    return [prim, "ex AS (" + " UNION ALL ".join(parts) + ")"]


@query("rank_examples", more(*DOMAIN_CTES, *_example_cte()) + """
SELECT id, rank, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, pos) AS INT) AS rank
FROM ex WHERE score > 0) WHERE rank <= 3""")
def _(t):
    return questions.rank_examples(_domains(t), "body_raw").select("id", F.posexplode_outer("examples")).filter("col IS NOT NULL").select(
        "id", (F.col("pos") + 1).alias("rank"), F.round("col.score", 6).alias("score"))


@query("transfer_rules", more(*DOMAIN_CTES) + "SELECT id, rule, any_value(pattern) AS pattern FROM dom JOIN (VALUES " +
       ", ".join(f"({sql_text(r)}, {sql_text(s)}, {sql_text(g)}, {sql_text(p)})" for r, s, g, p in fixed.TRANSFER_RULES) +
       ") v(rule, source, target, pattern) ON domain = source OR domain = target OR target = 'all' GROUP BY id, rule")
def _(t):
    names = F.create_map(*[F.lit(x) for r, _, _, p in fixed.TRANSFER_RULES for x in (p, r)])
    return questions.transfer_rules(_domains(t)).select("id", F.explode_outer("rules").alias("pattern")).select(
        "id", F.element_at(names, F.col("pattern")).alias("rule"), "pattern")


@query("rule_table_counts", f"""
SELECT 'domains' AS item, {len(fixed.DOMAIN_KEYWORDS)}::BIGINT AS known, count(DISTINCT domain) AS detected FROM (
 WITH {more(*DOMAIN_CTES).strip()[len('WITH RECURSIVE '):]} SELECT domain FROM dom)""")
def _(t):
    seen = _domains(t).select(F.explode_outer("domains").alias("d")).agg(F.count_distinct("d.domain").alias("detected"))
    return seen.select(F.lit("domains").alias("item"), F.lit(len(fixed.DOMAIN_KEYWORDS)).cast("bigint").alias("known"), "detected")


@query("service_and_format_from_path", with_logs("""
SELECT DISTINCT path, CASE id % 4 WHEN 0 THEN replace(replace(lower(service_name), ' ', '_'), '-', '_') WHEN 1 THEN concat('web_', service_name)
  WHEN 2 THEN concat(service_name, '_access') ELSE 'unknown' END AS service, CASE id % 4 WHEN 0 THEN 'jsonl' WHEN 1 THEN 'csv' ELSE 'text' END AS format
FROM (SELECT id, service_name, CASE id % 4 WHEN 0 THEN concat('file:/logs/', service_name, '/a/b.jsonl') WHEN 1 THEN concat('file:/logs/Web ', service_name, '/x.CSV')
  WHEN 2 THEN concat('file:/logs/', service_name, '-access.log') ELSE concat('file:/elsewhere/', service_name, '.txt') END AS path FROM logs)"""))
def _(t):
    k, s = F.col("id") % 4, F.col("service_name")
    path = (F.when(k == 0, F.concat(F.lit("file:/logs/"), s, F.lit("/a/b.jsonl")))
            .when(k == 1, F.concat(F.lit("file:/logs/Web "), s, F.lit("/x.CSV")))
            .when(k == 2, F.concat(F.lit("file:/logs/"), s, F.lit("-access.log")))
            .otherwise(F.concat(F.lit("file:/elsewhere/"), s, F.lit(".txt"))))
    return t.logs.select(path.alias("path")).distinct().select(
        "path", service_from_path(F.col("path"), "/logs").alias("service"), format_of(F.col("path")).alias("format"))
