"""Registered queries: threat detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom import fixed
from logloom.injection_rules import INJECTION_RULES
from logloom.operators import threats as T
from logloom.plans.logview import ISO_SQL, more, ts_text, with_logs
from logloom.plans.q_functions import FAILURE_SQL, SIGNATURE_SQL, SOURCE_SQL, TARGET_SQL, sql_any, sql_text
from logloom.plans.registry import query

ATTACK_SQL = sql_any("lower(body_raw)", ["union", "failed"])


def _seq_cte(name, where):
    return [f"""{name}_s AS (SELECT service_name AS key, sig, concat(lag(sig, 2) OVER w, '|', lag(sig) OVER w) AS state,
  lag(sig, 2) OVER w AS p2 FROM (SELECT *, {SIGNATURE_SQL} AS sig FROM logs WHERE {where})
  WINDOW w AS (PARTITION BY service_name ORDER BY timestamp_utc, id))""",
            f"{name} AS (SELECT key, state, sig AS next, count(*) AS n FROM {name}_s WHERE p2 IS NOT NULL GROUP BY ALL)",
            f"""{name}_m AS (SELECT state, next, sum(n)::BIGINT AS n, (sum(sum(n)) OVER (PARTITION BY state))::BIGINT AS total,
  count(*) OVER (PARTITION BY state) AS distinct_next FROM {name} GROUP BY state, next)"""]


SEQ = _seq_cte("nor", f"NOT {ATTACK_SQL}") + _seq_cte("att", ATTACK_SQL) + _seq_cte("seen", "true")
LOGP = """CASE WHEN {k}t.t IS NULL THEN ln(0.01) ELSE ln((coalesce({k}.n, 0) + 1) / {k}t.t) END"""
SCORE_SQL = f"""seqscore AS (SELECT key, sum(s.n)::BIGINT AS transitions,
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5 + sum(s.n * ({LOGP.format(k='x')} - {LOGP.format(k='y')})) / 10)) AS score
 FROM seen s LEFT JOIN att_m x ON x.state = s.state AND x.next = s.next
 LEFT JOIN (SELECT DISTINCT state, total + distinct_next AS t FROM att_m) xt ON xt.state = s.state
 LEFT JOIN nor_m y ON y.state = s.state AND y.next = s.next
 LEFT JOIN (SELECT DISTINCT state, total + distinct_next AS t FROM nor_m) yt ON yt.state = s.state GROUP BY key)"""


def _split(t):
    low = F.lower("body_raw")
    attack = low.contains("union") | low.contains("failed")
    return t.wide_logs.filter(~attack), t.wide_logs.filter(attack)


@query("markov_fit", more(*SEQ) + "SELECT 'normal' AS kind, * FROM nor_m UNION ALL SELECT 'attack', * FROM att_m")
def _(t):
    return T.markov_fit(*_split(t))


@query("markov_score", more(*SEQ, SCORE_SQL) + "SELECT key, transitions, round(score, 6) AS score FROM seqscore")
def _(t):
    return T.markov_score(t.wide_logs, T.markov_fit(*_split(t))).withColumn("score", F.round("score", 6))


BRUTE_W, RECON_W = 6 * 3600, 24 * 3600
FAIL_CTE = f"fails AS (SELECT *, {SOURCE_SQL} AS source FROM logs WHERE {FAILURE_SQL})"
BASE_CTE = f"""base AS (SELECT avg(n) AS rate, stddev_pop(n) + 0.1::DOUBLE AS std FROM
 (SELECT source, floor(epoch_us(timestamp_utc) / {BRUTE_W * 1000000}) AS w, count(*) AS n FROM fails GROUP BY ALL))"""
BRUTE_CTE = f"""brute AS (SELECT id, source, c AS failure_count, (c - rate) / std AS z FROM
 (SELECT id, source, count(*) OVER (PARTITION BY source ORDER BY timestamp_utc
   RANGE BETWEEN INTERVAL {BRUTE_W} SECOND PRECEDING AND CURRENT ROW) AS c FROM fails), base)"""


@query("bruteforce_fit", more(FAIL_CTE, BASE_CTE) + "SELECT round(rate, 6) AS baseline_rate, round(std, 6) AS baseline_std FROM base")
def _(t):
    return T.bruteforce_fit(t.wide_logs, BRUTE_W).select(
        F.round("baseline_rate", 6).alias("baseline_rate"), F.round("baseline_std", 6).alias("baseline_std"))


@query("bruteforce_fit_total", more(FAIL_CTE) + """
SELECT round(avg(n), 6) AS baseline_rate, round(stddev_pop(n) + 0.1::DOUBLE, 6) AS baseline_std FROM
 (SELECT source, count(*) AS n FROM fails GROUP BY source)""")
def _(t):
    return T.bruteforce_fit(t.wide_logs, baseline="total").select(
        F.round("baseline_rate", 6).alias("baseline_rate"), F.round("baseline_std", 6).alias("baseline_std"))


@query("bruteforce_detect", more(FAIL_CTE, BASE_CTE, BRUTE_CTE) + """
SELECT id, source, failure_count, round(z, 6) AS z_score, z > 3 AS is_brute_force,
  round(least(1.0::DOUBLE, z / 6), 6) AS threat_score FROM brute""")
def _(t):
    out = T.bruteforce_detect(t.wide_logs, T.bruteforce_fit(t.wide_logs, BRUTE_W), BRUTE_W)
    return out.select("id", "source", "failure_count", F.round("z_score", 6).alias("z_score"), "is_brute_force",
                      F.round("threat_score", 6).alias("threat_score"))


@query("active_sources", more(FAIL_CTE) + f"""
SELECT source, count(*) AS failure_count, strftime(min(timestamp_utc), {ISO_SQL}) AS first_failure,
  strftime(max(timestamp_utc), {ISO_SQL}) AS last_failure FROM fails
WHERE timestamp_utc >= (SELECT max(timestamp_utc) FROM fails) - INTERVAL {BRUTE_W} SECOND GROUP BY source""")
def _(t):
    return (T.active_sources(t.wide_logs, BRUTE_W).withColumn("first_failure", ts_text("first_failure"))
            .withColumn("last_failure", ts_text("last_failure")))


def _gram_cte(name, where):
    return (f"{name} AS (SELECT g AS ngram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(b) - 1), "
            f"lambda i: substr(b, i, 3))) AS g FROM (SELECT lower(body_raw) AS b FROM logs WHERE {where})) GROUP BY g)")


ODDS_CTES = [_gram_cte("bad", ATTACK_SQL), _gram_cte("good", f"NOT {ATTACK_SQL}"),
             "odds AS (SELECT ngram, ln((coalesce(bad.n, 0) + 1) / (coalesce(good.n, 0) + 1)) AS score FROM bad FULL JOIN good USING (ngram))"]
ENTROPY_CTE = """ent AS (SELECT id, -sum(n / total * log2(n / total)) AS h FROM (
  SELECT id, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY id) AS total FROM
   (SELECT id, unnest(string_split(body_raw, '')) AS c FROM logs) GROUP BY id, c) GROUP BY id)"""


@query("injection_fit", more(*ODDS_CTES) + "SELECT ngram, round(score, 6) AS score FROM odds")
def _(t):
    good, bad = _split(t)
    return T.injection_fit(bad, good)[0].withColumn("score", F.round("score", 6))


@query("injection_entropy_threshold", more(ENTROPY_CTE) + f"""
SELECT round(avg(h) + 2 * stddev_pop(h), 6) AS entropy_threshold FROM ent JOIN logs USING (id) WHERE NOT {ATTACK_SQL}""")
def _(t):
    good, bad = _split(t)
    return T.injection_fit(bad, good)[1].select(F.round("entropy_threshold", 6).alias("entropy_threshold"))


RULES_VALUES = ", ".join(f"({i}, {sql_text(kind)}, {sql_text(p)})" for i, (kind, ps) in enumerate(INJECTION_RULES.items()) for p in ps)


def _pattern_ctes(key, column, table, flag="(?i)", text=None):
    tests = ", ".join(f"CASE WHEN regexp_matches({text or column}, {sql_text(flag + p)}) THEN {i} END"
                      for i, (_, ps) in enumerate(INJECTION_RULES.items()) for p in ps)
    kinds = ", ".join(f"({i}, '{k}')" for i, k in enumerate(INJECTION_RULES))
    return [f"m AS (SELECT {key}, ty, count(*) AS n FROM (SELECT {key}, unnest([{tests}]) AS ty FROM {table}) WHERE ty IS NOT NULL GROUP BY ALL)",
            f"kinds AS (SELECT * FROM (VALUES {kinds}) v(ty, kind))",
            f"inj AS (SELECT {key}, CAST(sum(n) AS INT) AS pattern_count, arg_min(kind, (-n, ty)) AS attack_type FROM m JOIN kinds USING (ty) GROUP BY {key})"]


@query("injection_patterns", "WITH " + ", ".join(_pattern_ctes("page_id", "html", "pages")) + """
SELECT page_id, coalesce(pattern_count, 0) AS pattern_count, coalesce(attack_type, 'unknown') AS attack_type
FROM pages LEFT JOIN inj USING (page_id)""")
def _(t):
    return T.with_injection(t.wide_pages, "html").select(
        "page_id", "pattern_count", "attack_type")


@query("injection_patterns_strict", "WITH " + ", ".join(_pattern_ctes("page_id", "html", "pages", "", "lower(html)")) + """
SELECT page_id, coalesce(pattern_count, 0) AS pattern_count, coalesce(attack_type, 'unknown') AS attack_type
FROM pages LEFT JOIN inj USING (page_id)""")
def _(t):
    return T.with_injection(t.wide_pages, "html", strict=True).select(
        "page_id", "pattern_count", "attack_type")


INJ_SCORE = """0.4 * least(coalesce(pattern_count, 0), 3) / 3 + {gram}
  CASE WHEN h > {thr} THEN 0.3 * least((h - {thr}) / 2.0::DOUBLE, 1.0::DOUBLE) ELSE 0.0 END"""
GRAM_TERM = "CASE WHEN coalesce(gs, 0) > 0 THEN 0.3::DOUBLE * least(gs / 5.0::DOUBLE, 1.0::DOUBLE) ELSE 0.0::DOUBLE END + "


@query("injection_detect", more(*_pattern_ctes("id", "body_raw", "logs"), ENTROPY_CTE, *ODDS_CTES,
 f"thr AS (SELECT avg(h) + 2 * stddev_pop(h) AS x FROM ent JOIN logs USING (id) WHERE NOT {ATTACK_SQL})",
 """gs AS (SELECT id, sum(score) AS gs FROM (SELECT id, unnest(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))) AS ngram
   FROM (SELECT id, lower(body_raw) AS b FROM logs)) JOIN odds USING (ngram) GROUP BY id)""") + f"""
SELECT id, coalesce(pattern_count, 0) AS pattern_count, round(coalesce(gs, 0), 4) AS ngram_score, round(h, 6) AS entropy, h > x AS high_entropy,
 coalesce(pattern_count, 0) > 0 OR coalesce(gs, 0) > 2 OR h > x AS is_injection,
 round(least(1.0::DOUBLE, {INJ_SCORE.format(gram=GRAM_TERM, thr='x').replace('0.4 *', '0.4::DOUBLE *').replace('0.3 *', '0.3::DOUBLE *')}), 4) AS injection_score
FROM logs JOIN ent USING (id) LEFT JOIN inj USING (id) LEFT JOIN gs USING (id), thr""")
def _(t):
    good, bad = _split(t)
    odds, threshold = T.injection_fit(bad, good)
    return T.with_injection(t.wide_logs.select("id", "body_raw"), "body_raw", odds, threshold).select(
        "id", "pattern_count", F.round("ngram_score", 4).alias("ngram_score"), F.round("entropy", 6).alias("entropy"),
        "high_entropy", "is_injection", F.round("injection_score", 4).alias("injection_score"))


RECON_CTES = [f"acc AS (SELECT *, {SOURCE_SQL} AS source, {TARGET_SQL} AS target FROM logs WHERE {TARGET_SQL} IS NOT NULL)",
              f"""recon AS (SELECT a.id, any_value(a.source) AS source, count(DISTINCT b.target) AS d,
  count(DISTINCT CASE WHEN starts_with(b.target, 'port:') THEN b.target END) AS ports,
  count(DISTINCT CASE WHEN starts_with(b.target, 'path:') THEN b.target END) AS paths,
  count(DISTINCT CASE WHEN starts_with(b.target, 'user:') THEN b.target END) AS users
 FROM acc a JOIN acc b ON a.source = b.source AND b.timestamp_utc <= a.timestamp_utc
  AND b.timestamp_utc >= a.timestamp_utc - INTERVAL {RECON_W} SECOND GROUP BY a.id)"""]
RECON_TYPE = "CASE WHEN d < {n} THEN 'unknown' WHEN ports > 3 THEN 'port_scan' WHEN paths > 5 THEN 'directory_enum' WHEN users > 3 THEN 'user_enum' ELSE 'general_scan' END"


@query("recon_detect", more(*RECON_CTES) + f"""
SELECT id, source, d AS unique_targets, d >= 4 AS is_recon, {RECON_TYPE.format(n=4)} AS recon_type,
  round(least(1.0::DOUBLE, d / 8), 6) AS threat_score FROM recon""")
def _(t):
    return T.recon_detect(t.wide_logs, RECON_W, 4).select(
        "id", "source", "unique_targets", "is_recon", "recon_type", F.round("threat_score", 6).alias("threat_score"))


@query("recon_target_samples", more(*RECON_CTES) + f"""
SELECT source, array_to_string(list_slice(list_sort(list(DISTINCT target)), 1, 10), ' ') AS targets FROM acc
 JOIN (SELECT source, min(timestamp_utc) AS f FROM recon JOIN acc USING (id, source) WHERE d >= 4 GROUP BY source) USING (source)
WHERE timestamp_utc <= f AND timestamp_utc >= f - INTERVAL {RECON_W} SECOND GROUP BY source""")
def _(t):
    return T.recon_target_samples(t.wide_logs, RECON_W, 4).select("source", F.array_join("targets", " ").alias("targets"))


FUSED = more(*_pattern_ctes("id", "body_raw", "logs"), ENTROPY_CTE, FAIL_CTE, BASE_CTE, BRUTE_CTE, *RECON_CTES, *SEQ, SCORE_SQL,
 f"""f AS (SELECT l.id, coalesce(z > 3, false) AS bh, coalesce(d >= 10, false) AS rh, {RECON_TYPE.format(n=10)} AS rtype,
  coalesce(pattern_count, 0) > 0 OR h > 4.5 AS ih, coalesce(attack_type, 'unknown') AS atype, coalesce(pattern_count, 0) AS pc, score AS seq,
  greatest(CASE WHEN z IS NULL THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, z / 6) END, {INJ_SCORE.format(gram='', thr='4.5').replace('0.4 *', '0.4::DOUBLE *').replace('0.3 *', '0.3::DOUBLE *')},
           CASE WHEN d IS NULL THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, d / 20) END) AS rule
  FROM logs l JOIN ent USING (id) LEFT JOIN inj USING (id) LEFT JOIN brute USING (id) LEFT JOIN recon r ON r.id = l.id
  LEFT JOIN seqscore q ON q.key = l.service_name)""",
 """g AS (SELECT *, greatest(rule, seq) AS ts, (ih AND rule > 0.1) OR (bh AND rule > 0.3) OR (rh AND rule > 0.3) OR seq > 0.7 AS is_threat,
  CASE WHEN bh THEN 'brute_force' WHEN ih THEN atype WHEN rh THEN rtype WHEN seq > 0.75 THEN 'attack_pattern' ELSE 'none' END AS threat_type FROM f)""")


def _threats(t):
    return T.detect_threats(t.wide_logs, T.bruteforce_fit(t.wide_logs, BRUTE_W), T.markov_fit(*_split(t)),
                            brute_window=BRUTE_W, recon_window=RECON_W)


@query("detect_threats", FUSED + """
SELECT id, is_threat, round(ts, 6) AS threat_score, threat_type, CASE WHEN ts > 0.8 THEN 'critical' WHEN ts > 0.6 THEN 'high'
  WHEN ts > 0.4 THEN 'medium' WHEN ts > 0.2 THEN 'low' ELSE 'none' END AS threat_level,
  concat_ws(',', CASE WHEN bh THEN 'brute_force' END, CASE WHEN pc > 0 THEN 'injection' END, CASE WHEN rh THEN 'reconnaissance' END) AS indicators FROM g""")
def _(t):
    return _threats(t).select("id", "is_threat", F.round("threat_score", 6).alias("threat_score"), "threat_type",
                              "threat_level", F.array_join("indicators", ",").alias("indicators"))


def _actions_sql():
    def j(name):
        return sql_text(",".join(fixed.THREAT_ACTIONS[name]))
    inj = ", ".join(sql_text(x) for x in fixed.INJECTION_ACTION_TYPES)
    rec = ", ".join(sql_text(x) for x in fixed.RECON_ACTION_TYPES)
    return f"""concat_ws(',', CASE WHEN ts > 0.8 THEN '{fixed.URGENT_ACTION}' END, CASE WHEN threat_type = 'brute_force' THEN {j('brute_force')}
 WHEN threat_type IN ({inj}) THEN {j('injection')} WHEN threat_type IN ({rec}) THEN {j('reconnaissance')}
 WHEN threat_type = 'attack_pattern' THEN {j('attack_pattern')} END)"""


@query("threat_actions", FUSED + f"SELECT id, {_actions_sql()} AS actions FROM g")
def _(t):
    return T.threat_actions(_threats(t)).select("id", F.array_join("actions", ",").alias("actions"))


@query("threat_training_sets", with_logs(f"""
SELECT name, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (
 SELECT 'attack' AS name, id FROM logs WHERE {sql_any('lower(body_raw)', fixed.ATTACK_WORDS)}
 UNION ALL SELECT 'normal', id FROM logs WHERE NOT {sql_any('lower(body_raw)', fixed.ATTACK_WORDS)}
 UNION ALL SELECT 'auth', id FROM logs WHERE {sql_any('lower(body_raw)', fixed.AUTH_WORDS)}
 UNION ALL SELECT CASE WHEN rn <= total // 10 THEN 'malicious' ELSE 'benign' END, id FROM
  (SELECT id, row_number() OVER (ORDER BY timestamp_utc, id) AS rn, count(*) OVER () AS total FROM logs)) GROUP BY name"""))
def _(t):
    out = None
    for name, df in T.threat_training_sets(t.wide_logs).items():
        part = df.groupBy(F.lit(name).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
        out = part if out is None else out.unionByName(part)
    return out
