"""Registered queries: template mining, vectors and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import templates as M
from logloom.operators import vectors as V
from logloom.plans.logview import TEMPLATES_SQL, VECTORS_SQL, more, with_logs, with_templates
from logloom.plans.q_anomaly import rounded
from logloom.plans.registry import query


SHAPE = """sh AS (SELECT id, body_raw, string_split(trim(regexp_replace(regexp_replace(body_raw, '[_:=/\\\\\\[\\]()]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS tk FROM logs)"""
# leaders, as no shape of these rows is similar to a shape that follows another one
MINED = [SHAPE, """ms AS (SELECT l.service_name, l.timestamp_utc, list_transform(tk, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tk
 FROM sh JOIN logs l USING (id))""",
         "md AS (SELECT service_name, tk, array_to_string(tk, ' ') AS text, min(timestamp_utc) AS at, count(*) AS n FROM ms GROUP BY service_name, tk)",
         """pa AS (SELECT a.service_name, a.text, b.text AS lead, len(list_filter(list_zip(a.tk, b.tk), lambda p: p[1] = p[2] AND p[1] <> '<*>')) AS same,
 len(list_filter(b.tk, lambda x: x = '<*>')) AS wild, b.at FROM md a JOIN md b ON a.service_name = b.service_name AND len(a.tk) = len(b.tk) AND a.tk[1] = b.tk[1]
 AND (b.at < a.at OR b.at = a.at AND b.text < a.text))""",
         "si AS (SELECT pa.* FROM pa JOIN md USING (service_name, text) WHERE same >= 0.4 * len(tk))",
         "le AS (SELECT * FROM md WHERE NOT EXISTS (SELECT 1 FROM si WHERE si.service_name = md.service_name AND si.text = md.text))",
         """me AS (SELECT service_name, text, text AS lead FROM le UNION ALL SELECT si.service_name, si.text, first(si.lead ORDER BY same DESC, wild DESC, si.at, si.lead)
 FROM si JOIN le ON le.service_name = si.service_name AND le.text = si.lead GROUP BY ALL)""",
         """po AS (SELECT service_name, lead, i, CASE WHEN min(tk[i]) = max(tk[i]) THEN min(tk[i]) ELSE '<*>' END AS t
 FROM (SELECT me.service_name, me.lead, tk, unnest(range(1, len(tk) + 1)) AS i FROM me JOIN md USING (service_name, text)) GROUP BY ALL)""",
         "te AS (SELECT service_name, lead, string_agg(t, ' ' ORDER BY i) AS template_text, count(*) FILTER (t = '<*>') AS w FROM po GROUP BY ALL)",
         "mt AS (SELECT md.service_name, md.text, md.n, te.template_text, te.w FROM md JOIN me USING (service_name, text) JOIN te USING (service_name, lead))"]


@query("mine_templates", more(*MINED) + """
SELECT service_name, template_text, sum(n)::BIGINT AS rows, min(w)::INTEGER AS parameters FROM mt GROUP BY service_name, template_text""")
def _(t):
    return M.mine_templates(t.wide_logs).groupBy("service_name", "template_text").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.size("parameters")).alias("parameters"))


@query("mine_templates_total", more(*MINED) + """
SELECT sum(n)::BIGINT AS rows, count(DISTINCT service_name) AS services, count(DISTINCT (service_name, template_text)) AS templates FROM mt""")
def _(t):
    return M.mine_templates(t.wide_logs).agg(F.count("template_text").alias("rows"), F.count_distinct("service_name").alias("services"),
                                             F.count_distinct("service_name", "template_text").alias("templates"))


@query("extract_parameters", more(SHAPE) + """
SELECT id, array_to_string(list_filter(tk, lambda x: regexp_matches(x, '[0-9]')), ' ') AS parameters FROM sh""")
def _(t):
    tokens = M.message_tokens(F.col("body_raw"))
    template = M.masked_text(M.spaced_text(F.col("body_raw")))
    return t.logs.select("id", F.array_join(M.extract_parameters(F.col("body_raw"), tokens, template), " ").alias("parameters"))


@query("template_counts", with_templates("SELECT service_name, count(*) AS templates FROM templates GROUP BY service_name"))
def _(t):
    return M.template_counts(t.templates)


@query("mine_fast", with_logs("SELECT service_name, template_text, count(*) AS rows FROM logs GROUP BY ALL"))
def _(t):
    return M.mine_fast(t.logs).groupBy("service_name", "template_text").agg(F.count(F.lit(1)).alias("rows"))


OLD = "old AS (SELECT tenant_id, service_name, template_text FROM logs WHERE severity < 3 GROUP BY ALL)"


@query("new_templates", more(OLD) + """
SELECT DISTINCT tenant_id, service_name, template_text FROM logs l WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.tenant_id = l.tenant_id
 AND o.service_name = l.service_name AND o.template_text = l.template_text)""")
def _(t):
    known = M.templates_of(t.logs.filter("severity < 3"))
    return M.new_templates(t.logs, known).select("tenant_id", "service_name", "template_text")


@query("upsert_templates", more(TEMPLATES_SQL, "half AS (SELECT tenant_id, service_name, template_text FROM logs WHERE timestamp_utc < TIMESTAMP '2024-01-15' GROUP BY ALL)") + """
SELECT tenant_id, service_name, template_text, strftime(first_seen_utc, '%Y-%m-%d') AS first_seen, strftime(last_seen_utc, '%Y-%m-%d') AS last_seen,
 CASE WHEN EXISTS (SELECT 1 FROM half h WHERE h.tenant_id = t.tenant_id AND h.service_name = t.service_name AND h.template_text = t.template_text) THEN 'ready' ELSE 'queued' END AS embedding_state
FROM templates t""")
def _(t):
    cut = F.col("timestamp_utc") < "2024-01-15"
    old = M.templates_of(t.logs.filter(cut)).withColumn("embedding_state", F.lit("ready"))
    out = M.upsert_templates(old, M.templates_of(t.logs.filter(~cut)))
    return out.select("tenant_id", "service_name", "template_text", F.date_format("first_seen_utc", "yyyy-MM-dd").alias("first_seen"),
                      F.date_format("last_seen_utc", "yyyy-MM-dd").alias("last_seen"), "embedding_state")


COS = """list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) /
 (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"""


def _asked(t):
    return t.embeddings.filter("label = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


TOPK_SQL = f"""SELECT query_id, vec_id, round(score, 5) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank
 FROM (SELECT a.vec_id AS query_id, b.vec_id, {COS} AS score FROM embeddings a, embeddings b WHERE a.label = 3)) WHERE rank <= 5"""


@query("vector_topk", TOPK_SQL)
def _(t):
    return rounded(V.vector_topk(t.embeddings, _asked(t), 5, column="embedding"), "score", digits=5)


@query("vector_topk_blocks", TOPK_SQL)
def _(t):
    return rounded(V.vector_topk(t.embeddings, _asked(t), 5, column="embedding", broadcast_limit=4), "score", digits=5)


@query("upsert_vectors", f"""WITH {VECTORS_SQL} SELECT vec_id, CASE WHEN label < 5 THEN round(vector[2]::DOUBLE, 6) ELSE round(vector[1]::DOUBLE, 6) END AS value FROM vectors""")
def _(t):
    old = t.vectors.withColumn("updated_utc", F.lit("2024-01-01").cast("timestamp"))
    new = t.vectors.filter("label < 5").withColumn("updated_utc", F.lit("2024-01-02").cast("timestamp")).withColumn(
        "vector", F.slice("vector", 2, 63))
    return V.upsert_vectors(old, new).select(F.col("template_hash").alias("vec_id"), F.round(F.element_at("vector", 1).cast("double"), 6).alias("value"))


@query("delete_vectors", f"WITH {VECTORS_SQL} SELECT vec_id FROM vectors WHERE label >= 5")
def _(t):
    return V.delete_vectors(t.vectors, t.vectors.filter("label < 5")).select("vec_id")


def _embedded(t):
    done, vec = V.embed_pending(t.templates, n=None, now="2024-02-01")
    return done, vec


@query("embed_pending", with_templates("""
SELECT CASE WHEN embedding_state IN ('none', 'queued') THEN 'ready' ELSE embedding_state END AS embedding_state, count(*) AS templates FROM templates GROUP BY 1"""))
def _(t):
    return _embedded(t)[0].groupBy("embedding_state").agg(F.count(F.lit(1)).alias("templates"))


def _query_vectors(t):
    asked = t.templates.groupBy("template_text").agg(
        F.min("template_hash").alias("query_id"))
    return asked.select("query_id", V.hashed_embedding(F.col("template_text")).alias("vector"))


@query("semantic_search")
def _(t):
    _, vec = _embedded(t)
    out = V.semantic_search(vec, t.templates, t.logs, _query_vectors(t), 3)
    return rounded(out.select("query_id", "rank", "score", "service_name", "template_text", "count", F.size("sample_ids").alias("samples")), "score")


@query("evidence")
def _(t):
    _, vec = _embedded(t)
    return rounded(V.evidence(t.logs, t.templates, vec, _query_vectors(t).withColumnRenamed("query_id", "question_id")), "relevance")
