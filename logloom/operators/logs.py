"""Queries over logs, templates and vectors: filter, page, look up, rank, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import fixed
from logloom.schema import TEMPLATE_KEY
from logloom.scale import top_n
from logloom.session import materialize

def newest() -> list[Column]:
    return [F.col("timestamp_utc").desc(), F.col("id").desc()]


def filter_logs(logs: DataFrame, tenant: str | None = None, start=None, end=None, service: str | None = None,
                severity_min: int | None = None, template_hash: int | None = None,
                trace_id: str | None = None) -> DataFrame:
    """Rows that meet every given condition; the time range is inclusive at both ends. On a table
    partitioned by event_date the range also prunes partitions."""
    conds: list[Column] = []
    if "event_date" in logs.columns:
        if start is not None:
            conds.append(F.col("event_date") >= F.to_date(F.lit(start).cast("timestamp")))
        if end is not None:
            conds.append(F.col("event_date") <= F.to_date(F.lit(end).cast("timestamp")))
    if tenant is not None:
        conds.append(F.col("tenant_id") == tenant)
    if start is not None:
        conds.append(F.col("timestamp_utc") >= F.lit(start).cast("timestamp"))
    if end is not None:
        conds.append(F.col("timestamp_utc") <= F.lit(end).cast("timestamp"))
    if service is not None:
        conds.append(F.col("service_name") == service)
    if severity_min is not None:
        conds.append(F.col("severity") >= severity_min)
    if template_hash is not None:
        conds.append(F.col("template_hash") == template_hash)
    if trace_id is not None:
        conds.append(F.col("trace_id") == trace_id)
    for c in conds:
        logs = logs.filter(c)
    return logs


def _with_text(logs: DataFrame, templates: DataFrame) -> DataFrame:
    meta = templates.select(*TEMPLATE_KEY, F.col("template_text"))
    return logs.drop("template_text").join(meta, TEMPLATE_KEY, "left")


def query_logs(logs: DataFrame, templates: DataFrame, limit: int = 200, offset: int = 0, **filters) -> DataFrame:
    """One page of matching rows, newest first, with template text. The page is cut before the
    join, so only its rows meet the template table."""
    page = filter_logs(logs, **filters).orderBy(*newest()).offset(offset).limit(limit)
    return _with_text(page, templates).orderBy(*newest())


def page_info(logs: DataFrame, limit: int = 200, offset: int = 0, exact_total: bool = False, **filters) -> DataFrame:
    """has_more (one row past the page is probed) and, when asked, the exact total."""
    rows = filter_logs(logs, **filters)
    if exact_total:
        return rows.agg(F.count(F.lit(1)).alias("total")).withColumn("has_more", F.col("total") > offset + limit)
    probe = rows.select(F.lit(1)).limit(offset + limit + 1)
    return probe.agg((F.count(F.lit(1)) > offset + limit).alias("has_more"))


def get_log(logs: DataFrame, templates: DataFrame, tenant: str, log_id: int) -> DataFrame:
    row = logs.filter((F.col("tenant_id") == tenant) & (F.col("id") == log_id))
    return _with_text(row, templates)


def sample_logs(logs: DataFrame, keys: DataFrame | None, n: int, **filters) -> DataFrame:
    """Latest n rows of every template key; `keys` limits the templates. A key set without
    service_name matches any service."""
    rows = filter_logs(logs, **filters)
    on = TEMPLATE_KEY
    if keys is not None:
        on = [c for c in TEMPLATE_KEY if c in keys.columns]
        rows = rows.join(keys.select(*on).distinct(), on, "left_semi")
    return top_n(rows, on, newest(), n)


def services(df: DataFrame, tenant: str | None = None) -> DataFrame:
    rows = df if tenant is None else df.filter(F.col("tenant_id") == tenant)
    return rows.select("service_name").distinct().orderBy("service_name")


def top_templates(logs: DataFrame, templates: DataFrame, k: int | None = 50, **filters) -> DataFrame:
    """The k most frequent templates (None: all of them). Aggregate and cut come before the metadata join;
    templates without metadata drop out."""
    top = filter_logs(logs, **filters).groupBy(*TEMPLATE_KEY).agg(F.count(F.lit(1)).alias("count"))
    if k is not None:
        top = top.orderBy(F.col("count").desc(), *TEMPLATE_KEY).limit(k)
    return top.join(templates, TEMPLATE_KEY).orderBy(F.col("count").desc(), *TEMPLATE_KEY)


def get_template(templates: DataFrame, tenant: str, template_hash: int, service: str | None = None) -> DataFrame:
    """The template by key; without a service, the first service by name."""
    rows = templates.filter((F.col("tenant_id") == tenant) & (F.col("template_hash") == template_hash))
    if service is not None:
        rows = rows.filter(F.col("service_name") == service)
    return rows.orderBy("service_name").limit(1)


def templates_exist(keys: DataFrame, templates: DataFrame) -> DataFrame:
    """The keys that have a template."""
    return keys.join(templates.select(*TEMPLATE_KEY), TEMPLATE_KEY, "left_semi")


def template_count(logs: DataFrame, keys: DataFrame | None = None, **filters) -> DataFrame:
    """Occurrences of each template in the window. Rows are counted before the key join."""
    counts = filter_logs(logs, **filters).groupBy(*TEMPLATE_KEY).agg(F.count(F.lit(1)).alias("count"))
    if keys is None:
        return counts
    return (keys.select(*TEMPLATE_KEY).distinct().join(counts, TEMPLATE_KEY, "left")
            .withColumn("count", F.coalesce("count", F.lit(0))))


def template_detail(logs: DataFrame, templates: DataFrame, n: int = 20, **filters) -> DataFrame:
    """Templates with count and their latest n occurrences as an array, newest first."""
    counts = template_count(logs, **filters)
    latest = (sample_logs(logs, None, n, **filters).groupBy(*TEMPLATE_KEY)
              .agg(F.sort_array(F.collect_list(F.struct("rn", "id", "timestamp_utc", "severity", "body_raw")))
                   .alias("occurrences")))
    return (templates.join(counts, TEMPLATE_KEY, "left").join(latest, TEMPLATE_KEY, "left")
            .withColumn("count", F.coalesce("count", F.lit(0))))


def pending_templates(templates: DataFrame, n: int | None) -> DataFrame:
    """Templates that wait for an embedding, latest seen first; all of them, in no order, without n."""
    waiting = templates.filter(F.col("embedding_state").isin("none", "queued"))
    return waiting if n is None else waiting.orderBy(F.col("last_seen_utc").desc(), *TEMPLATE_KEY).limit(n)


def set_state(templates: DataFrame, keys: DataFrame, state: str) -> DataFrame:
    marks = keys.select(*TEMPLATE_KEY).distinct().withColumn("_set", F.lit(True))
    return (templates.join(marks, TEMPLATE_KEY, "left")
            .withColumn("embedding_state", F.when(F.col("_set"), F.lit(state)).otherwise(F.col("embedding_state")))
            .drop("_set"))


def quick_stats(logs: DataFrame, templates: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: logs, services, templates."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    parts = (logs.agg(F.count(F.lit(1)).alias("total_logs"), distinct("service_name").alias("total_services"))
             .withColumn("_k", F.lit(1)))
    meta = templates.agg(F.count(F.lit(1)).alias("total_templates")).withColumn("_k", F.lit(1))
    return parts.join(meta, "_k").drop("_k")


def embedding_stats(templates: DataFrame) -> DataFrame:
    state = F.col("embedding_state")
    stats = templates.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(state == "ready").alias("ready"),
        F.count_if(state.isin("none", "queued")).alias("pending"), F.count_if(state == "failed").alias("failed"))
    return stats.withColumn("coverage_percent", F.when(
        F.col("total") > 0, F.round(F.col("ready") / F.col("total") * 100, 1)).otherwise(0.0))


def search_logs(logs: DataFrame, terms: list[str], service: str | None = None, n: int = 15) -> DataFrame:
    """Rows of a named service, or, when it has none, rows holding one of the first 5 terms in
    body or service; term order first, then newest."""
    if service:
        named = logs.filter(F.lower("service_name").contains(service.lower()))
        if not named.isEmpty():
            return named.orderBy(*newest()).limit(n)
    usable = [t.lower() for t in terms[:5] if t.lower() not in fixed.GENERIC_TERMS]
    body, svc = F.lower("body_raw"), F.lower("service_name")
    rank = F.when(F.lit(False), F.lit(None).cast("int"))
    for i, term in enumerate(usable):
        rank = rank.when(body.contains(term) | svc.contains(term), i)
    return (logs.withColumn("term_rank", rank).filter(F.col("term_rank").isNotNull())
            .orderBy("term_rank", *newest()).limit(n))


def _tokens(*texts: str) -> Column:
    """Different lower-case tokens between blanks of the columns together."""
    return F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", *texts)), r"\s+"), lambda w: w != ""))


def _grams(word: Column) -> Column:
    """Different runs of one, two and three characters; linear in the length of the word."""
    one = F.filter(F.split(word, ""), lambda c: c != "")
    two = F.zip_with(one, F.slice(one, 2, 1_000_000_000), lambda x, y: F.concat(x, y))
    three = F.zip_with(two, F.slice(one, 3, 1_000_000_000), lambda x, y: F.concat(x, y))
    return F.array_distinct(F.filter(F.concat(one, two, three), lambda g: g.isNotNull()))


def words_holding(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(piece, word): every different word of `words` that holds a piece of `pieces`.

    The grams that occur in pieces are looked up in an index of the words' grams; each piece takes its rarest
    gram of at most three characters, and the words under it are compared in full."""
    pieces = pieces.select("piece").distinct()
    size = F.least(F.length("piece"), F.lit(3))
    asked = pieces.select("piece", F.explode(F.filter(_grams(F.col("piece")), lambda g: F.length(g) == size)).alias("gram"))
    index = words.select("word").distinct().select("word", F.explode(_grams(F.col("word"))).alias("gram")).join(
        asked.select("gram").distinct(), "gram")
    index = materialize(index, "gram-index")
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = asked.join(counts, "gram", "left").groupBy("piece").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    return rarest.join(index, "gram").filter(F.col("word").contains(F.col("piece"))).select("piece", "word")


def rows_holding_terms(rows: DataFrame, carry: list[str], texts: list[str], terms: DataFrame, n: int | None = None) -> DataFrame:
    """`carry` columns (which must tell rows apart) and term_id of every row one of whose `texts` holds the term, for a
    table of terms (term_id, term) of any size; with `n`, the newest n rows of each term.

    Tokens of the rows meet the tokens that hold the longest piece of a term by an equi-join; terms of several
    pieces are then looked for in the row itself. Blank terms are in no row."""
    terms = terms.select("term_id", F.trim(F.lower("term")).alias("term")).filter("term <> ''").distinct()
    pieces = F.filter(F.split("term", r"\s+"), lambda w: w != "")
    longest = F.element_at(F.sort_array(F.transform(pieces, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    terms = materialize(terms.select("term_id", "term", longest.alias("piece"), (F.size(pieces) > 1).alias("several")), "terms")
    slim = rows.select(*dict.fromkeys([*carry, *texts]))
    placed = slim.withColumn("word", F.explode(_tokens(*texts)))
    found = materialize(words_holding(placed.select("word"), terms), "term-words")
    single = terms.filter("NOT several").join(found, "piece").select("term_id", "word")
    by_word = placed.select(*carry, "word").join(single.select("word").distinct(), "word", "left_semi")
    if n is not None:  # a row beyond the newest n of a word is beyond the newest n of every term in that word
        by_word = top_n(by_word, ["word"], newest(), n).drop("rn")
    out = by_word.join(single, "word").select(*carry, "term_id")
    joint = terms.filter("several").join(found, "piece").select("term_id", "term", "word")
    held = [F.lower(F.col(c)).contains(F.col("term")) for c in texts]
    checked = placed.join(joint, "word").filter(F.coalesce(F.array_max(F.array(*held)), F.lit(False))).select(*carry, "term_id")
    both = out.unionByName(checked).distinct()
    return both if n is None else top_n(both, ["term_id"], newest(), n).drop("rn")


def search_logs_bulk(logs: DataFrame, questions: DataFrame, n: int = 15) -> DataFrame:
    """search_logs for a table of tagged questions (question_id, service_filter, search_terms).

    Rows are ranked once per distinct term, keeping n; a question then merges the short lists of
    its terms. A row beyond the first n of a term cannot enter the answer, because the earlier
    rows of that term already fill it."""
    asked = questions.select("question_id", "service_filter", F.posexplode(F.slice("search_terms", 1, 5)).alias("term_rank", "term"))
    asked = asked.filter(~F.lower("term").isin(*fixed.GENERIC_TERMS)).withColumn("term", F.lower("term"))
    asked = asked.select("question_id", "term_rank", F.xxhash64("term").alias("term_id"), "term")
    named = (questions.filter(F.col("service_filter").isNotNull())
             .select("question_id", F.lower("service_filter").alias("term"))
             .withColumn("term_id", F.xxhash64("term")))
    slim = logs.select("id", "timestamp_utc", "service_name", "severity", "body_raw")

    by_term = materialize(rows_holding_terms(slim, ["id", "timestamp_utc"], ["body_raw", "service_name"], asked.select("term_id", "term"), n), "by-term")
    names = slim.select("service_name").distinct()
    service_hits = rows_holding_terms(names, ["service_name"], ["service_name"], named.select("term_id", "term"))
    latest = top_n(slim.select("service_name", "id", "timestamp_utc"), ["service_name"], newest(), n).drop("rn")
    by_service = named.select("question_id", "term_id").join(service_hits, "term_id").join(latest, "service_name")
    service_first = materialize(top_n(by_service.select("question_id", "id", "timestamp_utc"), ["question_id"], newest(), n), "by-service")

    merged = asked.select("question_id", "term_rank", "term_id").join(
        service_first.select("question_id").distinct(), "question_id", "left_anti").join(by_term, "term_id")
    first = merged.groupBy("question_id", "id").agg(F.min("term_rank").alias("term_rank"), F.any_value("timestamp_utc").alias("timestamp_utc"))
    by_terms = top_n(first, ["question_id"], [F.col("term_rank"), *newest()], n)
    hits = service_first.select("question_id", "rn", "id", F.lit("service").alias("via")).unionByName(
        by_terms.select("question_id", "rn", "id", F.lit("terms").alias("via")))
    return hits.join(slim, "id").select("question_id", "rn", "via", "id", "timestamp_utc", "service_name", "severity", "body_raw")


def contains_text(df: DataFrame, text: str, columns: list[str] = ("body_raw", "template_text", "service_name")) -> DataFrame:
    needle = text.lower()
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False))
    return df.filter(cond)


def severity_summary(logs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts per severity band, error rate, error-and-warning rate and health percent."""
    sev = F.col("severity")
    out = logs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_logs"), F.count_if(sev >= 4).alias("error_count"),
        F.count_if(sev == 3).alias("warn_count"), F.count_if(sev == 2).alias("info_count"),
        F.count_if(sev < 2).alias("debug_count"))
    rate = F.when(F.col("total_logs") > 0, F.col("error_count") / F.col("total_logs") * 100).otherwise(0.0)
    both = F.when(F.col("total_logs") > 0,
                  (F.col("error_count") + F.col("warn_count")) / F.col("total_logs") * 100).otherwise(0.0)
    return out.withColumns({"error_rate": F.round(rate, 2), "error_warn_rate": F.round(both, 2),
                            "health_percent": F.round(100 - rate, 2)})


def vectors_for(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    return vectors.join(keys.select(*TEMPLATE_KEY).distinct(), TEMPLATE_KEY, "left_semi")


def decode_json(df: DataFrame, attributes: str = "attributes_json", parameters: str | None = None) -> DataFrame:
    """JSON text to a string map and a string array; bad JSON gives empty ones."""
    out = df.withColumn("attributes", F.coalesce(
        F.from_json(attributes, "map<string,string>"), F.create_map().cast("map<string,string>")))
    if parameters:
        out = out.withColumn("parameters", F.coalesce(
            F.from_json(parameters, "array<string>"), F.array().cast("array<string>")))
    return out


def consistency(logs: DataFrame, templates: DataFrame, vectors: DataFrame, services_shown: int = 10) -> DataFrame:
    """Check rows (check_name, item, count): templates without logs, ready templates without a
    vector, state distribution and largest services."""
    orphans = templates.join(logs.select(*TEMPLATE_KEY).distinct(), TEMPLATE_KEY, "left_anti")
    unvectored = templates.filter(F.col("embedding_state") == "ready").join(
        vectors.select(*TEMPLATE_KEY), TEMPLATE_KEY, "left_anti")
    states = templates.groupBy(F.col("embedding_state").alias("item")).agg(F.count(F.lit(1)).alias("count"))
    largest = (logs.groupBy(F.col("service_name").alias("item")).agg(F.count(F.lit(1)).alias("count"))
               .orderBy(F.col("count").desc(), "item").limit(services_shown))

    def rows(df, check, item=None):
        return df.select(F.lit(check).alias("check_name"), F.lit(item).alias("item") if item else F.col("item"), "count")

    return (rows(orphans.agg(F.count(F.lit(1)).alias("count")), "templates_without_logs", "all")
            .unionByName(rows(unvectored.agg(F.count(F.lit(1)).alias("count")), "ready_without_vector", "all"))
            .unionByName(rows(states, "embedding_state")).unionByName(rows(largest, "top_service")))
