import datetime as dt

import pytest
from pyspark.sql import functions as F

from logloom import fixed
from logloom.functions import labels, questions, text, times
from logloom.injection_rules import INJECTION_RULES
from logloom.sources import parsers


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("line,level", [
    ("DEBUG: Starting process", 1), ("INFO: Process started", 2), ("WARNING: Low memory", 3),
    ("ERROR: Connection failed", 4), ("FATAL: System crash", 5), ("error: a", 4), ("Error: b", 4),
    ("Just a plain message without severity", 2)])
def test_severity_from_text(spark, line, level):
    assert one(spark, line, labels.severity_from_text) == level


def test_map_severity_defaults(spark):
    rows = spark.createDataFrame([(None, 2), ("3", 3), ("99", 5), ("-1", 0), (" Crit ", 5), ("3.0", 2), ("odd", 2)], "v string, want int")
    for r in rows.select(labels.map_severity(F.col("v")).alias("got"), "want").collect():
        assert r.got == r.want


def test_timestamps(spark):
    cases = {
        "2024-01-15 10:30:00 INFO Starting": "2024-01-15 10:30:00",
        "[10/Oct/2000:13:55:36 -0700] GET /": "2000-10-10 20:55:36",
        "Jun 14 15:16:01 combo sshd(pam_unix)[19939]: authentication failure": "2023-06-14 15:16:01",
        "1700000000": "2023-11-14 22:13:20", "1700000000123": "2023-11-14 22:13:20",
        "01/02/2024 03:04:05 x": "2024-01-02 03:04:05", "nothing": None}
    for line, want in cases.items():
        got = one(spark, line, lambda c: F.date_format(times.parse_ts(times.extract_ts(c)["ts_str"], 2023), "yyyy-MM-dd HH:mm:ss"))
        assert got == want, line


def test_syslog_body_is_kept(spark):
    line = "Jun 14 15:16:01 combo sshd(pam_unix)[19939]: authentication failure"
    row = parsers.normalize(parsers.parse_text(spark.createDataFrame([(line,)], "value string"), 2023), dt.datetime(2024, 1, 1)).first()
    assert row.body_raw == line and row.severity >= 0 and row.message.startswith("combo sshd")
    assert not row.ts_inferred


def test_missing_time_is_inferred(spark):
    row = parsers.normalize(parsers.parse_text(spark.createDataFrame([("plain",)], "value string")), dt.datetime(2024, 1, 1)).first()
    assert row.ts_inferred and row.timestamp_utc == row.ingest_timestamp_utc


def test_jsonl_aliases_and_rejects(spark):
    lines = spark.createDataFrame([
        ('{"@timestamp": "2024-01-01T00:00:00Z", "LEVEL": "warn", "msg": "hi", "serviceName": "a", "x": {"y": 1}}',),
        ("[1]",), ("{broken",), ('{"a": 1}',)], "value string")
    rows = {r.message: r for r in parsers.parse_jsonl(lines).collect()}
    assert rows["hi"].severity == 3 and rows["hi"].service_name == "a" and rows["hi"].attributes == {"x": '{"y":1}'}
    assert '{"a": 1}' in rows and len(rows) == 2
    assert parsers.json_rejects(lines).count() == 2


def test_auth_and_suspicious_words(spark):
    from logloom.operators.security import first_keywords
    rows = spark.createDataFrame([("failed password for x",), ("all fine",), ("sql injection seen",)], "_low string")
    got = rows.select("_low", *[k.alias(c) for c, k in first_keywords(F.col("_low")).items()]).collect()
    assert got[0].authentication_failures == "failed password" and got[1].suspicious_access is None
    assert got[2].suspicious_access == "injection"


def test_entropy_and_ngrams(spark):
    assert one(spark, "aabb", text.char_entropy) == pytest.approx(1.0)
    assert one(spark, "", text.char_entropy) == 0.0
    assert one(spark, "ab", text.char_ngrams) == []
    assert one(spark, "ABCD", text.char_ngrams) == ["abc", "bcd"]


def test_search_terms(spark):
    assert one(spark, "show me incorrect password", questions.search_terms) == sorted(
        ["authentication failed", "invalid password", "wrong password", "login failed", "access denied"])
    assert one(spark, "show me logs from nginx please", questions.service_filter) == "nginx"


def test_every_rule_compiles_in_both_engines(spark):
    import duckdb
    con = duckdb.connect()
    for patterns in INJECTION_RULES.values():
        for p in patterns:
            con.execute("SELECT regexp_matches('x', ?)", ["(?i)" + p])
    cols = [F.lit("x").rlike("(?i)" + p) for ps in INJECTION_RULES.values() for p in ps]
    assert spark.range(1).select(F.array(*cols).alias("a")).first() is not None
    assert len(fixed.EXAMPLES) == 8


def test_char_ngrams_of_supplementary_characters(spark):
    df = spark.createDataFrame([("a😀bcd",), ("ab",), ("",)], "t string")
    assert [r[0] for r in df.select(text.char_ngrams(F.col("t"))).collect()] == [["a😀b", "😀bc", "bcd"], [], []]
