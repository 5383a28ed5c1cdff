import datetime as dt
import hashlib
import os
import tempfile

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom import fixed
from logloom.plans import catalog, q_streams
from logloom.sources import files, ingest, parsers, tables
from logloom.streaming import jobs

NOW = dt.datetime(2024, 3, 1, 12)


@pytest.fixture()
def tree():
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    def put(path, text):
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)
    put("My-Service/app/a.log", "2024-01-15 10:30:00 INFO Starting\n\n   \r\n2024-01-15 10:31:00 ERROR code 500\r\n")
    put("My-Service/copy.log", "2024-01-15 10:30:00 INFO Starting\n\n   \r\n2024-01-15 10:31:00 ERROR code 500\r\n")
    put("root-file.jsonl", '{"msg": "hello", "level": "warn"}\n[1]\n{bad\n')
    put("web/data.csv", "LineId,Date,Time,Level,Component,Content,EventId,EventTemplate,Pid\n"
        '1,2024-01-15,10:00:00,ERROR,core,"failed, again",E1,x,77\n2,2024-01-15,10:00:01,,,,E2,y,78\n')
    put("web/other.csv", "Content,Severity\nplain words,3\n")
    put(".hidden/x.log", "no\n")
    put("web/.secret.log", "no\n")
    put("web/image.png", "no\n")
    put("web/big.txt", "x" * 5000)
    return root


def test_discover(spark, tree):
    got = files.discover(spark, tree, 4000).collect()
    names = [os.path.relpath(r.path.replace("file:", ""), tree) for r in got]
    assert names == ["My-Service/app/a.log", "My-Service/copy.log", "root-file.jsonl", "web/data.csv", "web/other.csv"]
    assert [r.service_name for r in got] == ["my_service", "my_service", "root_file", "web", "web"]
    assert [r.format for r in got] == ["text", "text", "jsonl", "csv", "csv"]


def test_folder_ingest_and_second_run(spark, tree):
    store = ingest.Store(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    stats = ingest.ingest_folder(spark, tree, store, NOW, mode="fast", max_bytes=4000).first()
    assert (stats.files, stats.skipped, stats.lines, stats.events, stats.errors, stats.rejected) == (5, 1, 8, 5, 0, 3)
    assert sorted((os.path.basename(r.file_path), r.reason) for r in store.rejects().collect()) == [
        ("data.csv", "no_content"), ("root-file.jsonl", "no_object"), ("root-file.jsonl", "no_object")]
    rows = {r.body_raw: r for r in store.logs().collect()}
    assert rows["failed, again"].severity == 4 and rows["failed, again"].service_name == "core"
    assert rows["failed, again"].attributes == {"Pid": "77"} and rows["plain words"].severity == 3
    assert rows['{"msg": "hello", "level": "warn"}'].severity == 3
    assert len({r.id for r in rows.values()}) == 5
    assert store.templates.read().count() == stats.new_templates == 5
    ledger = tables.ledger_list(store.ledger(), "org-123")
    assert ledger.count() == 4 and ledger.agg(F.sum("events_inserted")).first()[0] == 5
    again = ingest.ingest_folder(spark, tree, store, NOW, max_bytes=4000).first()
    assert again.events == 0 and again.skipped == 5
    store.clear_ledger()
    assert store.ledger().count() == 0


def test_chosen_files_must_be_under_root(spark, tree):
    store = ingest.Store(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    with pytest.raises(ValueError):
        ingest.ingest_files(spark, tree, ["/etc/passwd.log"], store, NOW)
    ingest.ingest_files(spark, tree, [f"{tree}/web/other.csv"], store, NOW, service="special")
    assert {r.service_name for r in store.logs().collect()} == {"special"}


def contents(store):
    logs = sorted(map(tuple, store.logs().select("id", "service_name", "body_raw", "template_hash").collect()), key=repr)
    return (logs, sorted(map(tuple, store.templates.read().select("tenant_id", "service_name", "template_text", "first_seen_utc").collect()), key=repr),
            sorted(map(tuple, store.ledger().select("file_hash", "lines_processed", "events_inserted").collect())),
            sorted(map(tuple, store.rejects().select("value", "reason").collect()), key=repr))


@pytest.mark.parametrize("stop_at", ["logs", "templates", "rejects", "ledger", "commit"])
def test_a_stop_between_any_two_writes_and_a_rerun_leave_the_same_tables(spark, tree, monkeypatch, stop_at):
    whole = ingest.Store(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    ingest.ingest_folder(spark, tree, whole, NOW, max_bytes=4000)
    store = ingest.Store(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    put, commit = store.batches.put, store.batches.commit

    def halting(table, *args, **kw):
        put(table, *args, **kw)
        if table == stop_at:
            raise RuntimeError("stopped")

    def never(batch):
        raise RuntimeError("stopped")

    monkeypatch.setattr(store.batches, "put", halting)
    if stop_at == "commit":
        monkeypatch.setattr(store.batches, "commit", never)
    with pytest.raises(RuntimeError):
        ingest.ingest_folder(spark, tree, store, NOW, max_bytes=4000)
    assert contents(store) == ([], [], [], [])
    monkeypatch.setattr(store.batches, "put", put)
    monkeypatch.setattr(store.batches, "commit", commit)
    assert ingest.ingest_folder(spark, tree, store, NOW, max_bytes=4000).first().events == 5
    assert contents(store) == contents(whole)


def test_unreadable_files_are_reported(spark, tree, monkeypatch):
    """One file is gone between the listing and the reading."""
    store = ingest.Store(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    hashes = files.file_hashes
    monkeypatch.setattr(files, "file_hashes", lambda s, paths: hashes(s, [p for p in paths if not p.endswith("other.csv")]))
    stats = ingest.ingest_folder(spark, tree, store, NOW, max_bytes=4000).first()
    assert (stats.files, stats.skipped, stats.errors, stats.events) == (5, 1, 1, 4)
    lost = store.rejects().filter("reason = 'unreadable'").collect()
    assert [os.path.basename(r.file_path) for r in lost] == ["other.csv"]
    monkeypatch.setattr(files, "file_hashes", hashes)
    assert ingest.ingest_folder(spark, tree, store, NOW, max_bytes=4000).first().events == 1


def test_large_files_are_mined_fast(spark, tree, monkeypatch):
    monkeypatch.setattr(ingest.fixed, "FAST_MODE_LINES", 1)
    store = ingest.Store(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    with open(os.path.join(tree, "web", "big.log"), "w") as f:
        f.write("".join(f"request {i} took {i} ms\n" for i in range(50)))
    with open(os.path.join(tree, "web", "small.log"), "w") as f:
        f.write("request 7 took 9 ms\n")
    ingest.ingest_folder(spark, tree, store, NOW, max_bytes=4000)
    got = {os.path.basename(r.file_path): r.template_text for r in store.logs().filter("body_raw like 'request%'").collect()}
    assert got == {"big.log": "request <NUM> took <NUM> ms", "small.log": "request <*> took <*> ms"}


def test_a_named_batch_of_events_is_taken_once(spark):
    store = ingest.Store(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    events = spark.createDataFrame([("hello 1",), ("hello 2",)], "message string")
    assert ingest.ingest_events(events, store, NOW, batch="b1").first().events == 2
    assert ingest.ingest_events(events, store, NOW, batch="b1").first().events == 0
    assert store.logs().count() == 2 and store.templates.read().count() == 1
    ready = store.templates.read().withColumn("embedding_state", F.lit("ready"))
    store.templates.write(ready)
    ingest.ingest_events(events, store, NOW, batch="b2")
    assert [r.embedding_state for r in store.templates.read().collect()] == ["ready"]


def test_stream_ingest_takes_each_content_once(spark, tree):
    """All formats; a second run adds nothing, and a file that comes later is taken then."""
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    store = ingest.Store(spark, base + "/store")

    def run():
        jobs.stream_ingest(spark, tree, store, base + "/check", NOW, "org-123", "fast", 4000).start().awaitTermination()

    run()
    folder = ingest.Store(spark, base + "/folder")
    ingest.ingest_folder(spark, tree, folder, NOW, mode="fast", max_bytes=4000)
    assert contents(store) == contents(folder)
    run()
    with open(os.path.join(tree, "web", "later.log"), "w") as f:
        f.write("2024-01-16 10:30:00 INFO Later\n")
    run()
    assert store.logs().count() == folder.logs().count() + 1 and store.ledger().count() == folder.ledger().count() + 1


def test_large_files_are_hashed_in_pieces(spark, tmp_path):
    """The same SHA-256 as over the whole content: with and without a last line end, a byte order mark, line ends of all kinds, any bytes."""
    mark = b"\xef\xbb\xbf"
    held = {"a.log": b"x\n" * 4000, "b.log": b"x\n" * 4000 + b"y", "c d+%20.log": mark + b"line\r\n" * 900, "e.log": mark + b"l\n" * 900 + b"end",
            "f.log": bytes(range(256)) * 40, "g.log": b"\n" * 3000, "h.log": b"q" * 9000, "i.log": b"\n"}
    for name, content in held.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {os.path.basename(r.path): (r.length, r.file_hash) for r in files.file_hashes(spark, [f"file:{tmp_path}/{n}" for n in held], 0).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in held.items()}


def test_the_folder_of_the_statistics_query_is_not_written_by_one_sorting_task(spark, monkeypatch):
    asked, plain = [], DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda self, *a: asked.append(a) or plain(self, *a))
    before = spark.conf.get(q_streams.OPEN_FILES)
    first, second = catalog.queries()["ingest_statistics"](spark, "/root/testdata/sf0.001").orderBy("run").collect()
    assert (first.files, first.skipped, second.skipped, first.errors) == (7, 1, 7, 0) and (1,) not in asked
    assert spark.conf.get(q_streams.OPEN_FILES) == before


def test_a_line_runs_each_time_pattern_once(spark):
    """What the text parser uses more than once is a column first; the plan does not repeat its pattern for every use."""
    lines = ["2024-01-15 10:30:00 ERROR x", "2024-01-15T10:30:00.5+0200 y", "[15/Jan/2024:10:30:00 +0000] warn z", "Jan 15 10:30:00 host sshd", "1705314600",
             "1705314600123", "15/Jan/2024:10:30:00 q", "01/15/2024 10:30:00 r", "2024-13-45 99:00:00 s", "none", "a 2024-01-15 10:30:00Z b"]
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    out = parsers.parse_text(rows, 2024)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(value") <= 2 * len(fixed.TIMESTAMP_PATTERNS)
    got = [r.t for r in out.select(F.date_format("timestamp_utc", "MM-dd HH:mm:ss").alias("t")).collect()]
    assert got == ["01-15 10:30:00", "01-15 08:30:00", "01-15 10:30:00", "01-15 10:30:00", "01-15 10:30:00", "01-15 10:30:00", "01-15 10:30:00",
                   "01-15 10:30:00", None, None, "01-15 10:30:00"]
    assert [r.severity for r in out.collect()][:3] == [4, 2, 3]
