"""Streams with state against their batch forms, over batches with rows out of order."""

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from logloom.operators import forecast, templates, threats
from logloom.streaming import jobs

START = dt.datetime(2024, 1, 1)
LOG = "id long, tenant_id string, service_name string, timestamp_utc timestamp, severity int, body_raw string"
SERIES = "series string, bucket_ts timestamp, value double"


@pytest.fixture()
def batches(spark, tmp_path):
    """Writes lists of rows as one file each, in order, and runs a stream over them one file at a time."""
    def run(schema, parts, stream, keys, name="t"):
        root = tmp_path / name
        for i, rows in enumerate(parts):
            out = str(root / f"part{i}")
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(out)
            for f in os.listdir(out):
                if f.endswith(".parquet"):
                    os.utime(f"{out}/{f}", (time.time() - 1000 + i * 10,) * 2)
        source = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
                  .option("pathGlobFilter", "*.parquet").parquet(str(root)))
        table, check = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-check")
        jobs.run_to_table(stream(source), keys, table, check)
        return jobs.read_latest(spark, keys, table)

    return run


def log(i, second, body, service="sshd", tenant="org-1"):
    return (i, tenant, service, START + dt.timedelta(seconds=second), 2, body)


TICK = log(-1, 10 ** 6, "Failed password for user=tick from 9.9.9.9")


def shuffled(rows, parts, seed, spread):
    """Rows in order of time, each moved by up to `spread` seconds, cut into parts."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: (r[3] - START).total_seconds() + rng.uniform(0, spread))
    n = -(-len(rows) // parts)
    return [rows[i:i + n] for i in range(0, len(rows), n)]


def test_failures_per_event_equal_the_batch_form(spark, batches):
    rng = random.Random(1)
    rows = [log(i, rng.randint(0, 6000), f"Failed password for user=u from 10.0.0.{rng.randint(1, 3)}") for i in range(400)]
    rows += rows[:3] + [log(900, 5, "all fine")]
    late = log(901, 10, "Failed password for user=u from 10.0.0.1")  # behind the watermark when it comes
    parts = shuffled(rows, 3, 2, 500)
    got = batches(LOG, [*parts, [late, TICK], [TICK]], jobs.stream_bruteforce_events, ["source", "at"])
    want = threats.bruteforce_ticks(spark.createDataFrame(rows, LOG), None).select("source", "at", "failure_count")
    assert sorted(map(tuple, got.filter("source <> '9.9.9.9'").collect())) == sorted(map(tuple, want.collect()))


def test_targets_per_event_equal_the_batch_form(spark, batches):
    rng = random.Random(3)
    rows = [log(i, rng.randint(0, 3000), rng.choice([f"GET /p{rng.randint(0, 9)}/x from 10.0.0.1", f"probe port={rng.randint(1, 30)} from 10.0.0.2",
                                                     f"login user=u{rng.randint(0, 5)} from 10.0.0.1"])) for i in range(500)]
    parts = shuffled(rows, 3, 4, 500)
    got = batches(LOG, [*parts, [log(-1, 10 ** 6, "GET /tick from 9.9.9.9")], [log(-2, 10 ** 6, "GET /tick from 9.9.9.9")]],
                  jobs.stream_recon_events, ["source", "at"])
    want = threats.recon_ticks(spark.createDataFrame(rows, LOG)).select("source", "at", "unique_targets")
    assert sorted(map(tuple, got.filter("source <> '9.9.9.9'").select("source", "at", "unique_targets").collect())) == sorted(map(tuple, want.collect()))
    kinds = got.filter("source = '10.0.0.2'").select((F.col("port") - F.col("unique_targets")).alias("d")).distinct().collect()
    assert [r["d"] for r in kinds] == [0]


def test_state_of_targets_does_not_grow_with_the_run(spark):
    """The processor on its own: targets of long ago leave the stored map."""
    from logloom.streaming.stateful import _TrailingDistinct

    class Store(dict):
        exists = lambda self: bool(self)
        iterator = lambda self: iter(list(self.items()))
        updateValue = dict.__setitem__  # noqa: N815
        removeKey = dict.pop  # noqa: N815

    class Handle:
        registerTimer = lambda self, ms: None  # noqa: E731, N815

    p = _TrailingDistinct(60_000_000)
    p.handle, p.seen = Handle(), Store()
    sizes = []
    for minute in range(200):
        at = minute * 60_000_000
        p.take(("s",), [(at + i, f"port:{minute}-{i}") for i in range(20)], at + 20)
        sizes.append(len(p.seen))
    assert max(sizes) <= 40 and sizes[-1] == sizes[10]


def test_series_state_equals_the_fold(spark, batches):
    rng = random.Random(5)
    rows = [(s, START + dt.timedelta(hours=h), rng.uniform(0, 100)) for s in ("a", "b") for h in range(60)] + [("a", None, 1.0), ("b", START, None)]
    rng.shuffle(rows)
    tick = [("tick", START + dt.timedelta(days=400), 0.0)]
    got = batches(SERIES, [rows[:40], rows[40:80], rows[80:], tick, tick], lambda s: jobs.stream_update(s, watermark="30 days"), ["series"])
    good = [r for r in rows if r[1] is not None and r[2] is not None]
    empty = spark.createDataFrame([], "series string, level double, trend double, baseline double")
    want = {r["series"]: r for r in forecast.update_series(empty, spark.createDataFrame(good, SERIES)).collect()}
    found = {r["series"]: r for r in got.collect() if r["series"] != "tick"}
    assert set(found) == set(want) and all(r["n"] == 60 for r in found.values())
    for s, r in found.items():
        for c in ("level", "trend", "baseline"):
            assert r[c] == pytest.approx(want[s][c], abs=1e-9)


def mined_rows():
    rng = random.Random(6)
    words = [f"w{c}" for c in "abcdefgh"]
    return [log(i, i, " ".join(["go", *[rng.choice(words + ["7"]) for _ in range(rng.choice([3, 6]))]]), rng.choice(["api", "db"]), rng.choice(["org-1", "org-2"]))
            for i in range(300)] + [log(300, 300, ""), log(301, 301, "", None)]


def test_templates_of_a_stream_equal_the_batch_form(spark, tmp_path):
    """Three batches in order of time; then the last one runs again, as after a crash before its commit."""
    rows, root, out, check = mined_rows(), tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        source = (spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(root)))
        jobs.stream_templates(source, out, check).start().awaitTermination()

    for i in range(3):
        spark.createDataFrame(rows[i * 101:(i + 1) * 101], LOG).coalesce(1).write.parquet(str(root / f"part{i}"))
        run()
    columns = ["tenant_id", "service_name", "template_hash", "template_text", "first_seen_utc", "last_seen_utc"]
    mined = templates.mine_templates(spark.createDataFrame(rows, LOG))
    want = sorted((tuple(r) for r in templates.templates_of(mined).select(*columns).collect()), key=repr)
    table = jobs.read_templates(spark, out)
    assert sorted((tuple(r) for r in table.select(*columns).collect()), key=repr) == want
    assert table.agg(F.sum("rows")).first()[0] == len(rows)
    commits = tmp_path / "check" / "commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (commits / str(last), commits / f".{last}.crc"):
        if f.exists():
            f.unlink()
    run()
    assert sorted((tuple(r) for r in jobs.read_templates(spark, out).select(*columns).collect()), key=repr) == want
    assert jobs.read_templates(spark, out).agg(F.sum("rows")).first()[0] == len(rows)


def test_held_rows_go_to_the_state_in_packs():
    """Rows are held in entries of many rows, and those that the watermark has not passed stay held."""
    from types import SimpleNamespace

    import pandas as pd

    from logloom.streaming import stateful

    class Held:
        def __init__(self):
            self.rows = []

        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)

        def appendList(self, rows):
            self.rows = self.rows + rows

        def put(self, rows):
            self.rows = rows

        def clear(self):
            self.rows = []

    held = Held()
    keeper = stateful._HeldBack()
    keeper.columns, keeper.prepare, taken = ["at", "target"], lambda handle: None, []
    keeper.take = lambda key, ready, limit: taken.extend(ready)
    keeper.init(SimpleNamespace(getListState=lambda *a: held, registerTimer=lambda at: None))
    frame = pd.DataFrame({"at": range(25_000, 0, -1), "target": ["user:a"] * 25_000})
    list(keeper.handleInputRows(("s",), iter([frame]), None))
    assert len(held.rows) <= 3
    list(keeper.handleExpiredTimer(("s",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 20), None))
    assert taken == [(i, "user:a") for i in range(1, 20_001)] and len(held.rows) == 1
    list(keeper.handleExpiredTimer(("s",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 99), None))
    assert taken == [(i, "user:a") for i in range(1, 25_001)] and not held.rows
