"""Operators with state of their own: trailing windows per event, running series, template discovery.

Event-time operators hold a row back until the watermark has passed it, so rows that arrive out of order are
taken in order and nothing that was sent out changes later. Rows later than the watermark are dropped by Spark.
State per key covers the trailing window and the rows held back, however long the stream runs."""

from __future__ import annotations

import pickle
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logloom.operators.templates import WILD, Leaders, grouped, masked_text, spaced_text, widened
from logloom.operators.threats import auth_failures, target_accesses

SECOND = 1_000_000
WATERMARK = "10 minutes"
#: Rows in one entry of the list of rows that are held back.
HELD_ROWS = 10_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State larger than memory, and the state API below, need this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _packed(rows: list[tuple]) -> list[tuple[bytes]]:
    return [(pickle.dumps(rows[i:i + HELD_ROWS]),) for i in range(0, len(rows), HELD_ROWS)]


class _HeldBack(StatefulProcessor):
    """Keeps rows (at in microseconds, more) in a list until the watermark passes them, then hands them in order
    to `take`. Timers stand at the earliest row held back. An entry of the list holds up to HELD_ROWS rows: every
    entry is a call to the state of its own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.prepare(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            new = list(part[self.columns].itertuples(index=False, name=None))
            if new:
                self.held.appendList(_packed(new))
                first = min(first or new[0][0], min(r[0] for r in new))
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(r for (rows,) in self.held.get() for r in pickle.loads(rows)) if self.held.exists() else []
        ready = [r for r in held if r[0] <= limit]
        later = held[len(ready):]
        if ready:
            if later:
                self.held.put(_packed(later))
            else:
                self.held.clear()
        if later:
            self.handle.registerTimer(-(-later[0][0] // 1000))
        out = self.take(key, ready, limit)
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


class _TrailingCount(_HeldBack):
    """Rows of the key in [at - window, at] for every instant."""

    columns = ["at"]

    def __init__(self, window: int):
        self.window = window

    def prepare(self, handle) -> None:
        self.past = handle.getListState("past", "at long, n long")

    def take(self, key, ready, limit):
        past = list(self.past.get()) if self.past.exists() else []
        times, counts = np.unique(np.array([r[0] for r in ready], np.int64), return_counts=True)
        all_times = np.concatenate([np.array([t for t, _ in past], np.int64), times])
        total = np.concatenate([[0], np.cumsum(np.concatenate([np.array([n for _, n in past], np.int64), counts]))])
        upto = total[np.searchsorted(all_times, times, side="right")] - total[np.searchsorted(all_times, times - self.window, side="left")]
        keep = all_times > limit - self.window
        if keep.any():
            self.past.put([(int(t), int(n)) for t, n in zip(all_times[keep], np.diff(total)[keep])])
            self.handle.registerTimer(-(-(int(all_times[-1]) + self.window) // 1000))  # to forget them when nothing follows
        else:
            self.past.clear()
        return pd.DataFrame({"source": key[0], "at": times, "failure_count": upto})


def stream_bruteforce_events(logs: DataFrame, window: int = 300, watermark: str = WATERMARK) -> DataFrame:
    """source, at (microseconds), failure_count: failures of the source in [at - window, at], for every instant
    with a failure, once the watermark has passed it. Equal to the batch form on the same rows."""
    use_rocksdb(logs.sparkSession)
    fails = auth_failures(logs.withWatermark("timestamp_utc", watermark)).select("source", "at", "timestamp_utc")
    return fails.groupBy("source").transformWithStateInPandas(
        statefulProcessor=_TrailingCount(window * SECOND), outputStructType="source string, at long, failure_count long",
        outputMode="Update", timeMode="EventTime")


class _TrailingDistinct(_HeldBack):
    """Different targets of the key in [at - window, at] for every instant: target -> last seen."""

    columns = ["at", "target"]
    kinds = ("port:", "path:", "user:")

    def __init__(self, window: int):
        self.window = window

    def prepare(self, handle) -> None:
        self.seen = handle.getMapState("seen", "target string", "at long")

    def take(self, key, ready, limit):
        stored = {k[0]: v[0] for k, v in self.seen.iterator()} if self.seen.exists() else {}
        live = OrderedDict(sorted(stored.items(), key=lambda x: x[1]))
        counts = [sum(t.startswith(k) for t in live) for k in self.kinds]

        def forget(before: int) -> None:
            while live and next(iter(live.values())) < before:
                target, _ = live.popitem(last=False)
                for i, k in enumerate(self.kinds):
                    counts[i] -= target.startswith(k)

        out, i = [], 0
        while i < len(ready):
            at = ready[i][0]
            while i < len(ready) and ready[i][0] == at:
                target = ready[i][1]
                if target not in live:
                    for j, k in enumerate(self.kinds):
                        counts[j] += target.startswith(k)
                live[target] = at
                live.move_to_end(target)
                i += 1
            forget(at - self.window)
            out.append((key[0], at, len(live), *counts))
        forget(limit - self.window + 1)
        for target, at in live.items():
            if stored.get(target) != at:
                self.seen.updateValue((target,), (at,))
        for target in stored.keys() - live.keys():
            self.seen.removeKey((target,))
        if live:
            self.handle.registerTimer(-(-(next(reversed(live.values())) + self.window) // 1000) + 1)
        return pd.DataFrame(out, columns=["source", "at", "unique_targets", "port", "path", "user"])


def stream_recon_events(logs: DataFrame, window: int = 60, watermark: str = WATERMARK) -> DataFrame:
    """source, at (microseconds), unique_targets and those that are ports, paths, users, in [at - window, at], for
    every instant with an access, once the watermark has passed it. State: the targets of the window."""
    use_rocksdb(logs.sparkSession)
    seen = target_accesses(logs.withWatermark("timestamp_utc", watermark)).select("source", "target", "at", "timestamp_utc")
    return seen.groupBy("source").transformWithStateInPandas(
        statefulProcessor=_TrailingDistinct(window * SECOND),
        outputStructType="source string, at long, unique_targets long, port long, path long, user long",
        outputMode="Update", timeMode="EventTime")


class _RunningSeries(_HeldBack):
    """Level, trend and slow baseline of the series, one value at a time in order of time."""

    columns = ["at", "value"]

    def __init__(self, alpha: float, beta: float, slow: float):
        self.alpha, self.beta, self.slow = alpha, beta, slow

    def prepare(self, handle) -> None:
        self.state = handle.getValueState("series", "level double, trend double, baseline double, n long")

    def take(self, key, ready, limit):
        if not ready:
            return None
        level, trend, base, n = self.state.get() if self.state.exists() else (0.0, 0.0, 0.0, 0)
        for _, value in ready:
            if n == 0:
                level, trend, base = value, 0.0, value
            else:
                before = level
                level = self.alpha * value + (1 - self.alpha) * (level + trend)
                trend = self.beta * (level - before) + (1 - self.beta) * trend
                base = self.slow * value + (1 - self.slow) * base
            n += 1
        self.state.update((level, trend, base, n))
        return pd.DataFrame({"series": [key[0]], "level": [level], "trend": [trend], "baseline": [base], "n": [n]})


def stream_update(series: DataFrame, alpha: float = 0.3, beta: float = 0.1, slow: float = 0.01, watermark: str = WATERMARK) -> DataFrame:
    """Running state per series from a stream of (series, bucket_ts, value), sent out whenever the watermark lets
    values through. Rows without a value or a time take no part."""
    use_rocksdb(series.sparkSession)
    rows = series.withWatermark("bucket_ts", watermark).filter("value IS NOT NULL AND bucket_ts IS NOT NULL").select(
        "series", F.unix_micros("bucket_ts").alias("at"), F.col("value").cast("double").alias("value"), "bucket_ts")
    return rows.groupBy("series").transformWithStateInPandas(
        statefulProcessor=_RunningSeries(alpha, beta, slow), outputStructType="series string, level double, trend double, baseline double, n long",
        outputMode="Update", timeMode="EventTime")


# --- template discovery -----------------------------------------------------------------
SHAPE = "service_name string, n_tokens int, prefix string, text string, tenant_id string, first_at long, last_at long, rows long"


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Equal shapes of a task become one row before they are shuffled."""
    for batch in batches:
        yield batch.groupby(["service_name", "n_tokens", "prefix", "text", "tenant_id"], dropna=False, as_index=False).agg(
            first_at=("at", "min"), last_at=("at", "max"), rows=("at", "size"))


class _Clusters(StatefulProcessor):
    """Leaders of one group and the shapes that follow them. Only shapes that are new are compared."""

    columns = ["tenant_id", "service_name", "leader", "template_text", "first_at", "last_at", "rows"]

    def __init__(self, sim_th: float):
        self.sim_th = sim_th

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "text string", "leader int")
        self.leaders = handle.getMapState("leaders", "leader int", "text string, template string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows))  # different shapes of one group in one batch
        order = seen.groupby("text")["first_at"].min().reset_index().sort_values(["first_at", "text"])["text"]
        stored = sorted((k[0], v[0], v[1]) for k, v in self.leaders.iterator()) if self.leaders.exists() else []
        index, texts, templates = Leaders(self.sim_th), [x[1] for x in stored], [x[2].split(" ") for x in stored]
        for text in texts:
            index.add(text.split(" "))
        follows, changed = {}, set()
        for text in order:
            if self.known.containsKey((text,)):
                follows[text] = self.known.getValue((text,))[0]
                continue
            tokens = text.split(" ")
            at = index.best(tokens)
            if at is None:
                at = index.add(tokens)
                texts.append(text)
                templates.append(tokens)
                changed.add(at)
            elif (wider := widened(templates[at], tokens)) != templates[at]:
                templates[at] = wider
                changed.add(at)
            follows[text] = at
            self.known.updateValue((text,), (at,))
        for at in changed:
            self.leaders.updateValue((at,), (texts[at], " ".join(templates[at])))
        seen["leader"] = [texts[follows[t]] for t in seen["text"]]
        seen["template_text"] = [" ".join(templates[follows[t]]) for t in seen["text"]]
        out = seen.groupby(["tenant_id", "service_name", "leader", "template_text"], dropna=False, as_index=False).agg(
            first_at=("first_at", "min"), last_at=("last_at", "max"), rows=("rows", "sum"))
        yield out[self.columns]

    def close(self) -> None:
        pass


def stream_clusters(logs: DataFrame, depth: int = 4, sim_th: float = 0.4) -> DataFrame:
    """Changes of the templates, batch by batch: tenant_id, service_name, leader (the first shape of the template),
    template_text as of this batch, and first, last and number of rows of the batch. Shapes are told apart as in
    mine_templates; all prefixes have a group of their own, as a stream cannot know the most frequent ones."""
    use_rocksdb(logs.sparkSession)
    rows = logs.select("tenant_id", "service_name", F.coalesce(F.unix_micros("timestamp_utc"), F.lit(-(1 << 62))).alias("at"),
                       masked_text(spaced_text(F.col("body_raw"))).alias("text")).withColumn(
        "text", F.when(F.col("text") == "", WILD).otherwise(F.coalesce("text", F.lit(WILD))))
    shapes = grouped(rows, depth).select("service_name", "n_tokens", "prefix", "text", "tenant_id", "at").mapInPandas(_combined, SHAPE)
    return shapes.groupBy("service_name", "n_tokens", "prefix").transformWithStateInPandas(
        statefulProcessor=_Clusters(sim_th),
        outputStructType="tenant_id string, service_name string, leader string, template_text string, first_at long, last_at long, rows long",
        outputMode="Update", timeMode="None")
