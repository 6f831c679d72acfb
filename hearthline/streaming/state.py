"""Streams that decide as they go, with Spark's state store: alarms of silent devices, late readings, closed means.

State is kept by device, in RocksDB, and a batch costs what it touches.  These streams answer in the
order of arrival.  What comes behind the watermark of an alarm or a mean is not in it; the logs
(``logs``) have every reading, and ``corrections`` lists the means that late ones have changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import round_cents
from ..operators.series import STALE_AFTER
from ..operators.views import _microseconds
from ..session import ship_by_value
from ..sources.events import run_of, write_batch
from .logs import start

ship_by_value(__name__)

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SPAN = T.StructType().add("online_from", "long").add("last_seen", "long").add("readings", "long")
ALARM = "device_id string, online_from timestamp, last_seen timestamp, readings long, stale_from timestamp"


def joined(first: np.ndarray, last: np.ndarray, n: np.ndarray, gap: int) -> list[tuple[int, int, int]]:
    """Spans in order of time that follow each other within ``gap``, as one."""
    order = np.argsort(first, kind="stable")
    first, last, n = first[order], np.maximum.accumulate(last[order]), n[order]
    new = np.ones(len(first), bool)
    new[1:] = first[1:] - last[:-1] > gap
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(first)) - 1
    return list(zip(first[at].tolist(), last[ends].tolist(), np.add.reduceat(n, at).tolist(), strict=True))


class Presence(StatefulProcessor):
    """The spans of a device that may still go on, in order of time, and one timer, for the moment when the silence after the first
    of them is too long.  When it is due, all spans that the watermark has passed are said, and the next one has the timer."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", SPAN)

    def _spans(self) -> list[tuple]:
        return [tuple(r) for r in self.open.get()]

    def _expiry(self, span: tuple) -> int:
        return -(-(span[1] + self.gap) // 1000)

    def _keep(self, spans: list[tuple]) -> None:
        if spans:
            self.open.put(spans)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._spans()
        parts = [part["micros"].to_numpy().astype(np.int64) for part in rows]
        at, old = np.concatenate(parts), np.array(before, np.int64).reshape(-1, 3)
        first, last = np.concatenate([old[:, 0], at]), np.concatenate([old[:, 1], at])
        spans = joined(first, last, np.concatenate([old[:, 2], np.ones(len(at), np.int64)]), self.gap)
        was, now = self._expiry(before[0]) if before else None, self._expiry(spans[0])
        if was != now:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(now)
        self._keep(spans)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spans, due = self._spans(), expiredTimerInfo.getExpiryTimeInMs()
        passed = max(due + 1, timerValues.getCurrentWatermarkInMs())  # a timer is due when the watermark is beyond it
        over = [s for s in spans if self._expiry(s) < passed]
        rest = spans[len(over) :]
        self._keep(rest)
        if rest:
            self.handle.registerTimer(self._expiry(rest[0]))
        if over:
            first, last, n = np.array(over, np.int64).T
            time = lambda us: pd.to_datetime(us, unit="us")
            yield pd.DataFrame(
                {"device_id": key[0], "online_from": time(first), "last_seen": time(last), "readings": n, "stale_from": time(last + self.gap)}
            )

    def close(self) -> None:
        pass


def stale_alarms(points: DataFrame, gap: str = STALE_AFTER, delay: str = "0 seconds") -> DataFrame:
    """A row for each online span when the device has been silent for ``gap``: as soon as the watermark,
    ``delay`` behind the newest reading of all, has passed that moment.

    Readings behind the watermark are left out; ``logs.online`` has them.
    """
    points.sparkSession.conf.set(STORE, ROCKSDB)
    timed = points.filter("device_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    return (
        timed.select("device_id", "ts", F.unix_micros("ts").alias("micros"))
        .groupBy("device_id")
        .transformWithStateInPandas(Presence(_microseconds(gap)), ALARM, "Append", "EventTime")
    )


class Lateness(StatefulProcessor):
    """The highest event time that a device has sent so far."""

    def __init__(self, delay: int) -> None:
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", T.StructType().add("micros", "long"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("arrival", kind="stable")  # what one trigger has of the device
        at = batch["micros"].to_numpy()
        top = self.top.get()[0] if self.top.exists() else None
        seen = np.maximum.accumulate(np.append(np.int64(top) if top is not None else np.iinfo(np.int64).min, at))
        known = np.arange(len(at)) > 0 if top is None else np.ones(len(at), bool)
        self.top.update((int(seen[-1]),))
        out = batch.drop(columns="micros")
        out["seen_micros"] = pd.array(np.where(known, seen[:-1], 0), "Int64")
        out.loc[~known, "seen_micros"] = pd.NA
        out["late"] = known & (seen[:-1] - at > self.delay)
        yield out

    def close(self) -> None:
        pass


def judge_arrivals(points: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(device_id, ts, arrival, arrival_ts) with seen_until, lag_micros and late, as in ``series.late_arrivals``, on a stream
    that brings readings in the order of arrival."""
    points.sparkSession.conf.set(STORE, ROCKSDB)
    own = points.select("device_id", "arrival", F.unix_micros("arrival_ts").alias("arrival_micros"), F.unix_micros("ts").alias("micros"), F.unix_micros("ts").alias("ts_micros"))
    flagged = own.groupBy("device_id").transformWithStateInPandas(
        Lateness(_microseconds(delay)),
        "device_id string, arrival long, arrival_micros long, ts_micros long, seen_micros long, late boolean",
        "Append",
        "None",
    )
    time = lambda c: F.timestamp_micros(c)
    return flagged.select(
        "device_id", time("ts_micros").alias("ts"), "arrival", time("arrival_micros").alias("arrival_ts"),
        time("seen_micros").alias("seen_until"), (F.col("arrival_micros") - F.col("ts_micros")).alias("lag_micros"), "late",
    )


def stream_judged(
    points: DataFrame, path: str, checkpoint: str, delay: str = "0 seconds", trigger: dict | None = None
) -> StreamingQuery:
    """Readings on time and late ones to tables of their own, and how many of each a batch had."""

    def write(batch: DataFrame, batch_id: int) -> None:
        run = run_of(batch.sparkSession)
        judged = batch.persist()
        try:
            for name, rows in (
                ("on_time", judged.filter("NOT late")),
                ("late", judged.filter("late")),
                ("counts", judged.agg(F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late"))),
            ):
                write_batch(rows, "parquet", {"path": f"{path}/{name}"}, batch_id, run)
        finally:
            judged.unpersist()

    return start(judge_arrivals(points, delay), write, checkpoint, trigger)


def closed_means(points: DataFrame, width: str, delay: str) -> DataFrame:
    """The mean temperature of each device and bucket, once, when the watermark has passed its end."""
    exact = F.col("current_temperature").try_cast("decimal(28,6)")
    means = (
        points.withColumn("_exact", exact)
        .filter(F.col("_exact").isNotNull())
        .withWatermark("ts", delay)
        .groupBy("device_id", F.window("ts", width).alias("bucket"))
        .agg(F.sum("_exact").cast("decimal(38,6)").alias("total"), F.count(F.lit(1)).alias("readings"))
    )
    mean = round_cents(F.col("total").cast("double") / F.col("readings"))
    return means.select("device_id", F.col("bucket.end").alias("timestamp"), mean.alias("temperature"))


def corrections(closed: DataFrame, history: DataFrame) -> DataFrame:
    """Buckets whose mean readings behind the watermark have changed or made: what was said, and what ``history`` has."""
    said = closed.select("device_id", "timestamp", F.col("temperature").alias("said"))
    both = history.join(said, ["device_id", "timestamp"], "left")
    return both.filter(~F.col("said").eqNullSafe(F.col("temperature")))


# Devices seen ------------------------------------------------------------------


def stream_devices_seen(messages: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A sketch of the devices of each day and batch; sketches of a few kB merge to any set of days."""
    from ..operators.ingest import route_messages

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = route_messages(batch).filter("route = 'telemetry' AND key <> ''")
        sketches = seen.groupBy(F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("key").alias("devices"))
        write_batch(sketches, "parquet", {"path": path}, batch_id, run_of(batch.sparkSession))

    return start(messages, write, checkpoint, trigger)


def devices_seen_by_day(spark: SparkSession, path: str) -> DataFrame:
    """About how many devices were seen on each day."""
    sketches = spark.read.schema("day date, devices binary").parquet(path)
    whole = sketches.groupBy("day").agg(F.hll_union_agg("devices").alias("devices"))
    return whole.select("day", F.hll_sketch_estimate("devices").alias("devices"))
