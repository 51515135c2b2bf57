"""Stateful processing of event streams with Structured Streaming."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.storage import shared_dir

LATE = "1 hour"
#: The state store that keeps timers.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_WITH_TIMERS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files at ``path``, a file or a folder, as a stream of events."""
    # as a pattern, since a stream takes a plain path for a folder
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, through a file sink with a checkpoint in the shared folder."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _WITH_TIMERS)
    try:
        query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/rows")
    finally:
        spark.conf.set(_PROVIDER, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def window_counts(events: DataFrame, seconds: int = 3600, late: str = LATE) -> DataFrame:
    """Events of each type in fixed windows; a window is final once the watermark has passed it."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def first_seen(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each event once, however often it is sent within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


#: Windows of a user that share a row of state.
SPAN = 1024


def rate_limited(events: DataFrame, seconds: int = 3600, limit: int = 2) -> DataFrame:
    """``event_id``, ``admitted``: the first ``limit`` of each user in each fixed window, in the order in which batches bring them, and in a batch by time.

    The state is one row for each user and ``SPAN`` windows, with a counter for each window that the watermark has not passed; it goes with the last of them.  A task holds what a batch brings of one such row."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [(b["ts"].to_numpy(), b["event_id"].to_numpy(), b["window_start"].to_numpy()) for b in batches]
        ts, ids, window = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, ts, window))
        ids, window = ids[order], window[order]
        starts, first, n = np.unique(window, return_index=True, return_counts=True)
        known, counts = (np.array(x, np.int64) for x in state.get) if state.exists else (starts[:0], n[:0])
        before = np.zeros(len(starts), np.int64)
        _, here, there = np.intersect1d(starts, known, assume_unique=True, return_indices=True)
        before[here] = counts[there]
        nth = np.arange(len(ids)) - np.repeat(first, n) + np.repeat(before, n)
        rest = np.setdiff1d(np.arange(len(known)), there)
        held, counts = np.concatenate([starts, known[rest]]), np.concatenate([before + n, counts[rest]])
        mark = state.getCurrentWatermarkMs()
        open_ = (held + seconds) * 1000 > mark
        state.update((held[open_].tolist(), counts[open_].tolist()))
        state.setTimeoutTimestamp(max((int(held.max()) + seconds) * 1000, mark + 1))
        yield pd.DataFrame({"event_id": ids, "admitted": nth < limit})

    keyed = events.withWatermark("ts", LATE).withColumn("window_start", F.floor(F.unix_timestamp("ts") / seconds) * seconds)
    return keyed.withColumn("span", F.floor(F.col("window_start") / (seconds * SPAN))).groupBy("user_id", "span").applyInPandasWithState(
        count, "event_id long, admitted boolean", "windows array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def _micros(at: dt.datetime) -> int:
    return int(pd.Timestamp(at).value // 1000)


class _Leases(StatefulProcessor):
    """One row of state for each job: the greatest fence, its worker, until when it holds, whether it has expired."""

    def __init__(self, seconds: int, keep: int):
        self.lasts, self.keep = seconds * 1_000_000, keep * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "fence long, worker string, until long, expired boolean")

    def _timer(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        beats = sorted((_micros(a), int(f), w) for batch in rows for a, f, w in zip(batch["at"], batch["fence"], batch["worker"], strict=True))
        lease = self.lease.get() if self.lease.exists() else None
        fence, worker, until, expired = lease if lease else (None, None, 0, True)
        out = []
        for at, f, w in beats:
            if fence is not None and not expired and at >= until:
                out.append((fence, worker, "expired", until))
                expired = True
            if fence is None or f > fence:
                fence, worker, until, expired = f, w, at + self.lasts, False
                out.append((f, w, "claimed", at))
            elif f == fence and w == worker and not expired:
                until = max(until, at + self.lasts)
                out.append((f, w, "renewed", at))
            else:
                out.append((f, w, "refused", at))
        self.lease.update((fence, worker, until, expired))
        self._timer(until + self.keep if expired else until)
        yield self._changes(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fence, worker, until, expired = self.lease.get()
        if expired:
            self.lease.clear()
            yield self._changes(key, [])
        else:
            self.lease.update((fence, worker, until, True))
            self._timer(until + self.keep)
            yield self._changes(key, [(fence, worker, "expired", until)])

    @staticmethod
    def _changes(key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["fence", "worker", "change", "at"])
        out.insert(0, "job_id", [key[0]] * len(rows))
        out["at"] = pd.to_datetime(out["at"].astype("int64"), unit="us")
        return out

    def close(self) -> None:
        pass


def leases(beats: DataFrame, seconds: int = 120, keep: int = 86_400, late: str = LATE) -> DataFrame:
    """``job_id``, ``fence``, ``worker``, ``change``, ``at``: what becomes of each beat (``claimed``, ``renewed``, ``refused``), and ``expired`` where a lease ran out.

    ``beats``: ``job_id``, ``fence``, ``worker``, ``at``.  A greater fence takes the job; the holder's own beats renew it, as long as it has not run out; all else is refused, so fences only
    grow.  A lease that nobody renews expires by a timer once the watermark has passed its end.  A job's state is one row and goes ``keep`` seconds after its lease has expired.  Beats later than the
    watermark are dropped; beats of one batch count in the order of their times."""
    kind = beats.schema["job_id"].dataType.simpleString()
    return (
        beats.withWatermark("at", late).groupBy("job_id")
        .transformWithStateInPandas(_Leases(seconds, keep), f"job_id {kind}, fence long, worker string, change string, at timestamp", "append", "eventTime")
    )


class _Baselines(StatefulProcessor):
    """One row of state for each project: when the newest scan that has been published began."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "began long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scans = pd.concat(list(rows)).sort_values(["finished", "created_at", "scan_id"])
        began = scans["created_at"].map(_micros)
        known = self.latest.get()[0] if self.latest.exists() else began.iloc[0]
        before = began.cummax().shift(fill_value=known).clip(lower=known)
        self.latest.update((max(known, int(began.max())),))
        yield pd.DataFrame({"scan_id": scans["scan_id"], "publishes": (before <= began).to_numpy()})

    def close(self) -> None:
        pass


def baselines(scans: DataFrame) -> DataFrame:
    """``scan_id``, ``publishes``: whether a scan that has finished becomes its project's baseline; one that began before the present baseline never does.

    ``scans``: ``project_id``, ``scan_id``, ``created_at``, ``finished``, in the order in which batches bring them.  A project's state is one instant."""
    kind = scans.schema["scan_id"].dataType.simpleString()
    return scans.groupBy("project_id").transformWithStateInPandas(_Baselines(), f"scan_id {kind}, publishes boolean", "append", "none")
