"""Live tick service as streams: snapshots that expire, the intake chain, its counters.

* ``stream_snapshots`` keeps one value of state per symbol and an event-time timer for its time to
  live. It emits a row when a symbol's newest tick changes and one when a tick expires; a late tick
  never wins. Expiry is decided by the ticks' own times, so the rows do not depend on how the input
  was cut into micro-batches (beside intermediate ``set`` rows).
* ``run_intake`` normalises, validates, counts and enriches raw records in one stream. The catalog of
  active symbols is read again for every micro-batch, each micro-batch writes a folder of its own that
  a retry replaces, and totals arrive through a listener.
"""

from __future__ import annotations

import sys
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.listener import StreamingQueryListener

from tickloom.session import use_rocksdb
from tickloom.streaming import ticks as tk

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ------------------------------------------------------------------ snapshots with a time to live

#: A snapshot lives 60 seconds, that of a degraded tick 300.
TTL_MS = 60_000
DEGRADED_TTL_MS = 300_000

SNAPSHOT_EVENTS = "symbol string, kind string, updated_ms long, at_ms long, snapshot string"


def ttl_ms(quality: Column, ttl: int = TTL_MS, degraded: int = DEGRADED_TTL_MS) -> Column:
    return F.when(quality == "degraded", degraded).otherwise(ttl).cast("long")


def _thin(slice_ms: int) -> Callable:
    """First and newest tick per symbol and slice of a record batch. A slice is shorter than every
    time to live, so nothing can expire between the ticks that are left out; a busy symbol then
    costs the shuffle a few rows per slice, however many ticks it has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values(["updated_ms", "seq"])
            part = [b["symbol"], b["updated_ms"] // slice_ms]
            yield b[(b.groupby(part, dropna=False).cumcount() == 0)
                    | (b.groupby(part, dropna=False).cumcount(ascending=False) == 0)]

    return run


class SnapshotKeeper(StatefulProcessor):
    """State: the newest tick (time, sequence, time to live, content) of a symbol."""

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "updated_ms long, seq long, ttl_ms long, snapshot string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [b for b in rows if len(b)]
        if not parts:
            return
        new = pd.concat(parts).sort_values(["updated_ms", "seq"], kind="stable")
        old = self.last.get() if self.last.exists() else None
        now, out = old, []
        for tick in zip(new["updated_ms"].tolist(), new["seq"].tolist(), new["ttl_ms"].tolist(),
                        new["snapshot"].tolist(), strict=True):
            if now is not None and tick[:2] <= tuple(now[:2]):
                continue  # late, or delivered again
            if now is not None and tick[0] - now[0] > now[2]:
                out.append((key[0], "expired", now[0], now[0] + now[2], now[3]))
            now = tick
        if now is not old:
            out.append((key[0], "set", now[0], now[0], now[3]))
            self.last.update(tuple(now))
            if old is not None:
                self.handle.deleteTimer(old[0] + old[2] + 1)
            self.handle.registerTimer(now[0] + now[2] + 1)
        yield pd.DataFrame(out, columns=["symbol", "kind", "updated_ms", "at_ms", "snapshot"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.last.exists():
            now = self.last.get()
            if now[0] + now[2] < expiredTimerInfo.getExpiryTimeInMs():
                out.append((key[0], "expired", now[0], now[0] + now[2], now[3]))
                self.last.clear()
        yield pd.DataFrame(out, columns=["symbol", "kind", "updated_ms", "at_ms", "snapshot"])

    def close(self) -> None:
        pass


def stream_snapshots(ticks: DataFrame, ts: str = "ts", seq: str = "id", ttl: int = TTL_MS,
                     degraded_ttl: int = DEGRADED_TTL_MS, late: str = "2 seconds") -> DataFrame:
    """Changes of the live snapshot per symbol: ``kind`` is ``set`` or ``expired``, ``updated_ms`` the
    tick's own time, ``at_ms`` when the change holds from, ``snapshot`` the tick as JSON.

    A tick is gone once more than its time to live has passed without a newer one.
    """
    use_rocksdb(ticks.sparkSession)
    quality = F.col("data_quality") if "data_quality" in ticks.columns else F.lit("normal")
    rows = ticks.select(F.col("symbol").cast("string").alias("symbol"), F.col(ts).cast("timestamp").alias("at"),
                        F.unix_millis(F.col(ts).cast("timestamp")).alias("updated_ms"),
                        F.col(seq).cast("long").alias("seq"), ttl_ms(quality, ttl, degraded_ttl).alias("ttl_ms"),
                        F.to_json(F.struct(*ticks.columns)).alias("snapshot")).where("symbol is not null and at is not null")
    few = rows.mapInPandas(_thin(max(1, min(ttl, degraded_ttl) // 2)), rows.schema)
    return few.withWatermark("at", late).groupBy("symbol").transformWithStateInPandas(
        SnapshotKeeper(), SNAPSHOT_EVENTS, "Append", "EventTime")


def live_now(events: DataFrame) -> DataFrame:
    """``symbol, updated_ms, snapshot`` of the symbols whose newest tick has not expired."""
    order = F.struct("updated_ms", F.col("kind") == "expired")
    last = events.groupBy("symbol").agg(F.max_by(F.struct("kind", "updated_ms", "snapshot"), order).alias("e"))
    return last.where("e.kind = 'set'").select("symbol", "e.updated_ms", "e.snapshot")


def expirations(events: DataFrame) -> DataFrame:
    return events.where("kind = 'expired'").select("symbol", "updated_ms", F.col("at_ms").alias("expired_ms"))


# ------------------------------------------------------------------ intake chain

class CounterListener(StreamingQueryListener):
    """Adds up the totals that ``observe_counters`` reports per micro-batch, by query run."""

    def __init__(self, name: str = "ticks"):
        self.name, self.totals, self.ended = name, {}, {}

    def _end(self, run: str) -> threading.Event:
        return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            sums = self.totals.setdefault(str(event.progress.runId), {})
            for k, v in row.asDict().items():
                sums[k] = sums.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def of(self, query, timeout: float = 60.0) -> dict[str, int]:
        """Totals of a query that has ended; events reach the listener a little later."""
        if not self._end(str(query.runId)).wait(timeout):
            raise TimeoutError("the end of the query was not reported")
        return self.totals.get(str(query.runId), {})


def intake(raw: DataFrame, source: Column | str, arrival_ms: Column | str) -> DataFrame:
    """Raw records (``value`` holds JSON) to validated ticks, counted on the way, stale ones dropped."""
    return tk.accepted(tk.observe_counters(tk.validate(tk.normalize(raw, source), arrival_ms)))


def run_intake(raw: DataFrame, catalog: Callable[[], DataFrame], source: Column | str, arrival_ms: Column | str,
               path: str, checkpoint: str) -> dict[str, int]:
    """Drains a stream of raw records into ``path`` (one folder per micro-batch) and returns the totals.

    ``catalog`` is called for every micro-batch, so a symbol that becomes active counts from the next
    micro-batch on. A micro-batch that runs again after a failure replaces its folder.
    """
    spark = raw.sparkSession
    listener = CounterListener()
    spark.streams.addListener(listener)

    def write(batch: DataFrame, epoch: int) -> None:
        tk.active_only(batch, catalog()).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    try:
        query = (intake(raw, source, arrival_ms).writeStream.option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).foreachBatch(write).start())
        query.awaitTermination()
        return listener.of(query)
    finally:
        spark.streams.removeListener(listener)
