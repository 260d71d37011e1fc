"""Tick path: normalise, validate, snapshot, gaps, quality metrics, live bars.

Every function takes a batch or a streaming frame unless its name says otherwise; the stateful
streaming versions have a batch twin with the same result.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tickloom import schemas
from tickloom.operators import bars
from tickloom.operators.ordered import BLOCK_ROWS, Scan, prefix_scan, row_blocks
from tickloom.session import use_rocksdb

# Stateful code that runs in Python workers travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REALTIME_DELAY_MS = 2000
NON_REALTIME_DELAY_MS = 10000
SNAPSHOT_TTL_SECONDS = 60
GAP_SECONDS = 5


# ------------------------------------------------------------------ normalise and validate

def normalize(raw: DataFrame, source_name: str | Column, column: str = "value") -> DataFrame:
    """JSON records to the unified tick layout with defaults for identity fields."""
    src = F.lit(source_name) if isinstance(source_name, str) else source_name
    t = F.from_json(F.col(column).cast("string"), schemas.TICK)
    keep = [c for c in raw.columns if c != column]
    return raw.select(*keep, t.alias("_t")).filter(F.col("_t").isNotNull()).select(
        *keep, *[{"symbol": F.coalesce("_t.symbol", F.lit("")),
                  "exchange": F.coalesce("_t.exchange", F.lit("")),
                  "asset_type": F.coalesce("_t.asset_type", F.lit("FUTURE")),
                  "timestamp": F.coalesce("_t.timestamp", F.lit(0)),
                  "data_source": F.coalesce("_t.data_source", src),
                  "is_backfill": F.coalesce("_t.is_backfill", F.lit(False)),
                  "data_quality": F.lit("normal")}.get(f.name, F.col(f"_t.{f.name}")).alias(f.name)
                 for f in schemas.TICK.fields])


def _has(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def validate(ticks: DataFrame, arrival_ms: Column | str, realtime: bool = True) -> DataFrame:
    """Adds delay_ms, issues and data_quality: degraded (stale), suspect or normal."""
    now = F.col(arrival_ms) if isinstance(arrival_ms, str) else arrival_ms
    limit = REALTIME_DELAY_MS if realtime else NON_REALTIME_DELAY_MS
    delay = now - F.col("timestamp")
    stale = (F.col("timestamp") > 0) & (delay > limit)
    iv, delta, kind = (_has(ticks, c) for c in ("implied_volatility", "delta", "option_type"))
    checks = [F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in ("open", "high", "low", "close", "volume")]
    checks += [F.when(F.col(c) < 0, F.lit(f"negative_{c}")) for c in ("open", "high", "low", "close")]
    checks += [F.when(F.col("high") < F.col("low"), F.lit("high_below_low")),
               F.when((iv < 0) | (iv > 2.0), F.lit("iv_range")),
               F.when(F.abs(delta) > 1.0, F.lit("delta_range")),
               F.when((F.upper(kind) == "CALL") & (delta < 0), F.lit("call_delta_sign")),
               F.when((F.upper(kind) == "PUT") & (delta > 0), F.lit("put_delta_sign"))]
    issues = F.when(stale, F.array(F.lit("stale"))).otherwise(F.array_compact(F.array(*checks)))
    return ticks.withColumn("delay_ms", F.when(stale, delay)).withColumn("issues", issues) \
        .withColumn("data_quality", F.when(stale, "degraded").when(F.size("issues") > 0, "suspect").otherwise("normal"))


def accepted(validated: DataFrame) -> DataFrame:
    """Ticks that go on; stale ones are dropped."""
    return validated.filter(F.col("data_quality") != "degraded")


def counters(validated: DataFrame) -> DataFrame:
    """Received, validated and rejected totals."""
    return validated.groupBy().agg(
        F.count(F.lit(1)).alias("total_received"),
        F.count_if(F.col("data_quality") != "degraded").alias("total_validated"),
        F.count_if(F.col("data_quality") == "degraded").alias("total_rejected"))


def observe_counters(validated: DataFrame, name: str = "ticks") -> DataFrame:
    """The same totals as a side output of a running query."""
    return validated.observe(name, F.count(F.lit(1)).alias("total_received"),
                             F.count_if(F.col("data_quality") != "degraded").alias("total_validated"),
                             F.count_if(F.col("data_quality") == "degraded").alias("total_rejected"))


def active_only(ticks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Keep ticks of active symbols and attach their catalog entry (stream-static join)."""
    live = catalog.filter(F.col("is_active") == 1).select("symbol", "product_id")
    return ticks.join(live, "symbol")


def deduplicate(ticks: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Drop re-deliveries; on a stream, state is kept only as long as the watermark allows."""
    if ticks.isStreaming:
        return ticks.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return ticks.dropDuplicates(keys)


# ------------------------------------------------------------------ snapshots

def latest_snapshot(ticks: DataFrame, order: str = "timestamp") -> DataFrame:
    """Latest tick per symbol (update mode on a stream)."""
    rest = [c for c in ticks.columns if c != "symbol"]
    return ticks.groupBy("symbol").agg(F.max_by(F.struct(*rest), F.col(order)).alias("snapshot"),
                                       F.max(order).alias("updated_at"))


def live_snapshots(snapshots: DataFrame, now_ms: Column, ttl_seconds: int = SNAPSHOT_TTL_SECONDS) -> DataFrame:
    return snapshots.filter(now_ms - F.col("updated_at") <= ttl_seconds * 1000)


def snapshot_sink(path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: merge the batch's latest ticks into a bucketed snapshot table."""
    from tickloom.sources.tables import upsert

    def write(batch: DataFrame, _epoch: int) -> None:
        rows = latest_snapshot(batch).withColumn("bucket", F.pmod(F.hash("symbol"), F.lit(buckets)))
        upsert(batch.sparkSession, rows, path, ["symbol"], ["updated_at"], by="bucket", derived_from="symbol", newest=True)

    return write


# ------------------------------------------------------------------ gaps

def gaps(ticks: DataFrame, keys: list[str], ts: str = "ts", seconds: float = GAP_SECONDS,
         session: tuple[str, str] | None = ("09:00", "15:15"), rows: int = BLOCK_ROWS) -> DataFrame:
    """Silences longer than ``seconds`` between consecutive ticks of a key.

    The previous tick comes from a two-level scan over blocks of at most about ``rows`` ticks, so a
    key of any size is spread over many tasks. A gap counts when the silence begins inside the session hours.
    """
    blocks = row_blocks(ticks.select(*keys, ts), keys, ts, "hour", rows)
    seen = prefix_scan(blocks, keys, ["_block", "_part"], [ts], [Scan("gap_start", "last", F.col(ts), inclusive=False)])
    length = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("gap_start").cast("timestamp"))
    out = seen.filter(F.col("gap_start").isNotNull()).withColumn("gap_seconds", length / 1e6) \
              .filter(F.col("gap_seconds") > seconds)
    if session:
        out = out.filter(F.date_format("gap_start", "HH:mm").between(*session))
    return out.select(*keys, "gap_start", F.col(ts).alias("gap_end"), "gap_seconds")


def stream_gaps(ticks: DataFrame, key: str, ts: str = "ts", seconds: float = GAP_SECONDS,
                late: str = "2 seconds", session: tuple[str, str] | None = ("09:00", "15:15")) -> DataFrame:
    """Stateful gap detection: one timestamp of state per key and an event-time timer.

    Emits an open gap when the watermark passes last tick + ``seconds`` and the closed gap when the
    next tick arrives. As in ``gaps``, a silence counts when it begins inside the session hours.
    """
    rows = ticks.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")) \
                .withColumn("stamp_ms", F.unix_millis("ts")).withWatermark("ts", late)
    out = _silences(rows, int(seconds * 1000))
    return out.filter(F.date_format("gap_start", "HH:mm").between(*session)) if session else out


class SilenceKeeper(StatefulProcessor):
    """State of a key: its last time, with an event-time timer after ``limit`` milliseconds."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        seen = [np.asarray(b["stamp_ms"], np.int64) for b in rows if len(b)]
        if not seen:
            return
        stamps = np.unique(np.concatenate([*seen, [] if last is None else [last]]).astype(np.int64))
        stamps = stamps[stamps >= last] if last is not None else stamps
        silent = np.flatnonzero(np.diff(stamps) > self.limit)
        if last is not None:
            self.handle.deleteTimer(last + self.limit + 1)
        self.last.update((int(stamps[-1]),))
        self.handle.registerTimer(int(stamps[-1]) + self.limit + 1)
        yield self._frame([(key[0], a, b) for a, b in zip(stamps[silent].tolist(), stamps[silent + 1].tolist(), strict=True)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame([(key[0], self.last.get()[0], None)] if self.last.exists() else [])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "start_ms", "end_ms"]).astype({"start_ms": "Int64", "end_ms": "Int64"})

    def close(self) -> None:
        pass


def _silences(rows: DataFrame, limit: int) -> DataFrame:
    """Silences of more than ``limit`` milliseconds between the ``stamp_ms`` of a ``key``."""
    use_rocksdb(rows.sparkSession)
    found = rows.groupBy("key").transformWithStateInPandas(
        SilenceKeeper(limit), "key string, start_ms long, end_ms long", "Append", "EventTime")
    # Stamps are made from epoch values here, so the session zone of the workers plays no part.
    return found.select("key", F.timestamp_millis("start_ms").alias("gap_start"), F.timestamp_millis("end_ms").alias("gap_end"),
                        ((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("gap_seconds"),
                        F.col("end_ms").isNull().alias("open"))


def failovers(validated: DataFrame, ts: str = "ts", seconds: float = GAP_SECONDS) -> DataFrame:
    """Sources without a valid tick for more than ``seconds`` (batch twin of the failover event)."""
    return gaps(accepted(validated), ["data_source"], ts, seconds, session=None)


def stream_failovers(validated: DataFrame, ts: str = "ts", seconds: float = GAP_SECONDS,
                     late: str = "2 seconds") -> DataFrame:
    """The failover event on a stream: two stateful steps, so that a busy source is not one task's work.

    Valid ticks are first reduced to the first and last one of every slice of ``seconds`` (a windowed
    aggregate, combined before its shuffle); no silence that counts fits into a slice. The second step
    sees two rows per source and slice and keeps the last time with an event-time timer.
    """
    rows = accepted(validated).select("data_source", F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late)
    ends = rows.groupBy("data_source", F.window("at", f"{int(seconds * 1000)} milliseconds").alias("slice")).agg(
        F.unix_millis(F.min("at")).alias("first"), F.unix_millis(F.max("at")).alias("last"))
    marks = ends.select(F.col("data_source").cast("string").alias("key"), F.window_time("slice").alias("ts"),
                        F.explode(F.array("first", "last")).alias("stamp_ms"))
    return _silences(marks, int(seconds * 1000))


# ------------------------------------------------------------------ metrics and bars

def quality_metrics(ticks: DataFrame, order: Column | str = "timestamp") -> DataFrame:
    """Per symbol, day and source: messages, suspects and the decaying score.

    The first message scores 100 (normal) or 50; each later one takes a point, never below 0.
    """
    order = F.col(order) if isinstance(order, str) else order
    first = F.min_by(F.when(F.col("data_quality") == "normal", 100).otherwise(50), order)
    n = F.count(F.lit(1))
    return ticks.groupBy("symbol", "trade_date", F.col("data_source").alias("source_name")).agg(
        n.alias("messages"), F.count_if(F.col("data_quality") == "suspect").alias("suspect_count"),
        F.greatest(F.lit(0), first - (n - 1)).alias("quality_score"))


def live_bars(ticks: DataFrame, minutes: int = 1, keys: list[str] | None = None, ts: str = "ts",
              late: str = "2 seconds") -> DataFrame:
    """Tumbling OHLCV bars from ticks; append mode emits a bar once its window has closed."""
    keys = keys or ["contract_code"]
    rows = ticks.filter(F.col("close").isNotNull())
    if ticks.isStreaming:
        rows = rows.withWatermark(ts, late)
    at = F.col(ts)
    agg = rows.groupBy(*keys, F.window(ts, f"{minutes} minutes").alias("_w")).agg(
        F.min_by("close", at).alias("open"), F.max("close").alias("high"), F.min("close").alias("low"),
        F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"))
    return agg.select(*keys, F.col("_w.start").alias("bar_start"), "open", "high", "low", "close", "volume", "turnover")


# ------------------------------------------------------------------ running streams

def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                  foreach: Callable | None = None) -> None:
    """Drain what is available now into Parquet (or a foreachBatch sink); restarts resume from the
    checkpoint."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint) \
                   .trigger(availableNow=True)
    query = writer.foreachBatch(foreach).start() if foreach else \
        writer.format("parquet").option("path", path).start()
    query.awaitTermination()


__all__ = ["bars", "normalize", "validate", "accepted", "counters", "latest_snapshot", "gaps", "stream_gaps",
           "failovers", "quality_metrics", "live_bars", "deduplicate", "run_available", "file_stream"]
