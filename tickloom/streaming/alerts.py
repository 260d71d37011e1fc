"""Threshold alert rules over metric streams, and metric aggregates.

A rule fires when every value of its metric in the duration window meets the condition, at once
when the duration is zero, and then stays quiet for the cooldown. Duration and cooldown make the
evaluation order-dependent, so live evaluation keeps a few numbers of state per (rule, metric).
A busy metric is first reduced to one row per rule and time slice, combined before its shuffle, so
that the task that folds a rule reads slices, however many points they stand for. Replaying stored
metrics uses the same two steps with ``availableNow`` and a file limit per micro-batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tickloom.operators.ordered import BLOCK_ROWS, Scan, exact_quantiles, prefix_scan, row_blocks
from tickloom.session import use_rocksdb


# Code that runs in Python workers travels with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

@dataclass(frozen=True)
class AlertRule:
    name: str
    metric_name: str
    condition: str
    threshold: float
    duration_seconds: int = 0
    cooldown_seconds: int = 300
    level: str = "warning"
    enabled: bool = True


RULE_SCHEMA = ("name string, metric_name string, condition string, threshold double, "
               "duration_seconds bigint, cooldown_seconds bigint, level string, enabled boolean")


def rules_frame(spark: SparkSession, rules: list[AlertRule]) -> DataFrame:
    return spark.createDataFrame([{**asdict(r), "threshold": float(r.threshold)} for r in rules], RULE_SCHEMA)


def condition_met(value: Column, condition: Column, threshold: Column) -> Column:
    return F.when(condition == ">", value > threshold).when(condition == "<", value < threshold) \
            .when(condition == ">=", value >= threshold).when(condition == "<=", value <= threshold) \
            .when(condition == "==", value == threshold).when(condition == "!=", value != threshold) \
            .otherwise(F.lit(False))


def evaluated(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Metric points (metric_name, ts, value) joined to their enabled rules with the test result."""
    r = rules.filter("enabled").drop("enabled")
    return metrics.join(r, "metric_name") \
                  .withColumn("met", condition_met(F.col("value"), F.col("condition"), F.col("threshold")))


def breaches(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    return evaluated(metrics, rules).filter("met").select("name", "metric_name", "ts", "value", "level")


def breach_runs(metrics: DataFrame, rules: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Unbroken runs of values that meet the condition, with their length in seconds.

    A run is identified by the last failing point before it, found with the two-level scan; the
    run itself is an ordinary aggregate.
    """
    blocks = row_blocks(evaluated(metrics, rules), ["name"], "ts", "hour", rows)
    seen = prefix_scan(blocks, ["name"], ["_block", "_part"], ["ts"],
                       [Scan("_miss", "last", F.when(~F.col("met"), F.col("ts")))])
    return seen.filter("met").groupBy("name", "metric_name", "_miss").agg(
        F.min("ts").alias("run_start"), F.max("ts").alias("run_end"), F.count(F.lit(1)).alias("points"),
        F.max("value").alias("max_value")) \
        .withColumn("run_seconds", (F.unix_micros(F.col("run_end").cast("timestamp"))
                                    - F.unix_micros(F.col("run_start").cast("timestamp"))) / 1e6).drop("_miss")


@dataclass
class Memory:
    """What a rule carries between micro-batches, in microseconds."""

    fired: int | None = None
    holding: int | None = None
    missed: int | None = None
    recent: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))


def firing_points(times: np.ndarray, met: np.ndarray, duration: int, cooldown: int, memory: Memory) -> list[int]:
    """Places in a batch of points (in time order) where a rule fires; ``memory`` moves on.

    Points whose whole duration window meets the condition form stretches, found for the batch at
    once from the last failing point before each. The fold then jumps: from a firing over its
    cooldown by binary search, and inside a stretch to the point that completes the duration.
    """
    low = np.iinfo(np.int64).min
    known = np.concatenate([memory.recent, times])
    failing = np.where(met, low if memory.missed is None else memory.missed, times)
    last_miss = np.maximum.accumulate(failing) if len(times) else failing
    clear = met & ((last_miss < times - duration) | (last_miss == low)) if duration else met
    opens = known[np.searchsorted(known, times - duration)]
    turns = np.flatnonzero(np.diff(np.concatenate([[False], clear, [False]]).astype(np.int8)))
    found, holding = [], memory.holding
    ready = 0 if memory.fired is None else int(np.searchsorted(times, memory.fired + cooldown))
    if ready < len(times) and not clear[ready]:
        holding = None
    for start, end in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        at = max(start, ready)
        while at < end:
            since = int(opens[at]) if holding is None else holding
            hit = max(at, int(np.searchsorted(times, since + duration))) if duration else at
            if hit >= end:
                holding = since if end == len(times) else None
                break
            found.append(hit)
            holding = None
            ready = at = max(hit + 1, int(np.searchsorted(times, int(times[hit]) + cooldown)))
    if found:
        memory.fired = int(times[found[-1]])
    memory.holding = holding
    if len(times):
        memory.missed = None if last_miss[-1] == low else int(last_miss[-1])
        memory.recent = known[np.searchsorted(known, times[-1] - duration):] if duration else known[:0]
    return found


def rule_slices(metrics: DataFrame, rules: DataFrame, resolution: str = "1 second") -> DataFrame:
    """One row per rule and time slice: ``met`` and the point at which the slice is evaluated.

    A rule with a duration is met by a slice whose points all meet the condition and is evaluated at
    its last point; a rule without one is met by, and evaluated at, the first point that meets it.
    With one point per slice that is the evaluation of every point.
    """
    rows = evaluated(metrics, rules).withColumn("met", F.coalesce("met", F.lit(False))) \
        .filter("met or duration_seconds > 0")
    at, point = F.col("ts"), F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    kept = ["name", "metric_name", "level", "duration_seconds", "cooldown_seconds"]
    timed = F.col("duration_seconds") > 0
    return rows.groupBy(*kept, F.window("ts", resolution).alias("slice")).agg(
        F.bool_and("met").alias("met"), F.min_by(point, at).alias("first"), F.max_by(point, at).alias("last")) \
        .withColumn("point", F.when(timed, F.col("last")).otherwise(F.col("first"))) \
        .select(*kept, "met", F.window_time("slice").alias("slice_end"), F.col("point.us").alias("at_us"),
                F.col("point.value").alias("value"))


class RuleKeeper(StatefulProcessor):
    """State of a rule: last firing, since when its condition holds, last miss, slices of its window."""

    def init(self, handle) -> None:
        self.memory = handle.getValueState("memory", "fired long, holding long, missed long, recent array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [b for b in rows if len(b)]
        if not parts:
            return
        memory = Memory()
        if self.memory.exists():
            fired, holding, missed, recent = self.memory.get()
            memory = Memory(fired, holding, missed, np.asarray(recent, np.int64))
        points = pd.concat(parts).sort_values("at_us", kind="stable")
        first = points.iloc[0]
        hits = firing_points(points["at_us"].to_numpy(np.int64), points["met"].to_numpy(bool),
                             int(first.duration_seconds * 1_000_000), int(first.cooldown_seconds * 1_000_000), memory)
        self.memory.update((memory.fired, memory.holding, memory.missed, memory.recent.tolist()))
        yield points.iloc[hits][["name", "metric_name", "at_us", "value", "level"]]

    def close(self) -> None:
        pass


def stream_alerts(metrics: DataFrame, rules: DataFrame, resolution: str = "1 second",
                  late: str = "2 seconds") -> DataFrame:
    """Alerts on a stream: closed slices of every rule, then a fold per (rule, metric) whose state
    keeps only the slices inside the duration window."""
    use_rocksdb(metrics.sparkSession)
    stamped = metrics.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = rule_slices(stamped, rules, resolution).groupBy("name", "metric_name").transformWithStateInPandas(
        RuleKeeper(), "name string, metric_name string, at_us long, value double, level string", "Append", "None")
    return found.select("name", "metric_name", F.timestamp_micros("at_us").alias("ts"), "value", "level")


# ------------------------------------------------------------------ metric aggregates

def counter_totals(points: DataFrame) -> DataFrame:
    """Counters: sum of increments per name."""
    return points.groupBy("metric_name").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("increments"))


def gauge_values(points: DataFrame) -> DataFrame:
    """Gauges: the latest value per name."""
    return points.groupBy("metric_name").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("updated_at"))


def histogram_stats(points: DataFrame, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Count, extremes, mean and nearest-rank p50 / p95 / p99 (exact, no group is collected)."""
    keys = keys or ["metric_name"]
    base = points.groupBy(*keys).agg(
        F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"),
        (F.sum(F.col(value).cast("decimal(28,6)")).cast("double") / F.count(value)).alias("avg"))
    ranks = exact_quantiles(points, keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return base.join(ranks, keys)


#: Size of the kept sketches and the rank error they stay within.
SKETCH_SIZE, RANK_ERROR = 1000, 0.01


def metric_sketches(points: DataFrame, keys: list[str] | None = None, value: str = "value", ts: str = "ts",
                    unit: str = "minute") -> DataFrame:
    """One row per key and time slice that merges with any other: count, extremes, quantile sketch.

    Kept as a table, it answers histograms of any window of slices without the points.
    """
    return points.groupBy(*(keys or ["metric_name"]), F.date_trunc(unit, F.col(ts)).alias("slice")).agg(
        F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_SIZE)).alias("sketch"))


def merged_histogram(sketches: DataFrame, keys: list[str] | None = None, start: str | None = None,
                     end: str | None = None) -> DataFrame:
    """``histogram_stats`` (without the mean) of the slices from ``start`` up to ``end``; the
    quantiles lie within ``RANK_ERROR`` of their ranks."""
    rows = sketches if start is None else sketches.filter(F.col("slice") >= F.lit(start))
    rows = rows if end is None else rows.filter(F.col("slice") < F.lit(end))
    ranks = F.array(*map(F.lit, (0.5, 0.95, 0.99)))
    return rows.groupBy(*(keys or ["metric_name"])).agg(
        F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch").alias("_sketch")) \
        .withColumn("_q", F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double("_sketch", ranks))) \
        .select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))]).drop("_q", "_sketch")
