import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.streaming import alerts, live, ticks as tk

T0 = datetime(2024, 1, 2, 9, 0, 0)


def write_parts(spark, rows, schema, path, parts=4):
    """Several files in time order, so that one micro-batch per file is a real replay."""
    n = len(rows) // parts + 1
    for i in range(parts):
        spark.createDataFrame(rows[i * n:(i + 1) * n], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path).schema


def brute_alerts(points, rule):
    """Straight evaluation of one rule over a list of (seconds, value)."""
    test = {">": lambda v: v > rule.threshold, "<": lambda v: v < rule.threshold}[rule.condition]
    fired, started, out = None, None, []
    for i, (t, _) in enumerate(points):
        if fired is not None and t - fired < rule.cooldown_seconds:
            continue
        recent = [points[i]] if rule.duration_seconds == 0 else [p for p in points[:i + 1] if p[0] >= t - rule.duration_seconds]
        if not all(test(v) for _, v in recent):
            started = None
        elif rule.duration_seconds == 0:
            fired = t
            out.append(t)
        else:
            started = recent[0][0] if started is None else started
            if t - started >= rule.duration_seconds:
                fired, started = t, None
                out.append(t)
    return out


def test_rule_conditions(spark):
    df = spark.createDataFrame([(v, c) for v in (85.0, 75.0, 80.0) for c in (">",)], "v double, c string")
    assert [r.m for r in df.select(alerts.condition_met(F.col("v"), F.col("c"), F.lit(80.0)).alias("m")).collect()] == [True, False, False]


def test_cooldown_suppresses_the_second_alert():
    memory = alerts.Memory()
    assert alerts.firing_points(np.array([0, 5]), np.array([True, True]), 0, 60, memory) == [0]
    assert alerts.firing_points(np.array([59, 60, 61]), np.array([True, True, True]), 0, 60, memory) == [1]


@pytest.mark.parametrize("seed", range(40))
def test_firing_points_equal_brute_force_in_any_batches(seed):
    rnd = random.Random(seed)
    rule = alerts.AlertRule("r", "m", ">", 30, rnd.choice([0, 10, 40]), rnd.choice([0, 5, 60]))
    points, t = [], 0
    for _ in range(120):
        t += rnd.choice([1, 2, 5, 9, 30])
        points.append((t, float(rnd.choice([20, 50, 70, 90, 95]))))
    memory, got, at = alerts.Memory(), [], 0
    while at < len(points):
        part = points[at:at + rnd.randint(1, 30)]
        hits = alerts.firing_points(np.array([p[0] for p in part]), np.array([p[1] > 30 for p in part]),
                                    rule.duration_seconds, rule.cooldown_seconds, memory)
        got += [part[h][0] for h in hits]
        at += len(part)
    assert got == brute_alerts(points, rule)


def test_stream_alerts_equal_brute_force_across_micro_batches(spark, tmp_path):
    rnd = random.Random(11)
    rules = [alerts.AlertRule("spike", "cpu", ">", 60, 0, 45), alerts.AlertRule("high", "cpu", ">", 30, 40, 100), alerts.AlertRule("low", "mem", "<", 80, 25, 0)]
    rows, t = [], 0
    for _ in range(600):
        t += rnd.choice([1, 2, 5, 9, 30])
        rows.append((rnd.choice(["cpu", "mem"]), T0 + timedelta(seconds=t), float(rnd.choice([20, 50, 70, 90, 95]))))
    schema = write_parts(spark, rows, "metric_name string, ts timestamp, value double", str(tmp_path / "in"), 5)
    stream = tk.file_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    tk.run_available(alerts.stream_alerts(stream, alerts.rules_frame(spark, rules)), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(r.name, []).append((r.ts - T0).total_seconds())
    closed = (rows[-1][1] - T0).total_seconds() - 2  # slices that end after the watermark are still open
    for rule in rules:
        points = [((ts - T0).total_seconds(), v) for m, ts, v in rows if m == rule.metric_name]
        assert sorted(got.get(rule.name, [])) == [t for t in brute_alerts(points, rule) if t + 1 <= closed]


def test_busy_metric_reaches_the_fold_as_slices(spark, tmp_path):
    """100,000 points in 20 seconds are 20 rows for the fold; one failing point in a slice counts."""
    rules = alerts.rules_frame(spark, [alerts.AlertRule("held", "m", ">", 10.0, 5, 0), alerts.AlertRule("at_once", "m", ">", 90.0, 0, 8)])
    at = F.timestamp_micros(F.lit(int(T0.timestamp() * 1e6)) + F.col("id") * 200)
    value = F.when(F.col("id") == 40_123, 1.0).when(F.col("id").isin(7, 70_000), 99.0).otherwise(50.0)
    points = spark.range(100_000).select(F.lit("m").alias("metric_name"), at.alias("ts"), value.alias("value"))
    slices = alerts.rule_slices(points, rules)
    assert {r.name: r["count"] for r in slices.groupBy("name").count().collect()} == {"held": 20, "at_once": 2}
    assert [r.slice_end.second for r in slices.where("name = 'held' and not met").collect()] == [8]
    points.repartitionByRange(4, "ts").sortWithinPartitions("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = tk.file_stream(spark, str(tmp_path / "in"), points.schema)
    tk.run_available(alerts.stream_alerts(stream, rules), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.name, round((r.ts - T0).total_seconds(), 4)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # Without a cooldown a held rule fires slice by slice; the miss at 8.02 s starts the hold anew.
    assert [g for g in got if g[0] == "at_once"] == [("at_once", 0.0014), ("at_once", 14.0)]
    assert [g[1] for g in got if g[0] == "held"] == [5.9998, 6.9998, 7.9998, 14.9998, 15.9998, 16.9998]


@pytest.mark.parametrize("files", [1, 5])
def test_stream_failovers_equal_the_batch_twin(spark, tmp_path, files):
    rnd = random.Random(6)
    rows, t = [], 0.0
    for _ in range(600):
        t += rnd.choice([0.25, 0.5, 1, 7])
        rows.append((rnd.choice(["a", "b", "b", "b"]), T0 + timedelta(seconds=t), rnd.choice(["normal", "normal", "suspect", "degraded"])))
    rows += [("end", T0 + timedelta(seconds=t + 60), "normal")]
    schema = write_parts(spark, rows, "data_source string, ts timestamp, data_quality string", str(tmp_path / "in"), files)
    stream = tk.file_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    tk.run_available(tk.stream_failovers(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out")).filter("not open").collect()
    batch = tk.failovers(spark.read.parquet(str(tmp_path / "in"))).collect()
    assert sorted((r.key, r.gap_start, r.gap_end) for r in out) == sorted((r.data_source, r.gap_start, r.gap_end) for r in batch)
    assert len(batch) > 30


def brute_snapshots(rows, ttl, degraded):
    """Expirations and live symbols of (symbol, id, seconds, quality) at the last tick minus two seconds."""
    gone, live_ = [], {}
    end = max(r[2] for r in rows) - 2
    for symbol in {r[0] for r in rows}:
        mine = sorted((t, i, degraded if q == "degraded" else ttl) for s, i, t, q in rows if s == symbol)
        for (t, i, keep), later in zip(mine, [*mine[1:], None], strict=True):
            if (later[0] - t if later else end - t) > keep:
                gone.append((symbol, t, t + keep))
            elif later is None:
                live_[symbol] = t
    return sorted(gone), live_


def test_snapshots_expire_and_survive_a_restart(spark, tmp_path):
    rnd = random.Random(8)
    rows, t = [], 0
    for i in range(500):
        t += rnd.choice([1, 3, 10])
        rows.append((rnd.choice(["A", "B", "C", "D", f"rare{i % 40}"]), i, t, rnd.choice(["normal", "suspect", "degraded"])))
    gone, live_ = brute_snapshots(rows, 60, 300)
    data = [(s, i, T0 + timedelta(seconds=t), q, float(i)) for s, i, t, q in rows]
    schema = "symbol string, id bigint, ts timestamp, data_quality string, close double"
    half = len(data) // 2
    read = write_parts(spark, data[:half], schema, str(tmp_path / "in"), 3)
    for part in (None, data[half:]):  # the second run starts from the checkpoint of the first
        if part:
            late = [(s, -1, ts - timedelta(seconds=1), q, -1.0) for s, _, ts, q, _ in part[5:10]]
            write_parts(spark, part + late + part[-20:], schema, str(tmp_path / "in"), 3)
        stream = tk.file_stream(spark, str(tmp_path / "in"), read, files_per_trigger=1)
        tk.run_available(live.stream_snapshots(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    events = spark.read.parquet(str(tmp_path / "out"))
    zero = int(T0.timestamp() * 1000)
    got = [(r.symbol, (r.updated_ms - zero) / 1000, (r.expired_ms - zero) / 1000) for r in live.expirations(events).collect()]
    assert sorted(got) == gone and len(gone) > 40
    now = {r.symbol: ((r.updated_ms - zero) / 1000, json.loads(r.snapshot)["close"]) for r in live.live_now(events).collect()}
    newest = {s: float(i) for s, i, _, _ in rows}
    assert now == {s: (t, newest[s]) for s, t in live_.items()} and len(now) > 3


def test_thinned_ticks_of_a_busy_symbol():
    import pandas as pd
    frame = pd.DataFrame({"symbol": ["A"] * 50_000 + ["B"], "updated_ms": [*range(50_000), 7], "seq": range(50_001)})
    [few] = live._thin(30_000)(iter([frame]))
    assert sorted(few[few.symbol == "A"].updated_ms) == [0, 29_999, 30_000, 49_999] and len(few) == 5


def test_intake_reads_the_catalog_again_for_every_micro_batch(spark, tmp_path):
    docs = [(i, int(T0.timestamp() * 1000) + i * 1000 + (5000 if i % 5 == 0 else 10), json.dumps(
        {"symbol": f"S{i % 3}", "timestamp": int(T0.timestamp() * 1000) + i * 1000, "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5,
         "volume": 3})) for i in range(60)]
    schema = write_parts(spark, docs, "id bigint, arrival_ms bigint, value string", str(tmp_path / "in"), 3)
    calls = []

    def catalog():
        calls.append(1)
        return spark.createDataFrame([("S0", "P0", 1), ("S1", "P1", 1 if len(calls) > 1 else 0), ("S2", "P2", 0)],
                                     "symbol string, product_id string, is_active int")

    stream = tk.file_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    totals = live.run_intake(stream, catalog, "feed", "arrival_ms", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert totals == {"total_received": 60, "total_validated": 48, "total_rejected": 12}
    got = sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    first = len(docs) // 3 + 1
    assert len(calls) == 3
    assert got == [i for i in range(60) if i % 5 and (i % 3 == 0 or (i % 3 == 1 and i >= first))]


def test_stream_gaps_equal_the_batch_twin(spark, tmp_path):
    rnd = random.Random(4)
    rows, t = [], 0.0
    for _ in range(300):
        t += rnd.choice([0.5, 1, 2, 8])
        rows.append((rnd.choice(["A", "B"]), T0 + timedelta(seconds=t)))
    schema = write_parts(spark, rows, "symbol string, ts timestamp", str(tmp_path / "in"))
    stream = tk.file_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    tk.run_available(tk.stream_gaps(stream, "symbol"), str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out")).filter("not open").collect()
    batch = tk.gaps(spark.read.parquet(str(tmp_path / "in")), ["symbol"]).collect()
    assert sorted((r.key, r.gap_start, r.gap_seconds) for r in out) == sorted((r.symbol, r.gap_start, r.gap_seconds) for r in batch)
    assert len(batch) > 50


def test_snapshot_sink_keeps_the_latest_tick_through_redelivery(spark, tmp_path):
    rows = [(s, i, float(i)) for i in range(40) for s in ("A", "B")]
    schema = write_parts(spark, rows, "symbol string, timestamp bigint, close double", str(tmp_path / "in"))
    for run in ("1", "2"):
        stream = tk.file_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
        tk.run_available(stream, "", str(tmp_path / f"cp{run}"), "append", tk.snapshot_sink(str(tmp_path / "snap"), buckets=4))
        got = {r.symbol: (r.updated_at, r.snapshot.close) for r in spark.read.parquet(str(tmp_path / "snap")).collect()}
        assert got == {"A": (39, 39.0), "B": (39, 39.0)}


def test_normalise_and_validate(spark):
    base = {"symbol": "IM2406", "timestamp": 1000, "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 3}
    docs = [base, {**base, "timestamp": -1, "high": 0.1}, {**base, "timestamp": 900000}, {"symbol": "X", "close": -1.0}]
    raw = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, value string")
    t = tk.validate(tk.normalize(raw, "feed"), F.lit(900500))
    got = {r.i: (r.data_quality, r.issues) for r in t.collect()}
    assert got[0] == ("degraded", ["stale"]) and got[1] == ("suspect", ["high_below_low"]) and got[2] == ("normal", [])
    assert got[3][1] == ["missing_open", "missing_high", "missing_low", "missing_volume", "negative_close"]
    assert {r.data_source for r in t.collect()} == {"feed"}
    [c] = tk.counters(t).collect()
    assert (c.total_received, c.total_validated, c.total_rejected) == (4, 3, 1)


def test_streamed_minute_bars_equal_closed_batch_bars(spark, tmp_path):
    rows = [("c", T0 + timedelta(seconds=7 * i), float(i % 13), 1, 1.0) for i in range(200)]
    schema = write_parts(spark, rows, "contract_code string, ts timestamp, close double, volume bigint, turnover double", str(tmp_path / "in"))
    stream = tk.file_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    tk.run_available(tk.live_bars(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in tk.live_bars(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert got <= want and 0 < len(want - got) <= 2
