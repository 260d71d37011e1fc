"""Tick and metric queries; the streaming ones drain the event files through a real stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.plans.bindings import Frames
from tickloom.plans.registry import query
from tickloom.session import shared_dir
from tickloom.streaming import alerts, live, ticks as tk

TICK_SQL = """
SELECT *, CASE WHEN arrival_ms - "timestamp" > 2000 THEN 'degraded'
   WHEN close IS NULL OR open < 0 OR high < 0 OR low < 0 OR close < 0 OR high < low OR implied_volatility > 2 OR abs(delta) > 1
        OR (option_type = 'CALL' AND delta < 0) OR (option_type = 'PUT' AND delta > 0) THEN 'suspect' ELSE 'normal' END AS data_quality,
   CASE WHEN arrival_ms - "timestamp" > 2000 THEN 'stale' ELSE concat_ws(',', CASE WHEN close IS NULL THEN 'missing_close' END, CASE WHEN open < 0 THEN 'negative_open' END,
        CASE WHEN high < 0 THEN 'negative_high' END, CASE WHEN low < 0 THEN 'negative_low' END, CASE WHEN close < 0 THEN 'negative_close' END, CASE WHEN high < low THEN 'high_below_low' END,
        CASE WHEN implied_volatility < 0 OR implied_volatility > 2 THEN 'iv_range' END, CASE WHEN abs(delta) > 1 THEN 'delta_range' END,
        CASE WHEN option_type = 'CALL' AND delta < 0 THEN 'call_delta_sign' END, CASE WHEN option_type = 'PUT' AND delta > 0 THEN 'put_delta_sign' END) END AS issues
FROM raw_ticks"""


def _validated(f):
    return tk.validate(f.raw_ticks, "arrival_ms")


@query("tick_validation", "L24 M02", f"SELECT id, data_quality, issues FROM ({TICK_SQL}) t")
def tick_validation(f):
    return _validated(f).select("id", "data_quality", F.array_join("issues", ",").alias("issues"))


@query("tick_normalisation", "M01", """
SELECT id, symbol, '' AS exchange, 'FUTURE' AS asset_type, open, volume, data_source FROM raw_ticks""")
def tick_normalisation(f):
    doc = F.to_json(F.struct("symbol", "timestamp", "open", "high", "low", "close", "volume", "data_source"))
    raw = f.raw_ticks.select("id", doc.alias("value"))
    return tk.normalize(raw, "feed").select("id", "symbol", "exchange", "asset_type", "open", "volume", "data_source")


@query("tick_counters", "M06", f"""
SELECT count(*) AS total_received, count(CASE WHEN data_quality <> 'degraded' THEN 1 END) AS total_validated, count(CASE WHEN data_quality = 'degraded' THEN 1 END) AS total_rejected FROM ({TICK_SQL}) t""")
def tick_counters(f):
    return tk.counters(_validated(f))


@query("latest_snapshots", "M03 E09", """
SELECT symbol, max("timestamp") AS updated_at, arg_max(open, "timestamp") AS open FROM raw_ticks GROUP BY symbol""")
def latest_snapshots(f):
    return tk.latest_snapshot(f.raw_ticks).select("symbol", "updated_at", F.col("snapshot.open").alias("open"))


@query("live_snapshots_within_ttl", "M03", """
SELECT symbol, updated_at FROM (SELECT symbol, max("timestamp") AS updated_at FROM raw_ticks GROUP BY symbol) s
WHERE (SELECT max("timestamp") FROM raw_ticks) - updated_at <= 36000 * 1000""")
def live_snapshots(f):
    now = f.raw_ticks.agg(F.max("timestamp")).scalar()
    return tk.live_snapshots(tk.latest_snapshot(f.raw_ticks), now, 36000).select("symbol", "updated_at")


@query("tick_gaps", "M04", """
SELECT contract_code, gap_start, ts AS gap_end, round((epoch_us(ts) - epoch_us(gap_start)) / 1e6, 6) AS gap_seconds
FROM (SELECT contract_code, ts, lag(ts) OVER (PARTITION BY contract_code ORDER BY ts) AS gap_start FROM ticks) x
WHERE gap_start IS NOT NULL AND epoch_us(ts) - epoch_us(gap_start) > 5000000 AND strftime(gap_start, '%H:%M') BETWEEN '09:00' AND '15:15'""")
def tick_gaps(f):
    return tk.gaps(f.ticks, ["contract_code"]).withColumn("gap_seconds", F.round("gap_seconds", 6))


@query("source_failovers", "M10", f"""
SELECT data_source, gap_start, ts AS gap_end FROM (SELECT data_source, ts, lag(ts) OVER (PARTITION BY data_source ORDER BY ts) AS gap_start FROM ({TICK_SQL}) t WHERE data_quality <> 'degraded') x
WHERE epoch_us(ts) - epoch_us(gap_start) > 600000000""")
def failovers(f):
    return tk.failovers(_validated(f), seconds=600).drop("gap_seconds")


@query("symbol_quality_metrics", "M05 B27", f"""
SELECT symbol, trade_date, data_source AS source_name, count(*) AS messages, count(CASE WHEN data_quality = 'suspect' THEN 1 END) AS suspect_count,
       greatest(0, arg_min(CASE WHEN data_quality = 'normal' THEN 100 ELSE 50 END, id) - (count(*) - 1)) AS quality_score
FROM ({TICK_SQL}) t WHERE data_quality <> 'degraded' GROUP BY symbol, trade_date, data_source""")
def quality_metrics(f):
    return tk.quality_metrics(tk.accepted(_validated(f)), "id")


@query("active_symbol_enrichment", "M11", """
SELECT r.id, r.symbol, 'P' || (CAST(substr(r.symbol, 2) AS BIGINT) % 4) AS product_id FROM raw_ticks r WHERE CAST(substr(r.symbol, 2) AS BIGINT) % 4 <> 0""")
def active_symbols(f):
    n = F.substring("symbol", 2, 20).cast("bigint") % 4
    catalog = f.raw_ticks.select("symbol").distinct().select("symbol", F.concat(F.lit("P"), n.cast("string")).alias("product_id"),
                                                            F.when(n != 0, 1).otherwise(0).alias("is_active"))
    return tk.active_only(f.raw_ticks, catalog).select("id", "symbol", "product_id")


@query("redelivery_dropped", "M12", "SELECT id, symbol FROM raw_ticks")
def redelivery(f):
    twice = f.raw_ticks.select("id", "symbol", "ts").unionByName(f.raw_ticks.select("id", "symbol", "ts"))
    return tk.deduplicate(twice, ["id"]).select("id", "symbol")


@query("minute_bars_from_ticks", "M09", """
SELECT contract_code, time_bucket(INTERVAL 1 MINUTE, ts) AS bar_start, arg_min(close, ts) AS open, max(close) AS high, min(close) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume
FROM ticks WHERE close IS NOT NULL GROUP BY ALL""")
def minute_bars(f):
    return tk.live_bars(f.ticks, 1).drop("turnover")


RULES = [alerts.AlertRule("hot_purchase", "purchase", ">", 60.0, 0, 300), alerts.AlertRule("cold_view", "view", "<=", 5.0, 0, 300),
         alerts.AlertRule("calm_click", "click", "<", 80.0, 3600, 7200), alerts.AlertRule("off", "error", ">", 0.0, 0, 0, "info", False)]
RULE_SQL = "(VALUES ('hot_purchase', 'purchase', 1, 60e0), ('cold_view', 'view', 2, 5e0), ('calm_click', 'click', 3, 80e0)) r(name, metric_name, op, threshold)"
MET_SQL = "CASE r.op WHEN 1 THEN m.value > r.threshold WHEN 2 THEN m.value <= r.threshold ELSE m.value < r.threshold END"


@query("alert_breaches", "M07", f"""
SELECT r.name, m.metric_name, m.ts, m.value FROM metrics m JOIN {RULE_SQL} ON r.metric_name = m.metric_name WHERE {MET_SQL}""")
def alert_breaches(f):
    return alerts.breaches(f.metrics, alerts.rules_frame(f.spark, RULES)).drop("level")


@query("alert_breach_runs", "M07", f"""
WITH e AS (SELECT r.name, m.metric_name, m.ts, m.value, {MET_SQL} AS met FROM metrics m JOIN {RULE_SQL} ON r.metric_name = m.metric_name),
g AS (SELECT *, max(CASE WHEN NOT met THEN ts END) OVER (PARTITION BY name ORDER BY ts) AS miss FROM e)
SELECT name, metric_name, min(ts) AS run_start, max(ts) AS run_end, count(*) AS points, max(value) AS max_value, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS run_seconds
FROM g WHERE met GROUP BY name, metric_name, miss""")
def breach_runs(f):
    return alerts.breach_runs(f.metrics, alerts.rules_frame(f.spark, RULES)).withColumn("run_seconds", F.round("run_seconds", 6))


@query("metric_counters_and_gauges", "M08", """
SELECT metric_name, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS total, count(*) AS increments, arg_max(value, ts) AS gauge FROM metrics GROUP BY metric_name""")
def counters_gauges(f):
    m = f.metrics
    c = alerts.counter_totals(m.withColumn("value", F.col("value").cast("decimal(18,2)"))).withColumn("total", F.col("total").cast("double"))
    return c.join(alerts.gauge_values(m).select("metric_name", F.col("value").alias("gauge")), "metric_name")


@query("metric_histograms", "D24 M08", """
SELECT metric_name, count(*) AS "count", min(value) AS min, max(value) AS max, round(CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) / count(*), 6) AS avg,
       list_sort(array_agg(value))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] AS p50, list_sort(array_agg(value))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95,
       list_sort(array_agg(value))[CAST(floor(count(*) * 0.99) AS BIGINT) + 1] AS p99
FROM metrics GROUP BY metric_name""")
def histograms(f):
    return alerts.histogram_stats(f.metrics).withColumn("avg", F.round("avg", 6))


@query("metric_histograms_merged", "D24 M08", """
SELECT metric_name, count(*) AS "count", min(value) AS min, max(value) AS max, TRUE AS p50_within, TRUE AS p95_within, TRUE AS p99_within
FROM metrics GROUP BY metric_name""")
def merged_histograms(f):
    """Histograms from hourly sketches; each quantile is held against its rank among all points."""
    got = alerts.merged_histogram(alerts.metric_sketches(f.metrics, unit="hour"))
    fractions = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    ranks = f.metrics.join(got, "metric_name").groupBy("metric_name").agg(
        *[F.avg((F.col("value") < F.col(p)).cast("int")).alias(f"{p}_below") for p in fractions],
        *[F.avg((F.col("value") <= F.col(p)).cast("int")).alias(f"{p}_upto") for p in fractions])
    within = [((F.col(f"{p}_below") <= q + alerts.RANK_ERROR) & (F.col(f"{p}_upto") >= q - alerts.RANK_ERROR)).alias(f"{p}_within")
              for p, q in fractions.items()]
    return got.join(ranks, "metric_name").select("metric_name", "count", "min", "max", *within)


# ------------------------------------------------------------------ real streams over the event files

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


#: Micro-batches that a replay is cut into.
SLICES = 4
#: Rows that a file of a replay holds, about.
FILE_ROWS = 200_000


def _drain(f, build, mode: str = "append"):
    """Run ``build`` over a stream of the event files until drained and read back its output."""
    work = f"{shared_dir(f.spark)}/{uuid.uuid4().hex}"
    stream = tk.file_stream(f.spark, f"{f.sf_dir}/events*.parquet", EVENT_SCHEMA) \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    out = build(stream)
    tk.run_available(out, f"{work}/out", f"{work}/checkpoint", mode)
    return f.spark.read.schema(out.schema).parquet(f"{work}/out")


def _write_files(part: DataFrame, files: int, path: str, before: int) -> None:
    """Adds ``part`` to a folder of ``before`` files as exactly ``files`` more. A task without rows
    writes none, so empty ones fill up."""
    spark = part.sparkSession
    part.repartition(files, *part.columns).write.mode("append").parquet(path)
    for _ in range(before + files - len(spark.read.schema(part.schema).parquet(path).inputFiles())):
        spark.createDataFrame([], part.schema).coalesce(1).write.mode("append").parquet(path)


def _replayed(f, slices: int = SLICES):
    """A stream of all events in the order of their time, one micro-batch per slice; its work folder.

    The files are written slice after slice, so that their age gives the order. Every slice has the
    same number of files, as many as its rows ask for, so that writing and reading it is spread.
    """
    work = f"{shared_dir(f.spark)}/{uuid.uuid4().hex}"
    events = f.table("events").select(*EVENT_SCHEMA.names)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    total, cuts = events.agg(F.count(F.lit(1)), F.percentile_approx(at, [i / slices for i in range(1, slices)])).first()
    files = max(1, total // (slices * FILE_ROWS))
    for i, (low, high) in enumerate(zip([None, *(cuts or [])], [*(cuts or []), None], strict=True)):
        part = events if low is None else events.where(at > low)
        part = part if high is None else part.where(at <= high)
        _write_files(part, files, f"{work}/in", i * files)
    stream = tk.file_stream(f.spark, f"{work}/in", EVENT_SCHEMA, files_per_trigger=files)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")), work


def _run(f, build, mode: str = "append"):
    """Run ``build`` over the replayed events and read back its output."""
    stream, work = _replayed(f)
    out = build(stream)
    tk.run_available(out, f"{work}/out", f"{work}/checkpoint", mode)
    return f.spark.read.schema(out.schema).parquet(f"{work}/out")


@query("stream_minute_bars", "M09", """
WITH b AS (SELECT user_id, time_bucket(INTERVAL 1 MINUTE, ts) AS bar_start, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close FROM events GROUP BY ALL)
SELECT * FROM b WHERE bar_start + INTERVAL 1 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 2 SECOND""")
def stream_bars(f):
    def build(s):
        rows = s.select("user_id", "ts", F.col("value").alias("close"), F.lit(1).alias("volume"), F.lit(0.0).alias("turnover"))
        return tk.live_bars(rows, 1, ["user_id"]).select("user_id", "bar_start", "open", "high", "low", "close")

    return _drain(f, build).withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))


@query("stream_redelivery_dropped", "M12", "SELECT event_id, user_id FROM events")
def stream_dedup(f):
    def build(s):
        twice = s.select("event_id", "user_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
        return tk.deduplicate(twice, ["event_id"]).select("event_id", "user_id")

    return _drain(f, build)


@query("stream_tick_gaps", "M04", """
SELECT 'U' || user_id AS key, prev AS gap_start, t AS gap_end, round((t - prev) / 1e3, 3) AS gap_seconds FROM (
  SELECT user_id, epoch_us(ts) // 1000 AS t, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events) x
WHERE t - prev > 5000 AND strftime(make_timestamp(prev * 1000), '%H:%M') BETWEEN '09:00' AND '15:15'""")
def stream_gaps(f):
    def build(s):
        return tk.stream_gaps(s.withColumn("symbol", F.concat(F.lit("U"), F.col("user_id").cast("string"))), "symbol")

    out = _drain(f, build).filter("not open")
    return out.select("key", F.unix_millis("gap_start").alias("gap_start"), F.unix_millis("gap_end").alias("gap_end"),
                      F.round("gap_seconds", 3).alias("gap_seconds"))


@query("stream_alerts", "M07", f"""
WITH RECURSIVE r AS (SELECT * FROM (VALUES ('hot_purchase', 'purchase', 1, 60e0, 0, 300000000), ('cold_view', 'view', 2, 5e0, 0, 300000000),
    ('calm_click', 'click', 3, 80e0, 3600000000, 7200000000)) r(name, metric_name, op, threshold, dur, cool)),
e AS (SELECT r.name, r.metric_name, r.dur, r.cool, epoch_us(m.ts) AS us, m.value, {MET_SQL} AS met FROM metrics m JOIN r ON r.metric_name = m.metric_name),
s AS (SELECT name, metric_name, dur, cool, bool_and(met) AS met, CASE WHEN dur > 0 THEN max(mark) ELSE min(mark) END AS us,
             CASE WHEN dur > 0 THEN arg_max(value, mark) ELSE arg_min(value, mark) END AS value
      FROM (SELECT *, us AS mark, us // 1000000 AS sec FROM e WHERE met OR dur > 0) x
      WHERE (sec + 1) * 1000 <= (SELECT max(epoch_us(ts)) // 1000 - 2000 FROM metrics) GROUP BY name, metric_name, dur, cool, sec),
p AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY us) AS n,
             min(us) OVER (PARTITION BY name ORDER BY us RANGE BETWEEN dur PRECEDING AND CURRENT ROW) AS opens,
             max(CASE WHEN NOT met THEN us END) OVER (PARTITION BY name ORDER BY us) AS missed FROM s),
f AS (SELECT name, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS fired, CAST(NULL AS BIGINT) AS holding, false AS hit FROM r
      UNION ALL
      SELECT name, n, CASE WHEN hit THEN us ELSE fired END, CASE WHEN waits THEN holding WHEN hit OR NOT clear THEN NULL ELSE since END, hit FROM (
        SELECT *, NOT waits AND clear AND us - since >= dur AS hit FROM (
          SELECT p.name, p.n, p.us, p.dur, f.fired, f.holding, coalesce(p.us - f.fired < p.cool, false) AS waits,
                 p.met AND (p.dur = 0 OR coalesce(p.missed < p.us - p.dur, true)) AS clear, coalesce(f.holding, p.opens) AS since
          FROM f JOIN p ON p.name = f.name AND p.n = f.n + 1) a) b)
SELECT p.name, p.metric_name, make_timestamp(p.us) AS ts, p.value, 'warning' AS level FROM f JOIN p ON p.name = f.name AND p.n = f.n WHERE f.hit""")
def stream_alerts(f):
    rules = alerts.rules_frame(f.spark, RULES)
    out = _run(f, lambda s: alerts.stream_alerts(s.select(F.col("event_type").alias("metric_name"), "ts", "value"), rules))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _raw(stream):
    """The tick columns of the events of a stream."""
    class Source(Frames):
        def table(self, name):
            return stream

    return Source(stream.sparkSession, "").raw_ticks.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_failovers", "M10", f"""
SELECT data_source AS key, prev AS gap_start, t AS gap_end FROM (
  SELECT data_source, epoch_us(ts) // 1000 AS t, lag(epoch_us(ts) // 1000) OVER (PARTITION BY data_source ORDER BY ts) AS prev
  FROM ({TICK_SQL}) t WHERE data_quality <> 'degraded') x
WHERE t - prev > 600000 AND (t // 600000 + 1) * 600000 <= (SELECT max("timestamp") - 2000 FROM ({TICK_SQL}) u WHERE data_quality <> 'degraded')""")
def stream_failovers(f):
    out = _run(f, lambda s: tk.stream_failovers(tk.validate(_raw(s), "arrival_ms"), seconds=600)).filter("not open")
    return out.select("key", F.unix_millis("gap_start").alias("gap_start"), F.unix_millis("gap_end").alias("gap_end"))


#: Times to live of the replayed snapshots: six hours, and thirty for stale ticks.
HOURS_6, HOURS_30 = 21_600_000, 108_000_000
SNAPSHOT_SQL = f"""
SELECT symbol, "timestamp" AS updated_ms, "timestamp" + ttl AS expired_ms, open, next IS NULL AS newest,
       CASE WHEN next IS NOT NULL THEN next - "timestamp" > ttl
            ELSE "timestamp" + ttl < (SELECT max("timestamp") - 2000 FROM raw_ticks) END AS expired
FROM (SELECT *, lead("timestamp") OVER (PARTITION BY symbol ORDER BY "timestamp", id) AS next,
             CASE WHEN data_quality = 'degraded' THEN {HOURS_30} ELSE {HOURS_6} END AS ttl FROM ({TICK_SQL}) t) x"""


def _snapshot_events(f):
    return _run(f, lambda s: live.stream_snapshots(tk.validate(_raw(s), "arrival_ms"), ttl=HOURS_6, degraded_ttl=HOURS_30))


@query("stream_live_snapshots", "M03", f"SELECT symbol, updated_ms, open FROM ({SNAPSHOT_SQL}) s WHERE newest AND NOT expired")
def stream_live_snapshots(f):
    return live.live_now(_snapshot_events(f)).select(
        "symbol", "updated_ms", F.get_json_object("snapshot", "$.open").cast("double").alias("open"))


@query("stream_snapshot_expirations", "M03", f"SELECT symbol, updated_ms, expired_ms FROM ({SNAPSHOT_SQL}) s WHERE expired")
def stream_snapshot_expirations(f):
    return live.expirations(_snapshot_events(f))


def _intake(f):
    """Runs the intake chain over the replayed events; what it wrote and its totals."""
    stream, work = _replayed(f)
    doc = F.to_json(F.struct("symbol", "timestamp", "open", "high", "low", "close", "volume", "implied_volatility", "delta",
                             "option_type", "data_source"))
    raw = _raw(stream).select("id", "arrival_ms", doc.alias("value"))
    n = F.substring("symbol", 2, 20).cast("bigint") % 4
    f.raw_ticks.select("symbol").distinct().select(
        "symbol", F.concat(F.lit("P"), n.cast("string")).alias("product_id"), F.when(n != 0, 1).otherwise(0).alias("is_active")) \
        .write.parquet(f"{work}/catalog")
    totals = live.run_intake(raw, lambda: f.spark.read.parquet(f"{work}/catalog"), "feed", "arrival_ms", f"{work}/out",
                             f"{work}/checkpoint")
    return f.spark.read.parquet(f"{work}/out"), totals


@query("stream_intake", "M01 M02 M11", f"""
SELECT id, symbol, 'P' || (CAST(substr(symbol, 2) AS BIGINT) % 4) AS product_id, data_source, data_quality, issues FROM ({TICK_SQL}) t
WHERE data_quality <> 'degraded' AND CAST(substr(symbol, 2) AS BIGINT) % 4 <> 0""")
def stream_intake(f):
    out, _ = _intake(f)
    return out.select("id", "symbol", "product_id", "data_source", "data_quality", F.array_join("issues", ",").alias("issues"))


@query("stream_tick_counters", "M06", f"""
SELECT count(*) AS total_received, count(CASE WHEN data_quality <> 'degraded' THEN 1 END) AS total_validated, count(CASE WHEN data_quality = 'degraded' THEN 1 END) AS total_rejected FROM ({TICK_SQL}) t""")
def stream_tick_counters(f):
    _, totals = _intake(f)
    names = ["total_received", "total_validated", "total_rejected"]
    return f.spark.createDataFrame([tuple(totals.get(n, 0) for n in names)], ", ".join(f"{n} long" for n in names))
