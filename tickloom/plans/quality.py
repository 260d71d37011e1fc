"""Data-quality queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import quality as qa
from tickloom.operators import query as Q
from tickloom.operators import trading
from tickloom.plans.registry import query
from tickloom.session import shared_dir, staged

CAT = ["catalog_id"]


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("price_spikes", "L01 C03 C04", """
SELECT exchange, contract_code, trade_date, prev_close, close, round(abs(close - prev_close) / prev_close * 100, 2) AS pct_change
FROM (SELECT *, lag(close) OVER (PARTITION BY exchange, contract_code ORDER BY trade_date) AS prev_close FROM daily_quotes WHERE close > 0) x
WHERE abs(close - prev_close) / prev_close > 0.2""")
def price_spikes(f):
    return qa.price_spikes(f.daily_quotes)


@query("price_spikes_all_later_days", "C04", """
SELECT b.exchange, b.contract_code, b.trade_date, a.trade_date AS prev_date, a.close AS prev_close, b.close FROM daily_quotes a
JOIN daily_quotes b ON b.exchange = a.exchange AND b.contract_code = a.contract_code AND b.trade_date > a.trade_date AND b.trade_date <= a.trade_date + 3
WHERE a.close > 0 AND b.close > 0 AND abs(b.close - a.close) / a.close > 0.2""")
def spikes_all(f):
    return qa.price_spikes_all_pairs(f.daily_quotes, 3).select("exchange", "contract_code", "trade_date", "prev_date", "prev_close", "close")


@query("volume_anomalies", "L02 E14", """
SELECT exchange, contract_code, trade_date, volume, round(m, 6) AS avg_volume FROM (
  SELECT *, CAST(sum(volume) OVER w AS DOUBLE) / count(*) OVER w AS m FROM daily_quotes
  WINDOW w AS (PARTITION BY exchange, contract_code ORDER BY trade_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)) x
WHERE volume > 0 AND m > 0 AND volume > m * 3""")
def volume_anomalies(f):
    return rounded(qa.volume_anomalies(f.daily_quotes), 6, "avg_volume")


@query("volume_anomalies_anchored", "L02 E14", """
SELECT exchange, contract_code, trade_date, volume, round(m, 6) AS avg_volume FROM (
  SELECT *, CAST(sum(volume) OVER w AS DOUBLE) / count(*) OVER w AS m FROM daily_quotes WHERE trade_date >= DATE '2000-06-30' - 30
  WINDOW w AS (PARTITION BY exchange, contract_code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x
WHERE volume > 0 AND m > 0 AND volume > m * 3""")
def volume_anchored(f):
    return rounded(qa.volume_anomalies(f.daily_quotes, ref="2000-06-30"), 6, "avg_volume")


@query("zero_prices", "L03", "SELECT exchange, contract_code, CAST(ts AS DATE) AS trade_date, volume FROM ticks WHERE coalesce(close, 0) = 0 AND volume > 0")
def zero_prices(f):
    return qa.zero_prices(f.ticks)


@query("position_spikes", "L04 E13", """
SELECT * FROM (SELECT exchange, contract_code, trade_date, t AS curr_total, lag(t) OVER (PARTITION BY exchange, contract_code ORDER BY trade_date) AS prev_total
  FROM (SELECT exchange, contract_code, trade_date, CAST(sum(long_volume + short_volume) AS BIGINT) AS t FROM positions GROUP BY ALL) a) b
WHERE prev_total > 0 AND abs(curr_total - prev_total) / CAST(prev_total AS DOUBLE) > 0.05""")
def position_spikes(f):
    return qa.position_spikes(f.positions, 0.05)


@query("iv_anomalies", "L05 E15", """
SELECT contract_code, trade_date, prev_iv, iv FROM (SELECT *, lag(iv) OVER (PARTITION BY contract_code ORDER BY trade_date) AS prev_iv FROM chain) x WHERE abs(iv - prev_iv) > 0.3""")
def iv_anomalies(f):
    return qa.iv_anomalies(f.chain)


ANOMALY_SQL = """
SELECT * FROM (SELECT exchange, contract_code, trade_date, unnest(string_split(concat_ws(',',
   CASE WHEN (close = 0 OR settle = 0) AND volume > 0 THEN 'zero_price' END, CASE WHEN pc > 0 AND abs(close - pc) * 100.0 / pc > 9 THEN 'extreme_change' END,
   CASE WHEN close > 0 AND volume = 0 THEN 'zero_volume_with_price' END, CASE WHEN close > 0 AND settle > 0 AND abs(close - settle) * 100.0 / settle > 2 THEN 'close_settle_divergence' END,
   CASE WHEN volume < 0 THEN 'negative_volume' END), ',')) AS "check"
FROM (SELECT *, lag(close) OVER (PARTITION BY exchange, contract_code ORDER BY trade_date) AS pc FROM daily_quotes) q) v WHERE "check" <> ''"""


@query("daily_anomaly_rules", "L06 C03", ANOMALY_SQL)
def daily_anomalies(f):
    return qa.daily_anomalies(f.daily_quotes)


@query("daily_anomalies_capped", "F08", f"""
SELECT exchange, contract_code, trade_date, "check" FROM (
  SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY trade_date DESC, contract_code) AS r FROM ({ANOMALY_SQL}) a) b WHERE r <= 20""")
def capped(f):
    return qa.cap_issues(qa.daily_anomalies(f.daily_quotes), 20, [F.desc("trade_date"), "contract_code"])


@query("position_consistency", "L07", """
SELECT exchange, contract_code, count(*) AS total_rows, count(CASE WHEN rank < 1 OR rank > 20 THEN 1 END) AS bad_rank, 0 AS negative_volume, 0 AS empty_member,
       round(greatest(0, 100 - count(CASE WHEN rank < 1 OR rank > 20 THEN 1 END) / CAST(count(*) AS DOUBLE) * 200), 4) AS score
FROM positions GROUP BY exchange, contract_code""")
def position_consistency(f):
    return rounded(qa.position_consistency(f.positions), 4, "score")


# ------------------------------------------------------------------ completeness and scores

COMPLETE_SQL = """
SELECT c.catalog_id, c.earliest_date, c.latest_date, e.expected_days, coalesce(a.actual_days, 0) AS actual_days, greatest(0, e.expected_days - coalesce(a.actual_days, 0)) AS missing_days,
       round(CAST(e.expected_days - greatest(0, e.expected_days - coalesce(a.actual_days, 0)) AS DOUBLE) / e.expected_days * 100, 2) AS completeness_pct
FROM catalogs c
JOIN (SELECT catalog_id, count(*) AS expected_days FROM catalogs JOIN resolved r ON r.is_trading AND r.trade_date BETWEEN earliest_date AND latest_date GROUP BY catalog_id) e ON e.catalog_id = c.catalog_id
LEFT JOIN (SELECT q.catalog_id, count(DISTINCT q.trade_date) AS actual_days FROM catalog_quotes q JOIN resolved r ON r.is_trading AND r.trade_date = q.trade_date GROUP BY q.catalog_id) a ON a.catalog_id = c.catalog_id"""


def _complete(f):
    return qa.completeness(f.catalogs, f.catalog_quotes, f.resolved, CAT)


@query("catalog_completeness", "L09 C08", COMPLETE_SQL, staged=True)
def catalog_completeness(f):
    return _complete(f).drop("status")


@query("minute_completeness", "L10", """
SELECT c.contract_code, d.trade_date, '60min' AS frequency, coalesce(n.a, 0) AS actual_count, CASE WHEN coalesce(n.a, 0) = 0 THEN 0 ELSE 4 END AS expected_count,
       CASE WHEN coalesce(n.a, 0) = 0 THEN 0 ELSE round(least(100.0, n.a / 4e0 * 100), 1) END AS completeness_pct,
       CASE WHEN coalesce(n.a, 0) = 0 THEN 'missing' WHEN n.a >= 3.6 THEN 'complete' WHEN n.a >= 3 THEN 'partial' ELSE 'incomplete' END AS status
FROM (SELECT DISTINCT contract_code FROM ticks) c, (SELECT DISTINCT trade_date FROM ticks) d
LEFT JOIN (SELECT contract_code, CAST(ts AS DATE) AS trade_date, count(DISTINCT date_trunc('hour', ts)) AS a FROM ticks WHERE close IS NOT NULL GROUP BY ALL) n
  ON n.contract_code = c.contract_code AND n.trade_date = d.trade_date""")
def minute_completeness(f):
    return _minute_days(f)


def _minute_days(f):
    from tickloom.operators import bars
    span = f.ticks.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    first, last = span.select("a").scalar(), span.select("b").scalar()
    expected = f.ticks.select("contract_code").distinct().select(
        "contract_code", F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("trade_date"), F.lit("60min").alias("frequency"))
    return qa.minute_completeness(bars.resample(f.ticks, ["60min"]), expected)


@query("minute_range_score", "L10", """
WITH d AS (SELECT c.contract_code, d.trade_date, coalesce(n.a, 0) AS a FROM (SELECT DISTINCT contract_code FROM ticks) c, (SELECT DISTINCT trade_date FROM ticks) d
LEFT JOIN (SELECT contract_code, CAST(ts AS DATE) AS trade_date, count(DISTINCT date_trunc('hour', ts)) AS a FROM ticks WHERE close IS NOT NULL GROUP BY ALL) n
  ON n.contract_code = c.contract_code AND n.trade_date = d.trade_date)
SELECT contract_code, count(*) AS total_days, count(CASE WHEN a >= 3.6 THEN 1 END) AS complete_days, count(CASE WHEN a = 3 THEN 1 END) AS partial_days, count(CASE WHEN a = 0 THEN 1 END) AS missing_days,
       round((count(CASE WHEN a >= 3.6 THEN 1 END) + count(CASE WHEN a = 3 THEN 1 END) * 0.5) / CAST(count(*) AS DOUBLE) * 100, 1) AS overall_pct FROM d GROUP BY contract_code""")
def range_score(f):
    return qa.minute_range_score(_minute_days(f), ["contract_code"])


def _diffs(f):
    """Two price sources per contract and day: the ticks of two event types."""
    rows = f.ticks.filter("source in ('view', 'purchase')").groupBy("contract_code", "trade_date", "source").agg(F.max("price").alias("close"))
    return qa.compare_sources(rows, "view", "purchase", ["contract_code", "trade_date"], threshold_pct=50.0)


DIFF_SQL = """
SELECT contract_code, trade_date, value_a, value_b, CASE WHEN value_a IS NOT NULL AND value_b IS NOT NULL THEN round(CASE WHEN value_b <> 0 THEN abs(value_a - value_b) / abs(value_b) * 100 ELSE 0 END, 4) END AS deviation_pct,
       CASE WHEN value_a IS NULL OR value_b IS NULL THEN 'skipped' WHEN abs(value_a - value_b) / abs(value_b) * 100 > 50 THEN 'alert' ELSE 'normal' END AS status
FROM (SELECT contract_code, trade_date, max(CASE WHEN source = 'view' THEN price END) AS value_a, max(CASE WHEN source = 'purchase' THEN price END) AS value_b
      FROM ticks WHERE source IN ('view', 'purchase') GROUP BY ALL) p"""


@query("source_deviation", "L11", DIFF_SQL)
def source_deviation(f):
    return _diffs(f)


def _diff_log(f):
    return _diffs(f).filter("status <> 'skipped'").select(
        F.col("contract_code").alias("catalog_id"), "trade_date", "deviation_pct", F.datediff("trade_date", F.lit("2024-01-01").cast("date")).alias("id"),
        F.when(F.col("status") == "alert", 1).otherwise(0).alias("is_alert"))


@query("deviation_alert_summary", "D27", f"""
SELECT count(*) AS total_alerts, count(DISTINCT contract_code) AS affected_catalogs, count(DISTINCT trade_date) AS affected_dates FROM ({DIFF_SQL}) d
WHERE status = 'alert' AND trade_date >= DATE '2024-01-31' - 14""")
def deviation_summary(f):
    return qa.deviation_summary(_diff_log(f), "2024-01-31", 14)


@query("accuracy_scores", "E20 L08", f"""
SELECT contract_code AS catalog_id, round(greatest(0, 100 - CAST(sum(CAST(deviation_pct AS DECIMAL(28,10))) AS DOUBLE) / count(*) * 20), 6) AS accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY contract_code ORDER BY trade_date DESC) AS r FROM ({DIFF_SQL}) d WHERE status <> 'skipped') x WHERE r <= 10 GROUP BY contract_code""")
def accuracy(f):
    return rounded(qa.accuracy_score(_diff_log(f), 10), 6, "accuracy")


def _counts(f):
    return f.catalog_quotes.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("actual_total"))


def _status(f):
    """Recorded totals that drift from the real ones by a rule on the product name."""
    n = F.length("product_code")
    return f.catalog_quotes.groupBy("catalog_id", "product_code").agg(
        (F.count(F.lit(1)) + F.when(n % 3 == 0, 0).when(n % 3 == 1, 7).otherwise(100000)).alias("recorded_total"),
        F.min("trade_date").alias("earliest_date"), F.max("trade_date").alias("latest_date")).drop("product_code")


DRIFT_SQL = """
SELECT catalog_id, n + off AS recorded_total, n AS actual_total, off AS drift, CASE WHEN off = 0 THEN 'ok' WHEN off < greatest(n * 0.01, 100) THEN 'warn' ELSE 'error' END AS drift_status
FROM (SELECT catalog_id, count(*) AS n, CASE length(product_code) % 3 WHEN 0 THEN 0 WHEN 1 THEN 7 ELSE 100000 END AS off FROM catalog_quotes GROUP BY catalog_id, product_code) x"""


@query("recorded_vs_actual_totals", "L12 L26", DRIFT_SQL)
def recorded_vs_actual(f):
    return qa.recorded_vs_actual(_status(f), _counts(f)).select("catalog_id", "recorded_total", "actual_total", "drift", "drift_status")


@query("totals_reconciled", "L26", "SELECT catalog_id, count(*) AS total_records FROM catalog_quotes GROUP BY catalog_id")
def totals_reconciled(f):
    s = _status(f).withColumnRenamed("recorded_total", "total_records")
    return qa.reconcile_totals(s, _counts(f)).select("catalog_id", "total_records")


@query("quality_overview", "L12", f"""
WITH d AS ({DRIFT_SQL}), c AS ({COMPLETE_SQL}),
m AS (SELECT k.catalog_id, r.trade_date, row_number() OVER (PARTITION BY k.catalog_id ORDER BY r.trade_date) AS rn FROM catalogs k JOIN resolved r ON r.is_trading AND r.trade_date BETWEEN k.earliest_date AND k.latest_date
      WHERE (k.catalog_id, r.trade_date) NOT IN (SELECT (catalog_id, trade_date) FROM catalog_quotes)),
f AS (SELECT catalog_id, string_agg(CAST(trade_date AS VARCHAR), ',' ORDER BY trade_date) AS missing_dates FROM m GROUP BY catalog_id)
SELECT d.catalog_id, d.drift, d.drift_status, c.expected_days, c.actual_days, c.missing_days, c.completeness_pct, f.missing_dates
FROM d LEFT JOIN c ON c.catalog_id = d.catalog_id LEFT JOIN f ON f.catalog_id = d.catalog_id""", staged=True)
def quality_overview(f):
    missing = qa.missing_dates(f.catalogs, f.catalog_quotes, f.resolved, CAT)
    out = qa.overview(_status(f), _counts(f), _complete(f), missing)
    return out.select("catalog_id", "drift", "drift_status", "expected_days", "actual_days", "missing_days", "completeness_pct",
                      F.array_join(F.transform("missing_dates", lambda d: d.cast("string")), ",").alias("missing_dates"))


# Series under watch: the daily one of every exchange and product, and the rankings of every contract.
# The second price source reports whole numbers.
SCORE_SQL = f"""
WITH tr AS (SELECT catalog_id, exchange_code, data_type, earliest_date, latest_date FROM catalogs
            UNION ALL SELECT 'POS/' || contract_code, 'EX0', 'position', min(trade_date), max(trade_date) FROM positions GROUP BY contract_code),
dd AS (SELECT DISTINCT catalog_id, trade_date FROM catalog_quotes UNION ALL SELECT DISTINCT 'POS/' || contract_code, trade_date FROM positions),
c AS (SELECT t.catalog_id, t.exchange_code, t.data_type, e.expected_days, greatest(0, e.expected_days - coalesce(a.actual_days, 0)) AS missing_days
      FROM tr t JOIN (SELECT catalog_id, count(*) AS expected_days FROM tr JOIN resolved r ON r.is_trading AND r.trade_date BETWEEN earliest_date AND latest_date GROUP BY catalog_id) e ON e.catalog_id = t.catalog_id
      LEFT JOIN (SELECT dd.catalog_id, count(*) AS actual_days FROM dd JOIN resolved r ON r.is_trading AND r.trade_date = dd.trade_date GROUP BY dd.catalog_id) a ON a.catalog_id = t.catalog_id),
an AS (SELECT exchange || '/' || product_code AS catalog_id, count(*) AS n FROM ({ANOMALY_SQL}) x JOIN contracts k USING (contract_code, exchange) GROUP BY ALL),
dv AS (SELECT catalog_id, CAST(sum(d) AS DOUBLE) / count(*) AS mean FROM (
         SELECT catalog_id, CAST(round(abs(close - floor(close)) / floor(close) * 100, 4) AS DECIMAL(28,10)) AS d, dense_rank() OVER (PARTITION BY catalog_id ORDER BY trade_date DESC) AS r FROM catalog_quotes) y
       WHERE r <= 100 GROUP BY catalog_id),
ps AS (SELECT 'POS/' || contract_code AS catalog_id, greatest(0, 100 - count(CASE WHEN rank < 1 OR rank > 20 THEN 1 END) / CAST(count(*) AS DOUBLE) * 100 * 2) AS score FROM positions GROUP BY contract_code),
s AS (SELECT c.catalog_id, c.exchange_code, c.missing_days, round(CAST(c.expected_days - c.missing_days AS DOUBLE) / c.expected_days * 100, 2) AS completeness,
             CASE WHEN dv.mean IS NULL THEN 100e0 ELSE greatest(0e0, 100e0 - dv.mean * 20) END AS accuracy,
             CASE WHEN c.data_type = 'daily' THEN 100e0 - least(50, coalesce(an.n, 0) * 5) ELSE ps.score END AS consistency
      FROM c LEFT JOIN an ON an.catalog_id = c.catalog_id LEFT JOIN dv ON dv.catalog_id = c.catalog_id LEFT JOIN ps ON ps.catalog_id = c.catalog_id),
q AS (SELECT *, completeness * 5e-1 + accuracy * 3e-1 + consistency * 2e-1 AS t FROM s)
SELECT catalog_id, exchange_code, round(completeness, 2) AS completeness, round(accuracy, 2) AS accuracy, round(consistency, 2) AS consistency, round(t, 2) AS total_score,
       CASE WHEN t >= 95 THEN 'excellent' WHEN t >= 85 THEN 'good' WHEN t >= 70 THEN 'fair' WHEN t >= 50 THEN 'poor' ELSE 'critical' END AS quality_level,
       concat_ws(',', CASE WHEN completeness < 90 THEN 'low_completeness' END, CASE WHEN completeness < 70 THEN 'critical_completeness' END,
                 CASE WHEN accuracy < 95 THEN 'accuracy' END, CASE WHEN consistency < 90 THEN 'consistency' END) AS alerts, missing_days
FROM q"""


def _series(f):
    held = f.positions.groupBy(F.concat(F.lit("POS/"), F.col("contract_code")).alias("catalog_id"),
                               F.lit("EX0").alias("exchange_code"), F.col("contract_code").alias("product_code"),
                               F.lit("position").alias("data_type")).agg(
        F.min("trade_date").alias("earliest_date"), F.max("trade_date").alias("latest_date"))
    return f.catalogs.unionByName(held)


def _summary_table(f):
    """The stored quality summary, filled by one batch; all scores read it."""
    quotes = f.catalog_quotes.withColumn("other_close", F.floor("close").cast("double"))
    held = f.positions.withColumn("catalog_id", F.concat(F.lit("POS/"), F.col("contract_code")))
    path = f"{shared_dir(f.spark)}/quality-summary-{uuid.uuid4().hex}"
    qa.update_quality_summary(f.spark, qa.quality_summary(quotes, held), path)
    return f.spark.read.parquet(path)


def _scored(f):
    """Series, scores and completeness."""
    series, summary = staged(_series(f)), _summary_table(f)
    return series, qa.scores_from_summary(series, summary, f.resolved), qa.completeness(series, summary, f.resolved, CAT)


def _scores(f):
    return _scored(f)[1]


@query("catalog_quality_scores", "L08 H16", f"SELECT catalog_id, completeness, accuracy, consistency, total_score, quality_level, alerts FROM ({SCORE_SQL}) z", staged=True)
def quality_scores(f):
    return _scores(f).withColumn("alerts", F.array_join("alerts", ","))


@query("health_snapshot", "L13 E09 H18", f"""
WITH z AS ({SCORE_SQL}), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exchange_code ORDER BY created_at DESC, id DESC) AS rn FROM sync_tasks) y WHERE rn = 1)
SELECT z.catalog_id, z.missing_days, z.total_score AS data_quality_score, z.completeness AS completeness_pct,
       CASE WHEN z.consistency >= 95 THEN 'consistent' WHEN z.consistency >= 80 THEN 'minor_issues' ELSE 'inconsistent' END AS consistency_status,
       coalesce(last.status, 'never_synced') AS last_sync_status, last.error AS last_sync_error
FROM z LEFT JOIN last ON last.exchange_code = z.exchange_code""", staged=True)
def health_snapshot(f):
    return _health(f)[1].select("catalog_id", "missing_days", "data_quality_score", "completeness_pct", "consistency_status", "last_sync_status", "last_sync_error")


def _health(f):
    """Series with their exchange, and the health row of each."""
    series, scores, complete = _scored(f)
    per_catalog = series.select("catalog_id", "exchange_code")
    newest = Q.latest_per_key(f.sync_tasks.drop("catalog_id"), ["exchange_code"], ["created_at", "id"])
    return per_catalog, qa.health_snapshot(scores, complete, per_catalog.join(newest, "exchange_code"), "2001-10-01")


@query("health_by_exchange", "D26", f"""
WITH z AS ({SCORE_SQL}), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exchange_code ORDER BY created_at DESC, id DESC) AS rn FROM sync_tasks) y WHERE rn = 1)
SELECT z.exchange_code, count(*) AS catalog_count, round(CAST(sum(CAST(z.total_score AS DECIMAL(20,4))) AS DOUBLE) / count(*), 1) AS avg_quality,
       count(CASE WHEN last.status = 'completed' THEN 1 END) AS synced_count, count(CASE WHEN z.missing_days > 0 THEN 1 END) AS with_issues
FROM z LEFT JOIN last ON last.exchange_code = z.exchange_code GROUP BY 1""", staged=True)
def health_by_exchange(f):
    series, health = _health(f)
    return qa.health_by_exchange(series, health)


@query("latest_sync_per_task", "E09", """
SELECT catalog_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY created_at DESC, id DESC) AS rn FROM sync_tasks) y WHERE rn = 1""")
def latest_sync(f):
    return Q.latest_per_key(f.sync_tasks, ["catalog_id"], ["created_at", "id"]).select("catalog_id", "id", "status")


@query("last_runs_per_task", "E09 D34", """
SELECT catalog_id AS task_name, max(created_at) AS last_run, CASE WHEN arg_max(status, created_at + to_microseconds(id)) = 'completed' THEN 'success' ELSE 'failed' END AS last_status,
       arg_max(id, created_at + to_microseconds(id)) AS last_records FROM sync_tasks GROUP BY catalog_id""")
def last_runs(f):
    return qa.last_runs(_audit_log(f))


def _audit_log(f):
    return f.sync_tasks.select("id", F.col("catalog_id").alias("task_name"), F.when(F.col("status") == "completed", 1).otherwise(0).alias("success"),
                               F.col("id").alias("records_fetched"), F.col("created_at").alias("end_time"))


@query("dashboard_catalog_panel", "D34", f"""
WITH z AS ({SCORE_SQL}), d AS ({DRIFT_SQL}), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exchange_code ORDER BY created_at DESC, id DESC) AS rn FROM sync_tasks) y WHERE rn = 1)
SELECT z.catalog_id, z.total_score AS quality_score, z.completeness AS completeness_pct, z.missing_days, coalesce(last.status, 'completed') AS sync_status, coalesce(d.recorded_total, 0) AS total_records
FROM z LEFT JOIN d ON d.catalog_id = z.catalog_id LEFT JOIN last ON last.exchange_code = z.exchange_code""", staged=True)
def catalog_panel(f):
    return _panel(f).select("catalog_id", "quality_score", "completeness_pct", "missing_days", "sync_status", "total_records")


def _panel(f):
    status = _status(f).withColumnRenamed("recorded_total", "total_records")
    return qa.catalog_panel(*_health(f), status)


@query("dashboard_summary", "D34 D25", f"""
WITH z AS ({SCORE_SQL})
SELECT (SELECT count(*) FROM z) AS total_catalogs, (SELECT round(CAST(sum(CAST(total_score AS DECIMAL(20,4))) AS DOUBLE) / count(*), 1) FROM z) AS avg_quality_score,
       (SELECT count(*) FROM (SELECT catalog_id, max(created_at) AS m FROM sync_tasks GROUP BY 1) q WHERE CAST(m AS DATE) = DATE '2001-07-31') AS tasks_today,
       (SELECT count(*) FROM (SELECT catalog_id, max(created_at) AS m, arg_max(status, created_at + to_microseconds(id)) AS s FROM sync_tasks GROUP BY 1) q WHERE CAST(m AS DATE) = DATE '2001-07-31' AND s <> 'completed') AS tasks_failed_today,
       3 AS total_tables, (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM events) AS total_records""", staged=True)
def dashboard_summary(f):
    stats = qa.table_stats({n: (f.table(n), None) for n in ("orders", "lineitem", "events")})
    return qa.dashboard_summary(_panel(f), qa.last_runs(_audit_log(f)), stats, "2001-07-31")


@query("table_stats", "D25", """
SELECT 'orders' AS table_name, count(*) AS row_count, 6 AS column_count, CAST(min(o_orderdate) AS DATE) AS earliest, CAST(max(o_orderdate) AS DATE) AS latest FROM orders
UNION ALL SELECT 'lineitem', count(*), 11, CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE) FROM lineitem
UNION ALL SELECT 'supplier', count(*), 4, NULL, NULL FROM supplier""")
def table_stats(f):
    return qa.table_stats({"orders": (f.table("orders"), "o_orderdate"), "lineitem": (f.table("lineitem"), "l_shipdate"),
                           "supplier": (f.table("supplier"), None)})


@query("failures_by_task", "D23 B27", """
SELECT catalog_id, count(*) AS failures, max(created_at) AS last_failure FROM sync_tasks WHERE status = 'failed' AND created_at >= TIMESTAMP '1999-01-01' GROUP BY catalog_id""")
def failures_by_task(f):
    rows = f.sync_tasks.filter("status = 'failed'").withColumnRenamed("created_at", "failed_at")
    return qa.failure_counts(rows, "catalog_id", "1999-01-01")


@query("failures_by_error", "D23", "SELECT error_type, count(*) AS failures, max(created_at) AS last_failure FROM sync_tasks WHERE status = 'failed' GROUP BY error_type")
def failures_by_error(f):
    rows = f.sync_tasks.filter("status = 'failed'").withColumnRenamed("created_at", "failed_at")
    return qa.failure_counts(rows, "error_type")


# ------------------------------------------------------------------ freshness and consistency

FRESH_SQL = """
SELECT s.grp AS "group", s.series, s.latest_date, CASE WHEN s.latest_date > (SELECT max(trade_date) FROM days) THEN 999
       ELSE greatest(0, (SELECT count(*) FROM resolved r WHERE r.is_trading AND r.trade_date >= s.latest_date AND r.trade_date < (SELECT max(trade_date) FROM days)) - 1) END AS lag_trading_days
FROM (SELECT 'contracts' AS grp, 'C' || o_custkey AS series, max(CAST(o_orderdate AS DATE)) AS latest_date FROM orders GROUP BY o_custkey
      UNION ALL SELECT 'iv', underlying, max(trade_date) FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date, CASE l_partkey % 3 WHEN 0 THEN 'MO' WHEN 1 THEN 'IO' ELSE 'HO' END AS underlying
      FROM lineitem) q GROUP BY underlying) s"""


def _fresh(f):
    a = f.table("orders").groupBy(F.lit("contracts").alias("group"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("series")) \
        .agg(F.max(F.to_date("o_orderdate")).alias("latest_date"))
    under = F.element_at(F.array(F.lit("MO"), F.lit("IO"), F.lit("HO")), (F.col("l_partkey") % 3 + 1).cast("int"))
    b = f.table("lineitem") \
        .groupBy(F.lit("iv").alias("group"), under.alias("series")).agg(F.max(F.to_date(F.trunc("l_shipdate", "month"))).alias("latest_date"))
    return qa.freshness(a.unionByName(b), f.resolved, f.days.agg(F.max("trade_date")).scalar())


@query("data_freshness", "L14", f"""
SELECT *, CASE WHEN lag_trading_days <= 1 THEN 'ok' WHEN lag_trading_days <= 3 THEN 'stale' ELSE 'expired' END AS status FROM ({FRESH_SQL}) x""")
def data_freshness(f):
    return _fresh(f)


@query("freshness_verdict", "L14", f"""
SELECT CASE WHEN count(CASE WHEN "group" = 'iv' AND lag_trading_days > 3 THEN 1 END) > 0 THEN 'error' WHEN count(CASE WHEN lag_trading_days > 1 THEN 1 END) > 0 THEN 'degraded' ELSE 'ok' END AS overall,
       round(count(CASE WHEN lag_trading_days <= 1 THEN 1 END) / CAST(count(*) AS DOUBLE), 2) AS healthy_ratio, count(*) AS series_count FROM ({FRESH_SQL}) x""")
def freshness_verdict(f):
    return qa.freshness_verdict(_fresh(f))


@query("cross_series_lag", "L16", f"""
SELECT "group", series, lag_trading_days - min(lag_trading_days) OVER (PARTITION BY "group") AS diff_trading_days,
       lag_trading_days - min(lag_trading_days) OVER (PARTITION BY "group") <= 1 AS consistent FROM ({FRESH_SQL}) x""")
def cross_series_lag(f):
    return qa.lag_consistency(_fresh(f)).select("group", "series", "diff_trading_days", "consistent")


@query("iv_completeness", "L15", """
SELECT underlying, count(*) AS total_dates, count(CASE WHEN n < 8 THEN 1 END) AS incomplete_count, count(CASE WHEN w / CAST(n AS DOUBLE) < 0.8 THEN 1 END) AS low_iv_count
FROM (SELECT underlying, trade_date, count(*) AS n, count(CASE WHEN iv > 0 THEN 1 END) AS w, row_number() OVER (PARTITION BY underlying ORDER BY trade_date DESC) AS r
      FROM (SELECT underlying, trade_date, CASE WHEN volume % 4 <> 0 THEN iv END AS iv FROM chain) c GROUP BY underlying, trade_date) d WHERE r <= 30 GROUP BY underlying""")
def iv_completeness(f):
    return qa.iv_completeness(f.chain.withColumn("iv", F.when(F.col("volume") % 4 != 0, F.col("iv"))), last=30)


@query("cross_store_totals", "L17", """
SELECT 'trades_count' AS "check", CASE WHEN count(*) = count(CASE WHEN volume > 0 THEN 1 END) THEN 'PASS' ELSE 'FAIL' END AS status, CAST(count(*) AS VARCHAR) AS expected,
       CAST(count(CASE WHEN volume > 0 THEN 1 END) AS VARCHAR) AS actual, CAST(count(*) - count(CASE WHEN volume > 0 THEN 1 END) AS DOUBLE) AS deviation FROM trades
UNION ALL SELECT 'trades_sum_turnover', CASE WHEN abs(sum(turnover) - sum(CASE WHEN volume > 0 THEN turnover END)) < 0.01 THEN 'PASS' ELSE 'FAIL' END, CAST(CAST(sum(turnover) AS DECIMAL(28,2)) AS VARCHAR),
       CAST(CAST(sum(CASE WHEN volume > 0 THEN turnover END) AS DECIMAL(28,2)) AS VARCHAR), CAST(abs(sum(turnover) - sum(CASE WHEN volume > 0 THEN turnover END)) AS DOUBLE) FROM trades
UNION ALL SELECT 'trades_sum_commission', CASE WHEN abs(sum(commission) - sum(CASE WHEN volume > 0 THEN commission END)) < 0.01 THEN 'PASS' ELSE 'FAIL' END, CAST(CAST(sum(commission) AS DECIMAL(28,2)) AS VARCHAR),
       CAST(CAST(sum(CASE WHEN volume > 0 THEN commission END) AS DECIMAL(28,2)) AS VARCHAR), CAST(abs(sum(commission) - sum(CASE WHEN volume > 0 THEN commission END)) AS DOUBLE) FROM trades""")
def cross_store(f):
    return qa.cross_store(f.trades, f.trades.filter("volume > 0"), "trades", ["turnover", "commission"]).drop("source")


def _summary(f):
    return trading.monthly_account_summary(f.bills)


CHECKS_SQL = """
WITH g AS (SELECT count(CASE WHEN d > 5 THEN 1 END) AS gaps FROM (SELECT trade_date - lag(trade_date) OVER (ORDER BY trade_date) AS d FROM (SELECT DISTINCT trade_date FROM trades) q) p),
x AS (SELECT count(*) AS n, count(CASE WHEN offset_flag = 'open' THEN 1 END) AS opens, sum(commission) AS fee,
             count(CASE WHEN abs(total_pnl) > (SELECT max(client_equity) FROM account_summary) * 0.5 THEN 1 END) AS extreme FROM trades),
s AS (SELECT sum(commission) AS fee FROM account_summary), m AS (SELECT count(*) AS n FROM matched_trades)
SELECT 'pnl_data_exists' AS "check", 'PASS' AS status, 'trades and account summaries' AS source, 'a result other than 0' AS expected, CAST(n AS VARCHAR) AS actual, 0e0 AS deviation FROM x
UNION ALL SELECT 'fee_consistency', CASE WHEN x.fee / CAST(s.fee AS DOUBLE) < 0.5 OR x.fee / CAST(s.fee AS DOUBLE) > 2 THEN 'FAIL' WHEN x.fee > s.fee THEN 'WARN' ELSE 'PASS' END, 'commission', CAST(CAST(x.fee AS DECIMAL(28,2)) AS VARCHAR), CAST(CAST(s.fee AS DECIMAL(28,2)) AS VARCHAR), CAST(CAST(abs(x.fee - s.fee) AS DECIMAL(28,2)) AS DOUBLE) FROM x, s
UNION ALL SELECT 'trade_date_continuity', CASE WHEN gaps = 0 THEN 'PASS' ELSE 'WARN' END, 'trade dates', 'no pause above 5 days', CAST(gaps AS VARCHAR), CAST(gaps AS DOUBLE) FROM g
UNION ALL SELECT 'pair_coverage', CASE WHEN m.n / CAST(x.opens AS DOUBLE) >= 0.8 THEN 'PASS' ELSE 'WARN' END, 'matches per opening trade', 'at least 0.8', CAST(m.n AS VARCHAR), round(m.n / CAST(x.opens AS DOUBLE), 4) FROM m, x
UNION ALL SELECT 'pnl_reasonableness', CASE WHEN extreme = 0 THEN 'PASS' ELSE 'WARN' END, 'results against the highest equity', 'at most half of it', CAST(extreme AS VARCHAR), CAST(extreme AS DOUBLE) FROM x"""


@query("analysis_checks", "L18 E11", CHECKS_SQL)
def analysis_checks(f):
    return qa.analysis_checks(f.trades, trading.match_trades(f.trades), _summary(f)).select(*CHECK)


RULES_SQL = """
WITH t AS (SELECT count(*) AS n, count(CASE WHEN volume <= 0 THEN 1 END) AS np, sum(CASE WHEN offset_flag = 'open' THEN volume END) AS ov FROM trades),
m AS (SELECT CAST(sum(mv) AS BIGINT) AS mv, count(*) AS n, max(abs(net_pnl)) AS top, CAST(sum(CAST(abs(net_pnl) AS DECIMAL(28,6))) AS DOUBLE) / count(net_pnl) AS mean FROM matched_trades), s AS (SELECT count(*) AS n FROM account_summary)
SELECT 'trades_non_empty' AS "check", 'PASS' AS status, 'trades' AS source, 'some rows' AS expected, CAST(n AS VARCHAR) AS actual, 0e0 AS deviation FROM t
UNION ALL SELECT 'trades_positive_volume', CASE WHEN np = 0 THEN 'PASS' ELSE 'FAIL' END, 'trade volumes', 'none at or below 0', CAST(np AS VARCHAR), 0e0 FROM t
UNION ALL SELECT 'trades_contract_not_empty', 'PASS', 'trade instruments', 'none empty', '0', 0e0
UNION ALL SELECT 'trades_vs_matched_volume', CASE WHEN m.mv <= t.ov THEN 'PASS' ELSE 'WARN' END, 'opened and matched volume', CAST(CAST(t.ov AS BIGINT) AS VARCHAR), CAST(m.mv AS VARCHAR), 0e0 FROM m, t
UNION ALL SELECT 'matched_trades_pnl', 'PASS', 'matches', 'some rows', CAST(n AS VARCHAR), 0e0 FROM m
UNION ALL SELECT 'matched_trades_pnl_range', 'PASS', 'mean and largest result of a match', CAST(CAST(round(mean, 2) AS DECIMAL(28,2)) AS VARCHAR), CAST(CAST(round(top, 2) AS DECIMAL(28,2)) AS VARCHAR), 0e0 FROM m
UNION ALL SELECT 'account_summary_populated', 'PASS', 'account summaries', 'some rows', CAST(n AS VARCHAR), 0e0 FROM s"""

CHECK = ["check", "status", "source", "expected", "actual", "deviation"]


@query("trading_rules", "L19", RULES_SQL)
def trading_rules(f):
    return qa.trading_rules(f.trades, trading.match_trades(f.trades), _summary(f)).select(*CHECK)


@query("report_verdict", "D32", f"""
SELECT count(CASE WHEN status = 'PASS' THEN 1 END) AS pass, count(CASE WHEN status = 'WARN' THEN 1 END) AS warn, count(CASE WHEN status = 'FAIL' THEN 1 END) AS fail, count(CASE WHEN status = 'SKIP' THEN 1 END) AS skip,
       CASE WHEN count(CASE WHEN status = 'FAIL' THEN 1 END) > 0 THEN 'UNRELIABLE' WHEN count(CASE WHEN status = 'WARN' THEN 1 END) > 0 THEN 'QUESTIONABLE' WHEN count(CASE WHEN status = 'PASS' THEN 1 END) > 0 THEN 'TRUSTWORTHY' ELSE 'NO_DATA' END AS overall
FROM ({RULES_SQL}) r""")
def report_verdict(f):
    return qa.verdict(qa.trading_rules(f.trades, trading.match_trades(f.trades), _summary(f)))


@query("full_audit", "L23", f"""
SELECT 'trading' AS scope, * FROM ({RULES_SQL}) r UNION ALL SELECT 'analysis', * FROM ({CHECKS_SQL}) c
UNION ALL SELECT 'statements', 'fund_balance_equation', CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END, 'account_summary', CAST(n AS VARCHAR), CAST(bad AS VARCHAR), CAST(bad AS DOUBLE) FROM (
  SELECT count(*) AS n, count(CASE WHEN abs(balance_c_f - e) >= 0.01 AND abs(balance_c_f - e) >= balance_c_f * 0.05 THEN 1 END) AS bad FROM (SELECT *, balance_b_f + deposit_withdrawal + total_pnl - commission AS e FROM account_summary) q) y""")
def full_audit(f):
    m, s = trading.match_trades(f.trades), _summary(f)
    parts = {"trading": qa.trading_rules(f.trades, m, s), "analysis": qa.analysis_checks(f.trades, m, s),
             "statements": qa.fund_balance_check(trading.fund_balance_rows(s))}
    return qa.full_audit(parts).select("scope", *CHECK)


@query("date_gaps_per_account", "E11", """
SELECT account_id, count(CASE WHEN g > 5 THEN 1 END) AS gaps, coalesce(max(g), 0) AS max_gap FROM (
  SELECT account_id, d - lag(d) OVER (PARTITION BY account_id ORDER BY d) AS g FROM (SELECT DISTINCT account_id, bill_date_start AS d FROM bills) x) y GROUP BY account_id""")
def date_gaps(f):
    return qa.date_gaps(f.bills, ["account_id"], date="bill_date_start")


# ------------------------------------------------------------------ synchronisation

def _sync_status(f):
    o = f.table("orders")
    spans = o.groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("catalog_id"), "o_custkey").agg(
        F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("remote_latest"))
    return spans.select("catalog_id", F.when(F.col("o_custkey") % 4 != 0, F.col("a")).alias("local_latest"), "remote_latest")


SYNC_SQL = """
SELECT * FROM (SELECT catalog_id, CASE WHEN local_latest IS NULL THEN remote_latest - 365 ELSE (SELECT min(trade_date) FROM resolved r WHERE r.is_trading AND r.trade_date > s.local_latest) END AS start_date,
       CASE WHEN local_latest IS NULL THEN remote_latest ELSE (SELECT max(trade_date) FROM resolved r WHERE r.is_trading AND r.trade_date <= s.remote_latest) END AS end_date
FROM (SELECT 'C' || o_custkey AS catalog_id, CASE WHEN o_custkey % 4 <> 0 THEN min(CAST(o_orderdate AS DATE)) END AS local_latest, max(CAST(o_orderdate AS DATE)) AS remote_latest FROM orders GROUP BY o_custkey) s) t
WHERE start_date <= end_date"""


@query("sync_windows", "L25", SYNC_SQL)
def sync_windows(f):
    return qa.sync_window(_sync_status(f), f.resolved).select("catalog_id", "start_date", "end_date")


@query("sync_batches", "L25", f"""
SELECT catalog_id, b AS batch_index, (end_date - start_date + 30) // 30 AS total_batches, start_date + CAST(b * 30 AS INT) AS batch_start, least(start_date + CAST(b * 30 + 29 AS INT), end_date) AS batch_end
FROM (SELECT *, unnest(generate_series(0, (end_date - start_date) // 30)) AS b FROM ({SYNC_SQL}) w) x""")
def sync_batches(f):
    return qa.sync_batches(qa.sync_window(_sync_status(f), f.resolved))


# ------------------------------------------------------------------ monitoring roll-ups

@query("quality_report_by_source", "D21 D22", """
SELECT data_source AS source_name, CAST(sum(CAST(100 - volume AS DECIMAL(20,4))) AS DOUBLE) / count(*) AS avg_score, CAST(sum(volume) AS BIGINT) AS total_gaps,
       count(CASE WHEN option_type = 'CALL' THEN 1 END) AS total_suspects, CAST(sum(CAST(volume * 30 AS DECIMAL(20,4))) AS DOUBLE) / count(*) AS avg_delay, count(DISTINCT symbol) AS symbols_tracked
FROM raw_ticks GROUP BY data_source""")
def quality_report(f):
    return qa.quality_report(_quality_rows(f))


def _quality_rows(f):
    return f.raw_ticks.select("symbol", F.col("data_source").alias("source_name"), (100 - F.col("volume")).alias("quality_score"),
                              F.col("volume").alias("gap_count"), F.when(F.col("option_type") == "CALL", 1).otherwise(0).cast("bigint").alias("suspect_count"),
                              (F.col("volume") * 30).alias("delay_ms"))


@query("symbol_heat", "D22 H16", """
SELECT symbol, round(s, 6) AS avg_score, suspects, CASE WHEN s >= 90 THEN 'green' WHEN s >= 60 THEN 'yellow' ELSE 'red' END AS heat
FROM (SELECT symbol, CAST(sum(CAST(100 - volume AS DECIMAL(20,4))) AS DOUBLE) / count(*) AS s, count(CASE WHEN option_type = 'CALL' THEN 1 END) AS suspects FROM raw_ticks GROUP BY symbol) x""")
def symbol_heat(f):
    return rounded(qa.symbol_heat(_quality_rows(f)), 6, "avg_score")


@query("checkpoint_errors", "H18", "SELECT id, error AS error FROM sync_tasks")
def checkpoint_errors(f):
    return f.sync_tasks.select("id", S.json_error("checkpoint_data").alias("error"))
