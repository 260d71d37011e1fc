"""Regime, institution and signal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import analysis as an
from tickloom.operators import options as opt
from tickloom.operators import query as Q
from tickloom.plans.registry import query


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("market_regimes", "K09 E05 E06 E07 B12", "SELECT * FROM regimes")
def regimes(f):
    return an.classify_regimes(f.daily_quotes)


@query("latest_regimes", "B12", "SELECT trade_date, contract_code, regime_type FROM regimes ORDER BY trade_date DESC, contract_code LIMIT 10")
def latest_regimes(f):
    return Q.page(an.classify_regimes(f.daily_quotes), [F.desc("trade_date"), "contract_code"], 1, 10).select("trade_date", "contract_code", "regime_type")


@query("market_environment", "K10 E16 D06", """
WITH j AS (SELECT u.*, i.avg_iv FROM underlying_daily u LEFT JOIN (SELECT trade_date, underlying, CAST(sum(CAST(iv AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS avg_iv FROM chain WHERE iv > 0 GROUP BY ALL) i
             ON i.trade_date = u.trade_date AND i.underlying = u.underlying),
w AS (SELECT underlying, trade_date, count(*) OVER x AS n, (close - first_value(close) OVER x) / first_value(close) OVER x * 100 AS ret,
             (max(high) OVER x - min(low) OVER x) / min(low) OVER x * 100 AS amp,
             coalesce((last_value(avg_iv IGNORE NULLS) OVER x - first_value(avg_iv IGNORE NULLS) OVER x) / first_value(avg_iv IGNORE NULLS) OVER x * 100, 0) AS ivc,
             CAST(sum(volume) OVER (PARTITION BY underlying ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS sum_volume_10d, round(avg(volume) OVER x, 2) AS avg_volume_20d
      FROM j WINDOW x AS (PARTITION BY underlying ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT underlying, trade_date, CASE WHEN ret > 3 THEN 'trend_up' WHEN ret < -3 THEN 'trend_down' WHEN amp > 5 AND ivc > 10 THEN 'high_vol' WHEN amp < 2 AND ivc < -5 THEN 'low_vol' ELSE 'neutral' END AS env_type,
       round(ret, 2) + 0e0 AS ret_20d, round(amp, 2) AS amplitude_20d, round(ivc, 2) + 0e0 AS iv_change_pct, sum_volume_10d, avg_volume_20d FROM w WHERE n >= 5""")
def environment(f):
    return an.market_environment(f.underlying_daily, opt.average_iv(f.chain))


@query("institution_features", "K11 E18 E19 B10", """
SELECT trade_date, exchange, contract_code, member_name, long_volume, short_volume, net_volume, long_change, short_change, net_change,
       member_rank_long, member_rank_short, total_market_long, total_market_short, round(member_long_pct, 8) AS member_long_pct,
       round(member_short_pct, 8) AS member_short_pct, round(concentration_score, 8) AS concentration_score FROM features""")
def institution_features(f):
    return rounded(an.institution_features(f.positions), 8, "member_long_pct", "member_short_pct", "concentration_score")


@query("institution_profiles", "K12 D29", """
SELECT member_name, CAST(sum(long_volume) AS BIGINT) AS total_long, CAST(sum(short_volume) AS BIGINT) AS total_short, min(trade_date) AS first_appearance, max(trade_date) AS last_appearance,
       CAST(sum(long_volume) - sum(short_volume) AS BIGINT) AS total_net, CASE WHEN sum(long_volume) > sum(short_volume) THEN 'long_bias' WHEN sum(long_volume) < sum(short_volume) THEN 'short_bias' ELSE 'neutral' END AS bias_direction
FROM features WHERE trade_date <= DATE '2000-12-31' GROUP BY member_name""")
def profiles(f):
    return an.institution_profiles(an.institution_features(f.positions), "2000-12-31")


LEAD_SQL = """
WITH fl AS (SELECT trade_date, member_name, CAST(sum(net_change) AS BIGINT) AS c FROM features GROUP BY ALL),
sc AS (SELECT *, max(abs(c)) OVER w AS mv, count(*) OVER w AS seen FROM fl WINDOW w AS (PARTITION BY member_name ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
ld AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY mv DESC, member_name) AS r FROM sc) q WHERE r <= 5 AND c <> 0)
SELECT s.trade_date, l.member_name AS leading_member, s.member_name AS lagging_member, round(least(1.0, abs(s.c) / CAST(greatest(abs(l.c), 1) AS DOUBLE)), 3) AS correlation,
       CASE WHEN l.c > 0 THEN 'bullish' ELSE 'bearish' END AS signal_direction
FROM sc s JOIN ld l ON l.trade_date = s.trade_date AND l.member_name <> s.member_name
WHERE s.c <> 0 AND s.seen >= 2 AND (s.c > 0) = (l.c > 0) AND least(1.0, abs(s.c) / CAST(greatest(abs(l.c), 1) AS DOUBLE)) > 0.3"""


@query("lead_lag_edges", "K13 C15 F07 B16", LEAD_SQL)
def lead_lag(f):
    return an.lead_lag(an.institution_features(f.positions)).drop("lag_days")


@query("institution_master_sync", "K14 H13 B16", """
SELECT min(exchange) AS exchange, member_name, CASE WHEN contains(member_name, '期货') THEN 'futures_company' WHEN contains(lower(member_name), 'bank') THEN 'bank'
       WHEN contains(lower(member_name), 'securities') THEN 'securities' ELSE 'other' END AS category, 'active' AS status
FROM positions WHERE member_name NOT IN (SELECT member_name FROM positions WHERE trade_date < DATE '1995-02-15') GROUP BY member_name""")
def master_sync(f):
    known = f.positions.filter("trade_date < date '1995-02-15'").select("member_name").distinct()
    return an.new_institutions(f.positions, known)


@query("name_resolution", "H14", """
SELECT p.member_name, p.contract_code, CASE WHEN contains(p.member_name, 'Bank') THEN 'BANK ' || p.exchange ELSE p.member_name END AS canonical_name,
       CASE WHEN contains(p.member_name, 'Bank') THEN 0.9 ELSE 0.5 END AS confidence FROM (SELECT DISTINCT member_name, contract_code, exchange FROM positions) p""")
def name_resolution(f):
    rows = f.positions.select(F.col("member_name").alias("raw_name"), "contract_code", "exchange").distinct()
    mapping = f.positions.filter(F.col("member_name").contains("Bank")).select(F.col("member_name").alias("raw_name"), "exchange").distinct() \
        .withColumn("canonical_name", F.concat_ws(" ", F.lit("BANK"), "exchange")).withColumn("confidence", F.lit(0.9))
    return an.resolve_names(rows, mapping).select(F.col("raw_name").alias("member_name"), "contract_code", "canonical_name", "confidence")


SIGNAL_SQL = """
WITH g AS (SELECT f.*, CASE WHEN net_volume > 0 AND net_change > 0 THEN 'entry_long' WHEN net_volume < 0 AND net_change < 0 THEN 'entry_short' END AS st,
                  r.regime_type FROM features f LEFT JOIN (SELECT contract_code, CAST(date_trunc('month', trade_date) AS DATE) AS m, first(regime_type ORDER BY trade_date DESC, n) AS regime_type
                  FROM (SELECT 'Brand#' || (CAST(substr(contract_code, 2) AS BIGINT) % 25 + 1) AS contract_code, trade_date, regime_type, CAST(substr(contract_code, 2) AS BIGINT) AS n FROM regimes) z GROUP BY ALL) r
                  ON r.contract_code = f.contract_code AND r.m = f.trade_date WHERE concentration_score >= 0.001)
SELECT trade_date AS signal_date, contract_code AS product, member_name, st AS signal_type,
       round(least(1.0, concentration_score * 0.5 + abs(net_change) / CAST(greatest(abs(net_volume), 1) AS DOUBLE) * 0.5), 3) AS strength,
       CASE WHEN regime_type IS NULL THEN 'institution_flow' ELSE 'composite' END AS source, regime_type AS regime
FROM g WHERE st IS NOT NULL AND NOT coalesce((st = 'entry_long' AND regime_type = 'trending_down') OR (st = 'entry_short' AND regime_type = 'trending_up'), false)"""


def _signals(f):
    n = F.substring("contract_code", 2, 20).cast("bigint")
    reg = an.classify_regimes(f.daily_quotes) \
        .select(F.concat(F.lit("Brand#"), (n % 25 + 1).cast("string")).alias("contract_code"), "trade_date", "regime_type", n.alias("n")) \
        .groupBy("contract_code", F.to_date(F.trunc("trade_date", "month")).alias("m")) \
        .agg(F.max_by("regime_type", F.struct("trade_date", -F.col("n"))).alias("regime_type")) \
        .withColumnRenamed("m", "trade_date")
    return an.generate_signals(an.institution_features(f.positions), reg, 0.001)


@query("signals", "K15 B11 H18", SIGNAL_SQL)
def signals(f):
    return _signals(f).select("signal_date", "product", F.col("detail.member_name").alias("member_name"), "signal_type", "strength", "source",
                              F.col("detail.regime").alias("regime"))


@query("active_signals", "B28", f"SELECT * FROM ({SIGNAL_SQL}) s WHERE signal_date <= DATE '1999-12-31'")
def active_signals(f):
    return an.active_signals(_signals(f), "1999-12-31").select(
        "signal_date", "product", F.col("detail.member_name").alias("member_name"), "signal_type", "strength", "source", F.col("detail.regime").alias("regime"))


TRIGGER_SQL = """
SELECT event_id AS id, CASE user_id % 3 WHEN 0 THEN 'entry_long' WHEN 1 THEN 'entry_short' ELSE 'exit' END AS signal_type, CAST(value AS DECIMAL(18,2)) AS entry_price,
       CAST(json_extract(props, '$.k') AS DECIMAL(18,2)) AS exit_price, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS holding_days, user_id FROM events"""


def _triggers(f):
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = f.table("events")
    sig = e.select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 3 == 0, "entry_long").when(F.col("user_id") % 3 == 1, "entry_short")
                   .otherwise("exit").alias("signal_type"))
    trg = e.select("event_id", F.col("event_id").alias("signal_id"), F.col("value").cast("decimal(18,2)").alias("entry_price"),
                   k.cast("decimal(18,2)").alias("exit_price"), (k % 10).alias("holding_days"))
    return an.close_triggers(trg, sig)


@query("closed_signal_pnl", "K16 C16", f"""
SELECT id, signal_type, CAST(CASE signal_type WHEN 'entry_long' THEN exit_price - entry_price WHEN 'entry_short' THEN entry_price - exit_price ELSE 0 END AS DOUBLE) AS pnl FROM ({TRIGGER_SQL}) t""")
def closed_pnl(f):
    return _triggers(f).select(F.col("event_id").alias("id"), "signal_type", F.col("pnl").cast("double").alias("pnl"))


@query("signal_performance", "D17", f"""
WITH t AS (SELECT *, CASE signal_type WHEN 'entry_long' THEN exit_price - entry_price WHEN 'entry_short' THEN entry_price - exit_price ELSE 0 END AS pnl FROM ({TRIGGER_SQL}) x)
SELECT signal_type, count(*) AS total, CAST(sum(pnl) AS DOUBLE) / count(*) AS avg_pnl, count(CASE WHEN pnl > 0 THEN 1 END) / CAST(count(*) AS DOUBLE) AS win_rate,
       CAST(sum(pnl) AS DOUBLE) AS total_pnl, CAST(sum(holding_days) AS DOUBLE) / count(*) AS avg_holding_days FROM t GROUP BY signal_type""")
def signal_performance(f):
    return an.signal_performance(_triggers(f), ["signal_type"]).withColumn("total_pnl", F.col("total_pnl").cast("double"))


@query("signals_triggered", "K16", """
SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS triggered, CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END AS triggered_date FROM events""")
def signals_triggered(f):
    e = f.table("events")
    sig = e.select(F.col("event_id").alias("id"), F.lit(0).alias("triggered"))
    entries = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.to_date("ts").alias("trigger_date"))
    return an.trigger_signals(sig, entries)


@query("analysis_pipeline", "K17", """
SELECT CASE WHEN net_volume > 0 THEN 'entry_long' ELSE 'entry_short' END AS signal_type, count(*) AS signals FROM features
WHERE concentration_score >= 0.001 AND ((net_volume > 0 AND net_change > 0) OR (net_volume < 0 AND net_change < 0)) GROUP BY 1""")
def pipeline(f):
    out = an.analysis_pipeline(f.positions, f.daily_quotes, 0.001)
    return out["signals"].groupBy("signal_type").agg(F.count(F.lit(1)).alias("signals"))
