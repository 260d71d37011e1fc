"""The binding frames as SQL common table expressions for the oracle queries."""

from __future__ import annotations

import re

CTES = {
    "ticks": """
SELECT event_id AS id, 'EVT' AS exchange, 'U' || user_id AS contract_code, ts, CAST(ts AS DATE) AS trade_date,
       strftime(ts, '%H:%M:%S') AS trade_time, '1min' AS frequency, event_type AS source, value AS price,
       value AS open, value AS high, value AS low, CASE WHEN event_type <> 'error' THEN value END AS close,
       CAST(json_extract(props, '$.k') AS BIGINT) AS volume,
       CAST(CAST(value AS DECIMAL(18,2)) * CAST(json_extract(props, '$.k') AS BIGINT) AS DECIMAL(28,2)) AS turnover,
       event_id AS open_interest
FROM events""",
    "daily_quotes": """
SELECT 'EX' || (l_suppkey % 5) AS exchange, 'S' || l_suppkey AS contract_code, CAST(l_shipdate AS DATE) AS trade_date,
       (max(l_extendedprice / l_quantity) + min(l_extendedprice / l_quantity)) / 2 AS open,
       max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS close,
       (max(l_extendedprice / l_quantity) + min(l_extendedprice / l_quantity)) / 2 AS settle,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS turnover,
       CAST(sum(l_linenumber) AS BIGINT) AS open_interest
FROM lineitem GROUP BY ALL""",
    "contracts": """
SELECT 'S' || s_suppkey AS contract_code, 'EX' || (s_suppkey % 5) AS exchange, n_name AS product_code,
       CASE WHEN s_suppkey % 3 = 0 THEN 'option_call' ELSE 'futures' END AS contract_type, listing_date, last_trade_date,
       CASE WHEN s_acctbal < 0 THEN 'suspended' ELSE 'active' END AS status
FROM (SELECT l_suppkey, CAST(min(l_shipdate) AS DATE) AS listing_date, CAST(max(l_shipdate) AS DATE) AS last_trade_date
      FROM lineitem GROUP BY l_suppkey) x
JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""",
    "positions": """
SELECT *, row_number() OVER (PARTITION BY trade_date, contract_code ORDER BY long_volume DESC, member_name) AS rank
FROM (SELECT 'EX0' AS exchange, CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date, p_brand AS contract_code,
             'M' || l_suppkey || CASE l_suppkey % 4 WHEN 0 THEN '期货' WHEN 1 THEN ' Bank' WHEN 2 THEN ' Securities' ELSE '' END AS member_name,
             CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS long_volume,
             CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS short_volume
      FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) g""",
    "trades": """
SELECT event_id AS id, 'A' || (user_id % 10) AS account_id, CAST(ts AS DATE) AS trade_date,
       CASE user_id % 3 WHEN 0 THEN 'MO2405-' || CASE WHEN user_id % 2 = 0 THEN 'C' ELSE 'P' END || '-' || (user_id * 10 + 5000)
                        WHEN 1 THEN CASE user_id % 4 WHEN 0 THEN 'rb' WHEN 1 THEN 'IC' WHEN 2 THEN 'PP' ELSE 'P' END || (user_id + 2400) ELSE 'U' || user_id END AS instrument,
       'EVT' AS exchange, 'P' || (user_id % 3) AS product,
       CASE WHEN event_type IN ('purchase', 'error') THEN 'buy' ELSE 'sell' END AS direction,
       CASE WHEN event_type IN ('purchase', 'view') THEN 'open' WHEN event_type = 'signup' THEN 'close_today' ELSE 'close' END AS offset_flag,
       CAST(json_extract(props, '$.k') AS BIGINT) AS volume, value AS price,
       CAST(CAST(value AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,4)) AS commission,
       CAST(CASE WHEN user_id % 3 = 0 THEN CAST(value AS DECIMAL(18,2)) * 10 ELSE 0 END AS DECIMAL(18,2)) AS premium,
       CAST(CAST(value AS DECIMAL(18,2)) - 20 AS DECIMAL(18,2)) AS total_pnl,
       CAST(CAST(value AS DECIMAL(18,2)) * CAST(json_extract(props, '$.k') AS BIGINT) AS DECIMAL(28,2)) AS turnover
FROM events""",
    "bill_flows": """
SELECT o_custkey, CAST(o_orderdate AS DATE) AS d,
       CAST(sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(18,2)) AS dep,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(18,2)) AS rea,
       CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(18,2)) AS mtm,
       CAST(count(*) * 5 AS DECIMAL(18,2)) AS com
FROM orders GROUP BY ALL""",
    "bills": """
SELECT CAST(o_custkey * 100000 + date_diff('day', DATE '1990-01-01', d) AS BIGINT) AS id, 'C' || o_custkey AS account_id,
       d AS bill_date_start, d AS bill_date_end, bf AS balance_bf, cf AS balance_cf, dep AS deposit_withdrawal,
       rea AS realized_pl, mtm AS mtm_pl, CAST(0 AS DECIMAL(18,2)) AS exercise_pl, com AS commission,
       CAST(0 AS DECIMAL(18,2)) AS premium_received, CAST(0 AS DECIMAL(18,2)) AS premium_paid, cf AS client_equity,
       CAST(cf - com AS DECIMAL(18,2)) AS fund_available, mtm AS margin_occupied
FROM (SELECT *, CAST(bf + dep + rea + mtm - com + CASE o_custkey % 10 WHEN 0 THEN 50 WHEN 1 THEN 50000 ELSE 0 END AS DECIMAL(18,2)) AS cf
      FROM (SELECT *, CAST(1000000 + coalesce(sum(dep + rea + mtm - com) OVER
              (PARTITION BY o_custkey ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(18,2)) AS bf
            FROM bill_flows) a) b""",
    "chain": """
SELECT trade_date, under AS underlying, under || l_partkey || CASE WHEN l_linestatus = 'O' THEN '-C' ELSE '-P' END AS contract_code,
       CASE WHEN l_linestatus = 'O' THEN 'C' ELSE 'P' END AS option_type, p_retailprice AS strike,
       CAST(trade_date + to_months(p_size % 6 + 1) AS DATE) AS expire_date, iv,
       CASE WHEN l_linestatus = 'O' THEN dd ELSE -dd END AS delta, volume, open_interest
FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date, l_partkey, l_linestatus,
             CASE l_partkey % 3 WHEN 0 THEN 'MO' WHEN 1 THEN 'IO' ELSE 'HO' END AS under,
             CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 4e0 + 1e-1 AS iv,
             CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 10e0 + 5e-2 AS dd,
             CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume, CAST(sum(l_linenumber) AS BIGINT) AS open_interest
      FROM lineitem GROUP BY ALL) g JOIN part ON p_partkey = l_partkey""",
    "underlying_daily": """
SELECT CAST(l_shipdate AS DATE) AS trade_date, CASE l_partkey % 3 WHEN 0 THEN 'MO' WHEN 1 THEN 'IO' ELSE 'HO' END AS underlying,
       CAST(sum(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(l_quantity AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS close,
       max(p_retailprice) AS high, min(p_retailprice) AS low, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""",
    "days": """
SELECT CAST(d AS DATE) AS trade_date FROM (
  SELECT unnest(generate_series(date_trunc('year', a), CAST(last_day(CAST(b AS DATE)) AS TIMESTAMP), INTERVAL 1 DAY)) AS d
  FROM (SELECT CAST(min(d) AS TIMESTAMP) AS a, CAST(max(d) AS TIMESTAMP) AS b
        FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION ALL SELECT CAST(l_shipdate AS DATE) FROM lineitem) u) s) t""",
    "calendar": """
SELECT trade_date, 'ALL' AS exchange_code, '' AS product_code,
       CASE WHEN isodow(trade_date) >= 6 OR strftime(trade_date, '%m-%d') IN ('01-01', '05-01', '10-01') THEN 1 ELSE 0 END AS is_holiday,
       CASE WHEN strftime(trade_date, '%m-%d') IN ('01-01', '05-01', '10-01') THEN 'H' || strftime(trade_date, '%m-%d') END AS holiday_name
FROM days""",
    "overrides": """
SELECT trade_date, 'ALL' AS exchange_code, 'workday' AS override_type FROM days WHERE day(trade_date) = 15 AND isodow(trade_date) = 6
UNION ALL SELECT trade_date, 'EX0', 'holiday' FROM days WHERE day(trade_date) = 20 AND isodow(trade_date) = 1
UNION ALL SELECT trade_date, 'ALL', 'holiday' FROM days WHERE day(trade_date) = 10
UNION ALL SELECT trade_date, 'EX0', 'half_day' FROM days WHERE day(trade_date) = 10""",
    "open_days": """
SELECT c.trade_date, CASE WHEN coalesce(x.override_type, a.override_type) IS NOT NULL
                          THEN coalesce(x.override_type, a.override_type) IN ('workday', 'half_day') ELSE c.is_holiday = 0 END AS is_trading
FROM calendar c
LEFT JOIN (SELECT * FROM overrides WHERE exchange_code = 'EX0') x ON x.trade_date = c.trade_date
LEFT JOIN (SELECT * FROM overrides WHERE exchange_code = 'ALL') a ON a.trade_date = c.trade_date""",
    "resolved": """
SELECT trade_date, is_trading, CAST(sum(CASE WHEN is_trading THEN 1 ELSE 0 END) OVER (ORDER BY trade_date) AS BIGINT) AS td_index,
       min(CASE WHEN is_trading THEN trade_date END) OVER (ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_td,
       max(CASE WHEN is_trading THEN trade_date END) OVER (ORDER BY trade_date) AS prev_td
FROM open_days""",
    "metrics": "SELECT event_type AS metric_name, ts, value, event_id AS id FROM events",
    "raw_ticks": """
SELECT event_id AS id, 'U' || user_id AS symbol, ts, CAST(ts AS DATE) AS trade_date, event_type AS data_source,
       epoch_us(ts) // 1000 AS "timestamp", epoch_us(ts) // 1000 + k * 30 AS arrival_ms, value AS open,
       CASE WHEN k % 10 = 0 THEN value - 1 ELSE value END AS high, value AS low, CASE WHEN k % 7 <> 0 THEN value END AS close,
       k AS volume, k / 40e0 AS implied_volatility, (k - 50) / 45e0 AS delta, CASE WHEN k % 2 = 0 THEN 'CALL' ELSE 'PUT' END AS option_type
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) e""",
    "catalogs": """
SELECT exchange || '/' || product_code AS catalog_id, exchange AS exchange_code, product_code, 'daily' AS data_type,
       min(listing_date) AS earliest_date, max(last_trade_date) AS latest_date
FROM contracts GROUP BY exchange, product_code""",
    "catalog_quotes": """
SELECT q.*, c.product_code, q.exchange || '/' || c.product_code AS catalog_id
FROM daily_quotes q JOIN contracts c ON c.contract_code = q.contract_code""",
    "sync_tasks": """
SELECT o_orderkey AS id, 'EX' || (o_custkey % 5) AS exchange_code, 'T' || (o_custkey % 25) AS catalog_id,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
       CASE WHEN o_orderstatus = 'P' THEN 'E' || (o_custkey % 7) END AS error, o_orderdate AS created_at, o_orderpriority AS error_type
FROM orders""",
    # ------------------------------------------------------------ derived results reused by several oracles
    "legs": """
SELECT *, CASE WHEN offset_flag = 'open' THEN CASE WHEN direction = 'buy' THEN 'long' ELSE 'short' END
               ELSE CASE WHEN direction = 'buy' THEN 'short' ELSE 'long' END END AS side
FROM trades WHERE volume > 0""",
    "lanes": """
SELECT *, CAST(sum(volume) OVER (PARTITION BY instrument, side, offset_flag = 'open' ORDER BY trade_date, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi
FROM legs""",
    "matched": """
SELECT o.instrument, c.exchange, c.product, CASE WHEN regexp_matches(o.instrument, '[0-9]-[CP]-[0-9]') THEN 1 ELSE 0 END AS is_option,
       o.side AS open_direction, o.id AS open_trade_id, c.id AS close_trade_id, o.trade_date AS open_date, c.trade_date AS close_date,
       o.price AS open_price, c.price AS close_price, o.volume AS ov, c.volume AS cv,
       CAST(o.premium AS DOUBLE) AS op, CAST(c.premium AS DOUBLE) AS cp, CAST(o.commission AS DOUBLE) AS oc, CAST(c.commission AS DOUBLE) AS cc,
       least(o.hi, c.hi) - greatest(o.hi - o.volume, c.hi - c.volume) AS mv,
       CASE WHEN o.instrument LIKE 'MO%' THEN 100 WHEN o.instrument LIKE 'rb%' THEN 10 WHEN o.instrument LIKE 'IC%' THEN 200 WHEN o.instrument LIKE 'PP%' THEN 5 WHEN o.instrument LIKE 'P%' THEN 10 ELSE 1 END AS multiplier
FROM lanes o JOIN lanes c ON c.instrument = o.instrument AND c.side = o.side AND o.offset_flag = 'open' AND c.offset_flag <> 'open'
 AND o.hi - o.volume < c.hi AND c.hi - c.volume < o.hi""",
    "matched_trades": """
SELECT *, money_pnl - commission AS net_pnl FROM (
  SELECT *, oc / ov * mv + cc / cv * mv AS commission,
         CASE WHEN is_option = 1 THEN (CASE WHEN open_direction = 'long' THEN abs(cp) - abs(op) ELSE abs(op) - abs(cp) END) * mv
              ELSE (CASE WHEN open_direction = 'long' THEN close_price - open_price ELSE open_price - close_price END) * mv * multiplier END AS money_pnl
  FROM matched) m""",
    "account_summary": """
SELECT *, CAST(sum(total_pnl) OVER (PARTITION BY account_id ORDER BY year, month ROWS UNBOUNDED PRECEDING) AS DECIMAL(28,2)) AS accumulated_pnl FROM (
  SELECT account_id, CAST(year(bill_date_start) AS BIGINT) AS year, CAST(month(bill_date_start) AS BIGINT) AS month,
         min(bill_date_start) AS start_date, max(bill_date_end) AS end_date, count(*) AS bill_count,
         arg_min(balance_bf, bill_date_start) AS balance_b_f, arg_max(balance_cf, bill_date_start) AS balance_c_f,
         CAST(sum(deposit_withdrawal) AS DECIMAL(28,2)) AS deposit_withdrawal, CAST(sum(realized_pl + mtm_pl) AS DECIMAL(28,2)) AS total_pnl,
         CAST(sum(commission) AS DECIMAL(28,2)) AS commission, arg_max(client_equity, bill_date_start) AS client_equity,
         arg_max(fund_available, bill_date_start) AS fund_available, arg_max(margin_occupied, bill_date_start) AS margin_occupied
  FROM bills GROUP BY account_id, year(bill_date_start), month(bill_date_start)) s""",
    "features": """
SELECT *, long_change - short_change AS net_change, (member_long_pct + member_short_pct) / 2 AS concentration_score FROM (
  SELECT p.trade_date, p.exchange, p.contract_code, p.member_name, p.long_volume, p.short_volume, p.long_volume - p.short_volume AS net_volume,
         coalesce(p.long_volume - lag(p.long_volume) OVER w, 0) AS long_change, coalesce(p.short_volume - lag(p.short_volume) OVER w, 0) AS short_change,
         rank() OVER (PARTITION BY p.trade_date, p.exchange, p.contract_code ORDER BY p.long_volume DESC) AS member_rank_long,
         rank() OVER (PARTITION BY p.trade_date, p.exchange, p.contract_code ORDER BY p.short_volume DESC) AS member_rank_short,
         t.total_market_long, t.total_market_short,
         coalesce(CAST(p.long_volume AS DOUBLE) / nullif(t.total_market_long, 0), 0) AS member_long_pct,
         coalesce(CAST(p.short_volume AS DOUBLE) / nullif(t.total_market_short, 0), 0) AS member_short_pct
  FROM positions p JOIN (SELECT trade_date, CAST(sum(long_volume) AS BIGINT) AS total_market_long, CAST(sum(short_volume) AS BIGINT) AS total_market_short
                         FROM positions GROUP BY trade_date) t ON t.trade_date = p.trade_date
  WINDOW w AS (PARTITION BY p.exchange, p.contract_code, p.member_name ORDER BY p.trade_date)) f""",
    "regime_inputs": """
SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr_all FROM (
  SELECT *, lag(close) OVER (PARTITION BY contract_code ORDER BY trade_date) AS pc FROM daily_quotes) q""",
    "regime_metrics": """
SELECT * FROM (
  SELECT contract_code, trade_date, close, count(*) OVER w20 AS n, avg(close) OVER w5 AS sma, avg(close) OVER w20 AS lma,
         avg(CASE WHEN pc IS NOT NULL THEN tr_all END) OVER w19 AS atr,
         sum(volume) OVER (PARTITION BY contract_code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) AS v1,
         sum(volume) OVER (PARTITION BY contract_code ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS v2,
         first_value(close) OVER w20 AS c0, lag(close, 4) OVER (PARTITION BY contract_code ORDER BY trade_date) AS c5
  FROM regime_inputs
  WINDOW w20 AS (PARTITION BY contract_code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
         w19 AS (PARTITION BY contract_code ORDER BY trade_date ROWS BETWEEN 18 PRECEDING AND CURRENT ROW),
         w5 AS (PARTITION BY contract_code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) m WHERE n = 20""",
    "regimes": """
SELECT trade_date, contract_code,
       CASE WHEN vol > 0.03 THEN 'volatile' WHEN trend > 0.01 THEN CASE WHEN close > c0 THEN 'trending_up' ELSE 'trending_down' END ELSE 'range' END AS regime_type,
       round(trend, 4) AS trend_strength, round(vol, 4) AS volatility_level, round(vt, 3) AS volume_trend,
       CASE WHEN vol > 0.025 THEN 'high_iv' WHEN vol < 0.01 THEN 'low_iv' WHEN close > c5 THEN 'rising_iv' ELSE 'falling_iv' END AS iv_regime,
       round(least(1.0, trend * 2 + (1.0 - vol) * 0.5), 3) + 0e0 AS regime_score
FROM (SELECT *, abs(sma - lma) / lma AS trend, atr / lma AS vol, CAST(v2 AS DOUBLE) / v1 AS vt FROM regime_metrics) r""",
    "hv": """
SELECT underlying, trade_date, close,
       CASE WHEN n > 5 THEN round(stddev_samp(r) OVER (PARTITION BY underlying ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) * sqrt(252.0), 4) END AS hv_5,
       CASE WHEN n > 10 THEN round(stddev_samp(r) OVER (PARTITION BY underlying ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) * sqrt(252.0), 4) END AS hv_10,
       CASE WHEN n > 20 THEN round(stddev_samp(r) OVER (PARTITION BY underlying ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252.0), 4) END AS hv_20,
       CASE WHEN n > 60 THEN round(stddev_samp(r) OVER (PARTITION BY underlying ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) * sqrt(252.0), 4) END AS hv_60
FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY underlying ORDER BY trade_date)) AS r,
             row_number() OVER (PARTITION BY underlying ORDER BY trade_date) AS n FROM underlying_daily) u""",
    "spotted": """
SELECT c.*, u.close AS spot_price FROM chain c
ASOF LEFT JOIN underlying_daily u ON u.underlying = c.underlying AND u.trade_date <= c.trade_date""",
    "atm": """
SELECT trade_date, underlying, iv AS atm_iv, strike AS atm_strike, spot_price FROM (
  SELECT *, row_number() OVER (PARTITION BY trade_date, underlying ORDER BY abs(strike - spot_price), strike, option_type, contract_code) AS rn
  FROM spotted WHERE iv > 0 AND spot_price IS NOT NULL) a WHERE rn = 1""",
    "term_rows": """
SELECT trade_date, underlying, expiry_month, iv AS atm_iv FROM (
  SELECT *, strftime(expire_date, '%Y-%m') AS expiry_month,
         row_number() OVER (PARTITION BY trade_date, underlying, strftime(expire_date, '%Y-%m') ORDER BY abs(strike - spot_price), strike, option_type, contract_code) AS rn
  FROM spotted WHERE iv > 0 AND spot_price IS NOT NULL) a WHERE rn = 1""",
    "delta_legs": """
SELECT trade_date, underlying, option_type AS leg, delta, CAST(sum(CAST(iv AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS iv,
       CASE WHEN option_type = 'C' THEN 25e-2 ELSE -25e-2 END AS target
FROM chain GROUP BY trade_date, underlying, option_type, delta""",
    "skew": """
SELECT trade_date, underlying, max(CASE WHEN leg = 'P' THEN iv25 END) AS put_25, max(CASE WHEN leg = 'C' THEN iv25 END) AS call_25,
       max(CASE WHEN leg = 'P' THEN iv25 END) - max(CASE WHEN leg = 'C' THEN iv25 END) AS skew_25delta
FROM (SELECT trade_date, underlying, leg, CASE WHEN dlo = dhi THEN ivlo ELSE ivlo + (target - dlo) / (dhi - dlo) * (ivhi - ivlo) END AS iv25
      FROM (SELECT trade_date, underlying, leg, target, max(CASE WHEN delta <= target THEN delta END) AS dlo, min(CASE WHEN delta >= target THEN delta END) AS dhi,
                   arg_max(iv, CASE WHEN delta <= target THEN delta END) AS ivlo, arg_min(iv, CASE WHEN delta >= target THEN delta END) AS ivhi
            FROM delta_legs GROUP BY trade_date, underlying, leg, target) x) y
GROUP BY trade_date, underlying""",
    "pcr": """
SELECT trade_date, underlying, pv AS put_volume, cv AS call_volume, po AS put_oi, co AS call_oi,
       CASE WHEN pv > 0 AND cv > 0 THEN round(CAST(pv AS DOUBLE) / cv, 4) END AS pcr_volume,
       CASE WHEN pv > 0 AND cv > 0 THEN CASE WHEN co > 0 THEN round(CAST(po AS DOUBLE) / co, 4) ELSE 0 END END AS pcr_oi
FROM (SELECT trade_date, underlying, CAST(sum(CASE WHEN option_type = 'P' THEN volume ELSE 0 END) AS BIGINT) AS pv,
             CAST(sum(CASE WHEN option_type = 'C' THEN volume ELSE 0 END) AS BIGINT) AS cv,
             CAST(sum(CASE WHEN option_type = 'P' THEN open_interest ELSE 0 END) AS BIGINT) AS po,
             CAST(sum(CASE WHEN option_type = 'C' THEN open_interest ELSE 0 END) AS BIGINT) AS co
      FROM chain GROUP BY trade_date, underlying) p""",
    "atm_pct": """
SELECT a.trade_date, a.underlying AS variety, a.atm_iv, a.atm_strike, a.spot_price,
       CASE WHEN count(*) >= 20 THEN count(CASE WHEN b.atm_iv < a.atm_iv THEN 1 END) / CAST(count(*) AS DOUBLE) * 100 END AS pct
FROM (SELECT *, row_number() OVER (PARTITION BY underlying ORDER BY trade_date) AS rn FROM atm) a
JOIN (SELECT *, row_number() OVER (PARTITION BY underlying ORDER BY trade_date) AS rn FROM atm) b
  ON b.underlying = a.underlying AND b.rn BETWEEN a.rn - 251 AND a.rn
GROUP BY a.trade_date, a.underlying, a.atm_iv, a.atm_strike, a.spot_price""",
    "benchmark_rows": """
SELECT p.trade_date, p.variety, round(p.atm_iv, 4) AS atm_iv, round(p.atm_strike, 1) AS atm_strike, round(p.spot_price, 2) AS spot_price,
       h.hv_20, h.hv_60, round(p.atm_iv - h.hv_20, 4) AS iv_hv_spread, round(s.skew_25delta, 4) AS skew_25delta,
       round(p.pct, 2) AS iv_percentile_1y,
       CASE WHEN p.pct IS NULL THEN 'normal' WHEN p.pct < 10 THEN 'very_low' WHEN p.pct < 30 THEN 'low' WHEN p.pct < 70 THEN 'normal'
            WHEN p.pct < 90 THEN 'high' ELSE 'very_high' END AS iv_regime, r.pcr_volume, r.pcr_oi
FROM atm_pct p
ASOF LEFT JOIN hv h ON h.underlying = p.variety AND h.trade_date <= p.trade_date
LEFT JOIN skew s ON s.trade_date = p.trade_date AND s.underlying = p.variety
LEFT JOIN pcr r ON r.trade_date = p.trade_date AND r.underlying = p.variety""",
}


def _needs(sql: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b{n}\b", sql)]


def decimal_rounding(sql: str) -> str:
    """Write every ``round(x, n)`` as a decimal rounding.

    DuckDB rounds a double by scaling it in binary, Spark rounds its decimal representation half
    away from zero; on ties such as 2.675 they differ. Rounding the printed value as a DECIMAL is
    the same rule in both.
    """
    out, i = [], 0
    for hit in iter(lambda: re.search(r"\bround\(", sql[i:]), None):
        start = i + hit.start()
        depth, comma, j = 1, -1, i + hit.end()
        while depth:
            ch = sql[j]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = j
            j += 1
        inner = decimal_rounding(sql[i + hit.end():comma])
        out.append(f"{sql[i:start]}CAST(round(CAST(CAST(({inner}) AS VARCHAR) AS DECIMAL(38,20)),{sql[comma + 1:j - 1]}) AS DOUBLE)")
        i = j
    return "".join(out) + sql[i:]


def with_ctes(sql: str) -> str:
    """Prefix a query with the CTEs it refers to, dependencies first."""
    return decimal_rounding(_with_ctes(sql))


def _with_ctes(sql: str) -> str:
    order: list[str] = []

    def visit(text: str, stack: tuple[str, ...] = ()):
        for name in _needs(text):
            if name not in order and name not in stack:
                visit(CTES[name], stack + (name,))
                order.append(name)

    visit(sql)
    if not order:
        return sql
    body = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in order)
    rest = sql.strip()
    if rest.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {body},\n{rest[15:]}"
    if rest.upper().startswith("WITH "):
        return f"WITH {body},\n{rest[5:]}"
    return f"WITH {body}\n{rest}"
