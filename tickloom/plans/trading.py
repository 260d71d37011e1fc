"""Trades, matching, statements: queries over the trading frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import ordered, quality, query as Q, trading
from tickloom.plans.registry import query

D2 = "decimal(28,2)"


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("trades_by_account_and_dates", "B06 B05 B18", """
SELECT id, trade_date, instrument, direction, volume, price FROM trades WHERE account_id = 'A3' AND trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""")
def trades_filter(f):
    out = Q.select_where(f.trades, equals={"account_id": "A3", "instrument": None}, start={"trade_date": "2024-01-05"},
                         end={"trade_date": "2024-01-25"}, order=["trade_date", "id"])
    return out.select("id", "trade_date", "instrument", "direction", "volume", "price")


@query("trade_page_with_filters", "B18 B17", """
SELECT id, account_id, trade_date, instrument FROM trades WHERE direction = 'buy' AND offset_flag = 'open' AND trade_date >= DATE '2024-01-02'
ORDER BY trade_date DESC, id DESC LIMIT 100 OFFSET 100""")
def trade_page(f):
    rows = Q.select_where(f.trades, equals={"direction": "buy", "offset_flag": "open"}, start={"trade_date": "2024-01-02"})
    return Q.page(rows, [F.desc("trade_date"), F.desc("id")], 2, 100).select("id", "account_id", "trade_date", "instrument")


@query("trade_page_after_key", "B18", """
SELECT id, account_id, trade_date, instrument FROM trades WHERE direction = 'buy' AND (trade_date < DATE '2024-01-20' OR (trade_date = DATE '2024-01-20' AND id > 50))
ORDER BY trade_date DESC, id LIMIT 100""")
def trade_page_after(f):
    rows = Q.select_where(f.trades, equals={"direction": "buy"})
    return Q.page_after(rows, {"trade_date": False, "id": True}, ("2024-01-20", 50)).select("id", "account_id", "trade_date", "instrument")


@query("statements_by_account", "B05", """
SELECT id, account_id, bill_date_start, balance_bf, balance_cf FROM bills WHERE bill_date_start BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'""")
def bills_filter(f):
    out = Q.select_where(f.bills, start={"bill_date_start": "1997-01-01"}, end={"bill_date_start": "1997-12-31"},
                         order=[F.desc("bill_date_start"), "id"])
    return out.select("id", "account_id", "bill_date_start", "balance_bf", "balance_cf")


MATCH_COLUMNS = """instrument, open_direction, is_option, open_trade_id, close_trade_id, open_date, close_date, CAST(mv AS BIGINT) AS open_volume,
       close_date - open_date AS holding_days, multiplier, round(money_pnl, 4) AS money_pnl, round(commission, 6) AS commission, round(net_pnl, 4) AS net_pnl,
       round(abs(op) * mv / ov, 6) AS open_premium, round(abs(cp) * mv / cv, 6) AS close_premium,
       CASE WHEN is_option = 1 THEN 0 ELSE round(CASE WHEN open_direction = 'long' THEN close_price - open_price ELSE open_price - close_price END, 4) END AS price_pnl"""


@query("fifo_matched_trades", "K01 K02 C12 E17", f"SELECT {MATCH_COLUMNS} FROM matched_trades")
def fifo(f):
    m = trading.match_trades(f.trades)
    m = rounded(rounded(m, 4, "money_pnl", "net_pnl", "price_pnl"), 6, "commission", "open_premium", "close_premium")
    return m.select("instrument", "open_direction", "is_option", "open_trade_id", "close_trade_id", "open_date", "close_date",
                    "open_volume", "holding_days", "multiplier", "money_pnl", "commission", "net_pnl", "open_premium",
                    "close_premium", "price_pnl")


CAUSAL_SQL = """
WITH r AS (SELECT *, sum(CASE WHEN offset_flag = 'open' THEN volume ELSE 0 END) OVER w AS o, sum(CASE WHEN offset_flag = 'open' THEN 0 ELSE volume END) OVER w AS c
           FROM legs WINDOW w AS (PARTITION BY instrument, side ORDER BY trade_date, id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(max(c - o) OVER (PARTITION BY instrument, side ORDER BY trade_date, id ROWS UNBOUNDED PRECEDING), 0) AS lost,
             greatest(coalesce(max(c - o) OVER (PARTITION BY instrument, side ORDER BY trade_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS lost0 FROM r),
e AS (SELECT id, instrument, side, offset_flag, CASE WHEN offset_flag = 'open' THEN o - volume ELSE c - volume - lost0 END AS lo, CASE WHEN offset_flag = 'open' THEN o ELSE c - lost END AS hi FROM p)
SELECT a.instrument, a.side AS open_direction, a.id AS open_trade_id, b.id AS close_trade_id, CAST(least(a.hi, b.hi) - greatest(a.lo, b.lo) AS BIGINT) AS open_volume
FROM e a JOIN e b ON b.instrument = a.instrument AND b.side = a.side AND a.offset_flag = 'open' AND b.offset_flag <> 'open' AND b.lo < b.hi AND a.lo < b.hi AND b.lo < a.hi"""


@query("fifo_matched_in_time_order", "K01", CAUSAL_SQL)
def fifo_causal(f):
    m = trading.match_trades(f.trades, enforce_time_order=True)
    return m.select("instrument", "open_direction", "open_trade_id", "close_trade_id", "open_volume")


@query("matched_by_close_date", "B07", """
SELECT instrument, open_trade_id, close_trade_id, CAST(mv AS BIGINT) AS open_volume FROM matched_trades WHERE close_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""")
def matched_filter(f):
    out = Q.select_where(trading.match_trades(f.trades), start={"close_date": "2024-01-10"}, end={"close_date": "2024-01-20"},
                         order=[F.desc("close_date")])
    return out.select("instrument", "open_trade_id", "close_trade_id", "open_volume")


@query("trade_performance", "K03 H05 H11", """
SELECT open_trade_id, close_trade_id, CASE WHEN open_price > 0 THEN round(net_pnl / (open_price * mv * greatest(multiplier, 1)), 6) END AS pnl_ratio,
       CASE WHEN is_option = 1 THEN 'MO' END AS underlying, CASE WHEN is_option = 1 THEN DATE '2024-05-31' END AS expiry,
       CASE WHEN is_option = 1 THEN CASE WHEN instrument LIKE '%-C-%' THEN 'call' ELSE 'put' END END AS option_type,
       CASE WHEN is_option = 1 THEN CAST(split_part(instrument, '-', 3) AS DOUBLE) END AS strike,
       CAST(year(close_date) AS BIGINT) AS close_year, CAST(month(close_date) AS BIGINT) AS close_month, CAST(quarter(close_date) AS BIGINT) AS close_quarter
FROM matched_trades""")
def performance(f):
    p = rounded(trading.trade_performance(trading.match_trades(f.trades)), 6, "pnl_ratio")
    return p.select("open_trade_id", "close_trade_id", "pnl_ratio", "underlying", "expiry", "option_type", "strike",
                    *[F.col(c).cast("bigint").alias(c) for c in ("close_year", "close_month", "close_quarter")])


@query("performance_rollup", "D19", """
SELECT CAST(year(close_date) AS BIGINT) AS close_year, CAST(quarter(close_date) AS BIGINT) AS close_quarter, CAST(month(close_date) AS BIGINT) AS close_month,
       count(*) AS trades, CAST(sum(CASE WHEN net_pnl > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CAST(round(net_pnl, 6) AS DECIMAL(18,6))) AS DOUBLE) AS total_pnl
FROM matched_trades GROUP BY ROLLUP (year(close_date), quarter(close_date), month(close_date))""")
def rollup(f):
    p = trading.trade_performance(trading.match_trades(f.trades)).withColumn("net_pnl", F.col("net_pnl").cast("decimal(18,6)"))
    return trading.performance_rollup(p).select(
        *[F.col(c).cast("bigint").alias(c) for c in ("close_year", "close_quarter", "close_month")], "trades", "wins",
        F.col("total_pnl").cast("double").alias("total_pnl"))


@query("performance_by_product_and_type", "D19", """
SELECT product, kind, CAST(grouping(product, kind) AS BIGINT) AS level, count(*) AS trades, CAST(sum(CASE WHEN net_pnl > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins,
       CAST(sum(CAST(round(net_pnl, 6) AS DECIMAL(18,6))) AS DOUBLE) AS total_pnl
FROM (SELECT net_pnl, upper(regexp_extract(instrument, '^([A-Za-z]+)', 1)) AS product,
             CASE WHEN is_option = 1 THEN CASE WHEN instrument LIKE '%-C-%' THEN 'call' ELSE 'put' END ELSE 'future' END AS kind FROM matched_trades) m
GROUP BY GROUPING SETS ((product, kind), (product), (kind))""")
def by_kind(f):
    p = trading.trade_performance(trading.match_trades(f.trades)).withColumn("net_pnl", F.col("net_pnl").cast("decimal(18,6)"))
    return trading.performance_by_kind(p).withColumn("level", F.col("level").cast("bigint")).withColumn("total_pnl", F.col("total_pnl").cast("double"))


@query("statement_page", "B18", """
SELECT id, account_id, bill_date_start, CAST(balance_cf AS DOUBLE) AS balance_cf FROM bills ORDER BY bill_date_start DESC, id DESC LIMIT 50 OFFSET 100""")
def statement_page(f):
    return Q.page(f.bills, [F.desc("bill_date_start"), F.desc("id")], 3, 50).select("id", "account_id", "bill_date_start", "balance_cf")


@query("position_page", "B18", """
SELECT trade_date, contract_code, member_name, rank FROM positions ORDER BY trade_date DESC, contract_code, rank LIMIT 100 OFFSET 100""")
def position_page(f):
    return Q.page(f.positions, [F.desc("trade_date"), "contract_code", "rank"], 2, 100).select(
        "trade_date", "contract_code", "member_name", F.col("rank").cast("bigint").alias("rank"))


@query("account_summary_page", "B18", """
SELECT account_id, year, month, commission FROM account_summary ORDER BY year DESC, month DESC, account_id LIMIT 50 OFFSET 50""")
def account_page(f):
    return Q.page(trading.monthly_account_summary(f.bills), [F.desc("year"), F.desc("month"), "account_id"], 2, 50).select(
        "account_id", "year", "month", "commission")


@query("matched_stats_top20", "D18", """
SELECT instrument, count(*) AS trades, round(CAST(sum(CAST(round(net_pnl, 6) AS DECIMAL(18,6))) AS DOUBLE), 3) AS net_pnl FROM matched_trades
GROUP BY instrument ORDER BY count(*) DESC, instrument LIMIT 20""")
def stats(f):
    m = trading.match_trades(f.trades).withColumn("net_pnl", F.col("net_pnl").cast("decimal(18,6)"))
    return trading.matched_stats(m, top=20).select("instrument", "trades", F.round(F.col("net_pnl").cast("double"), 3).alias("net_pnl"))


@query("match_audit", "D33 G05", """
SELECT u.id, u.leg, u.matched_volume, u.uses, t.volume, abs(t.volume - u.matched_volume) > 0.01 AS volume_mismatch, u.uses > 1 AS multi_use
FROM (SELECT open_trade_id AS id, 'open' AS leg, CAST(sum(mv) AS BIGINT) AS matched_volume, count(*) AS uses FROM matched_trades GROUP BY 1
      UNION ALL SELECT close_trade_id, 'close', CAST(sum(mv) AS BIGINT), count(*) FROM matched_trades GROUP BY 1) u
JOIN trades t ON t.id = u.id WHERE abs(t.volume - u.matched_volume) > 0.01 OR u.uses > 1""")
def audit(f):
    return trading.match_audit(f.trades, trading.match_trades(f.trades))


@query("unmatched_trades", "G05", """
SELECT id, volume FROM trades WHERE id NOT IN (SELECT open_trade_id FROM matched_trades UNION SELECT close_trade_id FROM matched_trades)""")
def unmatched(f):
    return trading.unmatched_trades(f.trades, trading.match_trades(f.trades)).select("id", "volume")


@query("actual_vs_settlement_close", "K04", """
SELECT m.open_trade_id, m.close_trade_id, q.virtual_close_price,
       round((CASE WHEN open_direction = 'long' THEN q.virtual_close_price - open_price ELSE open_price - q.virtual_close_price END) * mv * multiplier, 4) AS virtual_money_pnl,
       round(net_pnl - ((CASE WHEN open_direction = 'long' THEN q.virtual_close_price - open_price ELSE open_price - q.virtual_close_price END) * mv * multiplier - commission), 3) AS pnl_difference
FROM matched_trades m JOIN (SELECT instrument, trade_date, max(price) AS virtual_close_price FROM trades GROUP BY ALL) q
  ON q.instrument = m.instrument AND q.trade_date = m.close_date""")
def hypothetical(f):
    q = f.trades.groupBy(F.col("instrument").alias("contract_code"), "trade_date").agg(F.max("price").alias("settle"))
    out = trading.hypothetical_close(trading.match_trades(f.trades), q)
    return out.select("open_trade_id", "close_trade_id", "virtual_close_price", F.round("virtual_money_pnl", 4).alias("virtual_money_pnl"),
                      F.round("pnl_difference", 3).alias("pnl_difference"))


@query("pnl_summary_per_account", "D13", """
SELECT account_id, count(*) AS trade_count, CAST(sum(total_pnl) AS DOUBLE) AS total_pnl, CAST(sum(commission) AS DOUBLE) AS total_fees,
       CAST(sum(total_pnl) AS DOUBLE) / count(*) AS avg_pnl_per_trade FROM trades GROUP BY account_id""")
def pnl_summary(f):
    return trading.pnl_summary(f.trades, ["account_id"]).withColumns(
        {c: F.col(c).cast("double") for c in ("total_pnl", "total_fees")})


@query("monthly_account_summary", "D14 E08 B09", """
SELECT account_id, year, month, start_date, end_date, bill_count, balance_b_f, balance_c_f, deposit_withdrawal, total_pnl, commission,
       client_equity, fund_available, margin_occupied, accumulated_pnl FROM account_summary""")
def monthly(f):
    out = trading.monthly_account_summary(f.bills)
    return out.select("account_id", F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month"), "start_date",
                      "end_date", "bill_count", "balance_b_f", "balance_c_f",
                      *[F.col(c).cast(D2).alias(c) for c in ("deposit_withdrawal", "total_pnl", "commission")],
                      "client_equity", "fund_available", "margin_occupied", F.col("accumulated_pnl").cast(D2).alias("accumulated_pnl"))


FLOWS_SQL = """
SELECT id AS bill_id, bill_date_end AS trade_date, 'deposit' AS flow_type, deposit_withdrawal AS amount, NULL AS symbol FROM bills WHERE deposit_withdrawal > 0
UNION ALL SELECT id, bill_date_end, 'unrealized_pnl', mtm_pl, NULL FROM bills WHERE mtm_pl <> 0
UNION ALL SELECT o_custkey * 100000 + date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)), CAST(o_orderdate AS DATE), 'commission', CAST(-5 * count(*) AS DECIMAL(18,2)), o_orderpriority
  FROM orders GROUP BY ALL
UNION ALL SELECT o_custkey * 100000 + date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)), CAST(o_orderdate AS DATE), 'realized_pnl', CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)), o_orderpriority
  FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL"""


def flows(f):
    day = F.to_date("o_orderdate")
    bill_id = (F.col("o_custkey") * 100000 + F.datediff(day, F.lit("1990-01-01").cast("date"))).cast("bigint")
    zero = F.lit(0).cast("decimal(18,2)")
    txn = f.table("orders").select(
        bill_id.alias("bill_id"), day.alias("trade_date"), F.col("o_orderpriority").alias("instrument"), F.lit(5).cast("decimal(18,2)").alias("fee"),
        zero.alias("premium"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(18,2)")).otherwise(zero).alias("realized_pl"))
    dep = f.bills.select(F.col("id").alias("bill_id"), F.col("bill_date_end").alias("trade_date"),
                         F.col("deposit_withdrawal").alias("deposit"), zero.alias("withdrawal"))
    st = f.bills.select(F.col("id").alias("bill_id"), "bill_date_end", "mtm_pl", "exercise_pl")
    return trading.fund_flows(dep, txn, st)


@query("fund_flows", "D15 B19", f"SELECT bill_id, trade_date, flow_type, CAST(amount AS DECIMAL(28,2)) AS amount, symbol FROM ({FLOWS_SQL}) x")
def fund_flows(f):
    return flows(f).select("bill_id", "trade_date", "flow_type", F.col("amount").cast(D2).alias("amount"), "symbol")


@query("fund_flow_identity", "D16", f"""
WITH fl AS ({FLOWS_SQL})
SELECT b.id AS bill_id, CAST(b.balance_cf - b.balance_bf AS DECIMAL(28,2)) AS balance_change, CAST(coalesce(s.t, 0) AS DECIMAL(28,2)) AS flow_total,
       abs(b.balance_cf - b.balance_bf - coalesce(s.t, 0)) <= 0.01 AS balanced
FROM bills b LEFT JOIN (SELECT bill_id, sum(amount) AS t FROM fl GROUP BY bill_id) s ON s.bill_id = b.id""")
def flow_identity(f):
    return trading.flow_identity(flows(f), f.bills).select(
        "bill_id", F.col("balance_change").cast(D2).alias("balance_change"), F.col("flow_total").cast(D2).alias("flow_total"), "balanced")


@query("fund_flow_breakdown", "D16", f"""
WITH fl AS ({FLOWS_SQL}) SELECT bill_id, flow_type, CAST(sum(amount) AS DECIMAL(28,2)) AS amount, count(*) AS entries FROM fl GROUP BY bill_id, flow_type""")
def flow_breakdown(f):
    return trading.flow_breakdown(flows(f)).withColumn("amount", F.col("amount").cast(D2))


RECON_SQL = """
SELECT id, instrument, ref, CASE WHEN ref IS NULL AND NOT found THEN 'no_quote' WHEN ref IS NULL THEN 'no_ref_price'
            WHEN (direction = 'buy' AND pct > 5) OR (direction <> 'buy' AND abs(pct) > 5) THEN 'alert' ELSE 'ok' END AS status,
       round(ref, 2) AS ref_price, round(price - ref, 2) AS slippage, round(pct, 4) AS slippage_pct, CASE WHEN ref IS NOT NULL THEN price BETWEEN lo AND hi END AS in_range
FROM (SELECT t.id, t.instrument, t.direction, t.price, q.ref, q.lo, q.hi, q.instrument IS NOT NULL AS found, (t.price - q.ref) / q.ref * 100 AS pct
      FROM trades t LEFT JOIN (SELECT instrument, trade_date, min(price) AS lo, max(price) AS hi,
                                      CASE WHEN count(*) % 5 <> 0 THEN CAST(sum(CAST(price AS DECIMAL(18,2)) * volume) AS DOUBLE) / nullif(CAST(sum(volume) AS DOUBLE), 0) END AS ref
                               FROM trades WHERE offset_flag = 'open' GROUP BY ALL) q ON q.instrument = t.instrument AND q.trade_date = t.trade_date) j"""


def _reconciled(f):
    n = F.count(F.lit(1))
    vwap = F.sum(F.col("price").cast("decimal(18,2)") * F.col("volume")).cast("double") / F.nullif(F.sum("volume").cast("double"), F.lit(0.0))
    q = f.trades.filter("offset_flag = 'open'").groupBy(F.col("instrument").alias("contract_code"), "trade_date").agg(
        F.min("price").alias("low"), F.max("price").alias("high"), F.when(n % 5 != 0, vwap).alias("vwap"),
        F.lit(0.0).alias("settle"), F.lit(None).cast("double").alias("close"))
    return trading.reconcile_trades(f.trades.withColumnRenamed("instrument", "contract_code"), q)


@query("slippage_reconciliation", "K05 C06", f"SELECT id, instrument, status, ref_price, slippage, slippage_pct, in_range FROM ({RECON_SQL}) r")
def reconcile(f):
    return _reconciled(f).select("id", F.col("contract_code").alias("instrument"), "status", "ref_price", "slippage", "slippage_pct", "in_range")


@query("slippage_report", "D28", f"""
SELECT count(*) AS total_trades, count(slippage_pct) AS matched_quotes, count(CASE WHEN status = 'no_quote' THEN 1 END) AS no_quotes,
       count(CASE WHEN status = 'alert' THEN 1 END) AS alert_count, round(CAST(sum(CAST(abs(slippage_pct) AS DECIMAL(20,4))) AS DOUBLE) / count(slippage_pct), 4) AS avg_slippage_pct,
       max(abs(slippage_pct)) AS max_slippage_pct, (array_agg(id ORDER BY abs(slippage_pct) DESC NULLS LAST, id DESC))[1] AS max_slippage_trade
FROM ({RECON_SQL}) r""")
def slippage_report(f):
    return trading.slippage_report(_reconciled(f))


@query("statement_balance_check", "K06", """
SELECT id, CAST(e AS DECIMAL(20,2)) AS expected_closing, CAST(abs(e - balance_cf) AS DECIMAL(20,2)) AS discrepancy,
       CASE WHEN abs(e - balance_cf) <= 0.01 THEN 'balanced' WHEN abs(e - balance_cf) <= 100 THEN 'suspicious' ELSE 'unbalanced' END AS balance_status
FROM (SELECT *, balance_bf + deposit_withdrawal + realized_pl + mtm_pl - commission AS e FROM bills) b""")
def balance_check(f):
    b = f.bills.select("id", F.col("balance_bf").alias("期初权益"), F.col("balance_cf").alias("balance_closing"),
                       F.col("deposit_withdrawal").alias("入金"), F.col("realized_pl").alias("realized_pnl"),
                       F.col("mtm_pl").alias("浮动盈亏"), F.col("commission").alias("手续费"))
    return trading.balance_check(b).select("id", "expected_closing", "discrepancy", "balance_status")


@query("fund_balance_equation", "K07", """
SELECT account_id, year, month, CAST(e AS DECIMAL(28,2)) AS expected_cf, CASE WHEN balance_c_f = 0 OR abs(balance_c_f - e) < 0.01 THEN 'pass'
       WHEN abs(balance_c_f - e) < balance_c_f * 0.05 THEN 'warn' ELSE 'fail' END AS verdict
FROM (SELECT *, balance_b_f + deposit_withdrawal + total_pnl - commission AS e FROM account_summary) s""")
def fund_balance(f):
    out = trading.fund_balance_rows(trading.monthly_account_summary(f.bills))
    return out.select("account_id", F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month"),
                      F.col("expected_cf").cast(D2).alias("expected_cf"), "verdict")


@query("missing_statements", "K08 C08", """
SELECT a.account_id, r.trade_date FROM (SELECT account_id, min(bill_date_start) AS s FROM bills GROUP BY account_id) a
JOIN resolved r ON r.is_trading AND r.trade_date BETWEEN a.s AND DATE '1996-06-30'
WHERE (a.account_id, r.trade_date) NOT IN (SELECT (account_id, bill_date_end) FROM bills)""")
def missing_statements(f):
    acc = f.bills.groupBy("account_id").agg(F.min("bill_date_start").alias("tracking_start"))
    return trading.missing_statements(acc, f.bills, f.resolved, "1996-06-30")


@query("missing_statements_last_10_days", "K08", """
SELECT a.account_id, r.trade_date FROM (SELECT account_id, min(bill_date_start) AS s FROM bills GROUP BY account_id) a
JOIN (SELECT * FROM resolved WHERE is_trading AND trade_date <= DATE '2001-06-29' ORDER BY trade_date DESC LIMIT 10) r ON r.trade_date >= a.s
WHERE (a.account_id, r.trade_date) NOT IN (SELECT (account_id, bill_date_end) FROM bills)""")
def missing_recent(f):
    acc = f.bills.groupBy("account_id").agg(F.min("bill_date_start").alias("tracking_start"))
    return trading.missing_statements(acc, f.bills, f.resolved, "2001-06-29", last_days=10)


CURVE_SQL = """
SELECT *, round(eq / 1000000.0 - 1, 8) AS cumulative_return, 1 - eq / greatest(max(eq) OVER w, 1000000) AS drawdown,
       p / coalesce(lag(eq) OVER (PARTITION BY account_id ORDER BY trade_date), 1000000) AS daily_return
FROM (SELECT account_id, trade_date, CAST(p AS DOUBLE) AS p, CAST(1000000 + sum(p) OVER (PARTITION BY account_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS eq
      FROM (SELECT account_id, trade_date, sum(total_pnl) AS p FROM trades GROUP BY ALL) d) e
WINDOW w AS (PARTITION BY account_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING)"""


def _curve(f):
    daily = f.trades.groupBy("account_id", "trade_date").agg(F.sum("total_pnl").alias("daily_pnl"))
    return trading.equity_curve(daily, "account_id", 1000000)


@query("equity_curve", "E12 D20", f"""
SELECT account_id, trade_date, p AS daily_pnl, eq AS total_equity, cumulative_return, round(drawdown, 8) AS drawdown, round(daily_return, 8) AS daily_return FROM ({CURVE_SQL}) c""")
def equity_curve(f):
    c = _curve(f)
    return rounded(c.withColumns({n: F.col(n).cast("double") for n in ("daily_pnl", "total_equity")}), 8,
                   "cumulative_return", "drawdown", "daily_return")


@query("strategy_stats", "D20", f"""
WITH c AS ({CURVE_SQL}), t AS (SELECT account_id, count(*) AS total_trades, count(CASE WHEN total_pnl > 0 THEN 1 END) AS win_trades, count(CASE WHEN total_pnl <= 0 THEN 1 END) AS loss_trades,
       CAST(sum(total_pnl) AS DOUBLE) AS total_pnl, CAST(sum(CASE WHEN total_pnl > 0 THEN total_pnl END) AS DOUBLE) / abs(CAST(sum(CASE WHEN total_pnl < 0 THEN total_pnl END) AS DOUBLE)) AS profit_factor,
       CAST(sum(volume) AS DOUBLE) / count(*) AS avg_holding_days FROM trades GROUP BY account_id)
SELECT t.account_id, t.total_trades, t.win_trades, t.loss_trades, t.total_pnl, round(t.profit_factor, 6) AS profit_factor, round(t.avg_holding_days, 6) AS avg_holding_days,
       round(CAST(t.win_trades AS DOUBLE) / t.total_trades, 6) AS win_rate, round(max(c.drawdown), 8) AS max_drawdown,
       round(avg(c.daily_return) / stddev_samp(c.daily_return) * sqrt(252.0), 4) AS sharpe_ratio
FROM t JOIN c ON c.account_id = t.account_id GROUP BY ALL""")
def strategy_stats(f):
    t = f.trades.withColumn("holding_days", F.col("volume"))
    out = trading.strategy_stats(t, _curve(f), "account_id", pnl="total_pnl")
    out = rounded(rounded(out.withColumn("total_pnl", F.col("total_pnl").cast("double")), 6, "profit_factor", "avg_holding_days", "win_rate"), 8, "max_drawdown")
    return rounded(out, 4, "sharpe_ratio").drop("avg_pnl")


@query("position_summaries", "B08", """
SELECT trade_date, instrument, CAST(sum(CASE WHEN direction = 'buy' THEN volume ELSE 0 END) AS BIGINT) AS long_position,
       CAST(sum(CASE WHEN direction = 'sell' THEN volume ELSE 0 END) AS BIGINT) AS short_position
FROM trades WHERE offset_flag = 'open' AND trade_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28' GROUP BY trade_date, instrument""")
def position_summaries(f):
    from tickloom.functions.scalars import long_short_columns
    rows = Q.select_where(f.trades, equals={"offset_flag": "open"}, start={"trade_date": "2024-01-03"}, end={"trade_date": "2024-01-28"})
    long, short = long_short_columns("direction", "volume")
    return rows.groupBy("trade_date", "instrument").agg(F.sum(long).alias("long_position"), F.sum(short).alias("short_position"))


@query("statements_with_account_names", "C07", """
SELECT b.id, b.account_id, c.c_name, c.c_mktsegment FROM bills b LEFT JOIN (SELECT 'C' || c_custkey AS account_id, c_name, c_mktsegment FROM customer) c ON c.account_id = b.account_id""")
def statements_named(f):
    from tickloom.operators.joins import lookup
    dim = f.table("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("account_id"), "c_name", "c_mktsegment")
    return lookup(f.bills.select("id", "account_id"), dim, ["account_id"])


@query("running_volume_per_instrument", "E17", """
SELECT id, CAST(sum(volume) OVER (PARTITION BY instrument ORDER BY trade_date, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM trades""")
def running_volume(f):
    rows = f.trades.select("instrument", "trade_date", "id", "volume").withColumn("_b", ordered.id_block("id", 1000))
    return ordered.prefix_scan(rows, ["instrument"], ["trade_date", "_b"], ["trade_date", "id"],
                               [ordered.Scan("running", "sum", F.col("volume"))]).select("id", "running")


@query("account_compare", "C10 L17", """
SELECT 'account_summary_consistency' AS "check", CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status, 'account_summary' AS source,
       CAST(n AS VARCHAR) AS expected, CAST(bad AS VARCHAR) AS actual, CAST(bad AS DOUBLE) AS deviation
FROM (SELECT count(*) AS n, count(CASE WHEN month IN (3, 7) OR (month = 5 AND abs(balance_c_f * 0.001) > 0.01) THEN 1 END) AS bad FROM account_summary) x""")
def account_compare(f):
    """Monthly summaries against a copy that lost July, gained a cent and a half in March and drifts in May."""
    own = trading.monthly_account_summary(f.bills)
    cf = F.col("balance_c_f").cast("double")
    copy = own.filter("month <> 7").withColumn("client_equity", F.when(F.col("month") == 3, F.col("client_equity").cast("double") + 0.015)
                                               .otherwise(F.col("client_equity").cast("double"))) \
        .withColumn("balance_c_f", F.when(F.col("month") == 5, cf * 1.001).otherwise(cf))
    return quality.account_summary_consistency(own, copy)


@query("account_compare_rows", "C10", """
SELECT account_id, year, month, CASE WHEN month = 7 THEN 'left_only' WHEN month = 3 THEN 'mismatch' ELSE 'match' END AS status FROM account_summary""")
def account_compare_rows(f):
    from tickloom.operators.joins import compare_rows
    own = trading.monthly_account_summary(f.bills)
    copy = own.filter("month <> 7").withColumn("client_equity", F.col("client_equity").cast("double") + F.when(F.col("month") == 3, 0.015).otherwise(0.005))
    return compare_rows(own, copy, ["account_id", "year", "month"], ["balance_b_f", "balance_c_f", "client_equity"]) \
        .select("account_id", "year", "month", "status")
