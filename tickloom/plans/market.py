"""Quotes, bars, positions, contracts: queries over market frames."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import bars, contracts, joins, positions, query as Q
from tickloom.plans.registry import query
from tickloom.schemas import struct_of
from tickloom.session import shared_dir
from tickloom.sources import tables


def as_double(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def rounded(df, digits=6, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


BAR_SQL = """
SELECT exchange, contract_code, frequency, bar_start, CAST(bar_start AS DATE) AS trade_date, strftime(bar_start, '%H:%M:%S') AS trade_time,
       open, high, low, close, volume, CAST(turnover AS DOUBLE) AS turnover, open_interest,
       CASE WHEN volume <> 0 THEN round(CAST(turnover AS DOUBLE) / volume, 6) END AS vwap
FROM (SELECT exchange, contract_code, f.frequency, time_bucket(to_minutes(f.m), ts) AS bar_start, arg_min(open, ts) AS open, max(high) AS high,
             min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume, sum(turnover) AS turnover,
             arg_max(open_interest, ts) AS open_interest
      FROM ticks, (VALUES {freqs}) f(frequency, m) WHERE close IS NOT NULL
      GROUP BY exchange, contract_code, f.frequency, time_bucket(to_minutes(f.m), ts)) b"""


def _bars_out(df):
    return rounded(as_double(df, "turnover"), 6, "vwap").drop("source")


@query("resample_60min", "D01 H02", BAR_SQL.format(freqs="('60min', 60)"))
def resample_60min(f):
    return _bars_out(bars.resample(f.ticks, ["60min"]))


@query("resample_all_frequencies", "D01 A16", BAR_SQL.format(freqs="('5min', 5), ('15min', 15), ('30min', 30), ('60min', 60)"))
def resample_all(f):
    return _bars_out(bars.resample(f.ticks))


@query("resample_within_sessions", "D01 C14", """
SELECT exchange, contract_code, time_bucket(INTERVAL 30 MINUTE, ts) AS bar_start, arg_min(open, ts) AS open, max(high) AS high,
       min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume
FROM ticks WHERE close IS NOT NULL
 AND (strftime(ts, '%H:%M') BETWEEN '09:00' AND '11:30' OR strftime(ts, '%H:%M') BETWEEN '13:00' AND '15:00'
      OR strftime(ts, '%H:%M') >= '21:00' OR strftime(ts, '%H:%M') <= '02:30')
GROUP BY ALL""")
def resample_sessions(f):
    out = bars.resample(f.ticks, ["30min"], sessions=[("09:00", "11:30"), ("13:00", "15:00"), ("21:00", "02:30")])
    return out.select("exchange", "contract_code", "bar_start", "open", "high", "low", "close", "volume")


@query("weekly_bars", "D02", """
SELECT contract_code, CAST(date_trunc('week', trade_date) + INTERVAL 6 DAY AS DATE) AS week_end, arg_min(open, trade_date) AS open, max(high) AS high,
       min(low) AS low, arg_max(close, trade_date) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(turnover) AS DOUBLE) AS turnover,
       arg_max(open_interest, trade_date) AS open_interest
FROM daily_quotes GROUP BY ALL""")
def weekly_bars(f):
    return as_double(bars.daily_to_weekly(f.daily_quotes), "turnover").drop("frequency", "source")


@query("resample_sanity", "D03", """
SELECT contract_code, frequency, m AS resampled_bars, n AS original_bars, greatest(1, n // r) AS expected_bars,
       m BETWEEN 0.5 * greatest(1, n // r) AND 1.5 * greatest(1, n // r) AS valid
FROM (SELECT contract_code, f.frequency, f.r, count(DISTINCT time_bucket(to_minutes(f.r), ts)) AS m
      FROM ticks, (VALUES ('5min', 5), ('15min', 15), ('30min', 30), ('60min', 60)) f(frequency, r) WHERE close IS NOT NULL GROUP BY ALL) a
JOIN (SELECT contract_code, count(*) AS n FROM ticks GROUP BY contract_code) b USING (contract_code)""")
def resample_sanity(f):
    out = bars.validate_resample(f.ticks, bars.resample(f.ticks), ["contract_code"])
    return out.select("contract_code", "frequency", "resampled_bars", "original_bars", "expected_bars", "valid")


@query("daily_vwap", "D04", """
SELECT contract_code, trade_date, round(CAST(sum(CAST(price AS DECIMAL(18,2)) * volume) AS DOUBLE) / CAST(sum(volume) AS DOUBLE), 4) AS vwap
FROM ticks WHERE volume > 0 GROUP BY contract_code, trade_date""")
def daily_vwap(f):
    return bars.daily_vwap(f.ticks.withColumn("price", F.col("price").cast("decimal(18,2)")), price="price")


@query("daily_market_stats", "D08", """
SELECT product_code, trade_date, CAST(sum(volume) AS BIGINT) AS total_volume, max(volume) AS max_volume, min(volume) AS min_volume,
       CAST(sum(volume) AS DOUBLE) / count(volume) AS mean_volume,
       CAST(sum(turnover) AS DOUBLE) AS total_turnover, CAST(max(turnover) AS DOUBLE) AS max_turnover, CAST(min(turnover) AS DOUBLE) AS min_turnover,
       CAST(sum(turnover) AS DOUBLE) / count(turnover) AS mean_turnover,
       CAST(sum(open_interest) AS BIGINT) AS total_open_interest, max(open_interest) AS max_open_interest, min(open_interest) AS min_open_interest,
       CAST(sum(open_interest) AS DOUBLE) / count(open_interest) AS mean_open_interest,
       CAST(sum(oi_change) AS BIGINT) AS total_oi_change, max(oi_change) AS max_oi_change, min(oi_change) AS min_oi_change,
       CAST(sum(oi_change) AS DOUBLE) / count(oi_change) AS mean_oi_change, count(DISTINCT contract_code) AS contract_count
FROM (SELECT *, open_interest - lag(open_interest) OVER (PARTITION BY contract_code ORDER BY trade_date) AS oi_change FROM catalog_quotes) q GROUP BY product_code, trade_date""")
def daily_market_stats(f):
    before = F.lag("open_interest").over(Window.partitionBy("contract_code").orderBy("trade_date"))
    rows = f.contract_series.withColumn("oi_change", F.col("open_interest") - before)
    return as_double(bars.daily_market_stats(rows, ["product_code", "trade_date"]), "total_turnover", "max_turnover", "min_turnover")


@query("contract_stats", "D09", """
SELECT contract_code, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(turnover) AS DOUBLE) AS turnover, arg_max(open_interest, trade_date) AS open_interest
FROM daily_quotes GROUP BY contract_code""")
def contract_stats(f):
    return as_double(bars.contract_stats(f.daily_quotes), "turnover")


@query("quote_summary", "D10", """
SELECT contract_code, count(*) AS data_points, min(trade_date) AS first_date, max(trade_date) AS last_date,
       round(avg(CASE WHEN close <> 0 THEN close END), 4) AS avg_close, max(CASE WHEN close <> 0 THEN close END) AS max_close,
       min(CASE WHEN close <> 0 THEN close END) AS min_close, max(CASE WHEN volume <> 0 THEN volume END) AS max_volume
FROM daily_quotes GROUP BY contract_code""")
def quote_summary(f):
    return rounded(bars.quote_summary(f.daily_quotes), 4, "avg_close")


@query("minute_summary", "D11", """
SELECT contract_code, count(*) AS bar_count, min(trade_time) AS first_time, max(trade_time) AS last_time, min(low) AS low, max(high) AS high,
       CAST(sum(volume) AS BIGINT) AS total_volume, CAST(sum(turnover) AS DOUBLE) AS total_turnover, count(DISTINCT trade_date) AS day_count
FROM ticks GROUP BY contract_code""")
def minute_summary(f):
    return as_double(bars.minute_summary(f.ticks), "total_turnover")


@query("frequencies_per_contract", "D12", """
SELECT contract_code, frequency, count(*) AS bar_count, min(trade_date) AS min_date, max(trade_date) AS max_date,
       CASE frequency WHEN '5min' THEN 2 WHEN '15min' THEN 3 WHEN '30min' THEN 4 ELSE 5 END AS sort_rank
FROM (SELECT DISTINCT contract_code, f.frequency, time_bucket(to_minutes(f.r), ts) AS b, CAST(time_bucket(to_minutes(f.r), ts) AS DATE) AS trade_date
      FROM ticks, (VALUES ('5min', 5), ('15min', 15), ('30min', 30), ('60min', 60)) f(frequency, r) WHERE close IS NOT NULL) x
GROUP BY ALL""")
def frequencies(f):
    return bars.list_frequencies(bars.resample(f.ticks))


@query("contracts_with_minutes", "B31", "SELECT DISTINCT contract_code FROM ticks ORDER BY contract_code")
def contracts_with_minutes(f):
    return bars.minute_contracts(f.ticks)


# ------------------------------------------------------------------ facade filters

@query("quotes_by_exchange_and_dates", "B01 A22", """
SELECT exchange, contract_code, trade_date, close, volume FROM daily_quotes
WHERE exchange = 'EX1' AND trade_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""")
def quotes_filter(f):
    out = Q.select_where(f.daily_quotes, equals={"exchange": "EX1", "contract_code": None},
                         start={"trade_date": "1997-01-01"}, end={"trade_date": "1999-12-31"},
                         order=["trade_date", "contract_code"])
    return out.select("exchange", "contract_code", "trade_date", "close", "volume")


@query("minute_quotes_by_dates", "B02", """
SELECT contract_code, trade_date, trade_time, price, volume FROM ticks
WHERE exchange = 'EVT' AND trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def minute_filter(f):
    out = Q.select_where(f.ticks, equals={"exchange": "EVT"}, start={"trade_date": "2024-01-05"},
                         end={"trade_date": "2024-01-20"}, order=["trade_date", "trade_time"])
    return out.select("contract_code", "trade_date", "trade_time", "price", "volume")


@query("positions_by_exchange", "B03", """
SELECT trade_date, contract_code, member_name, long_volume, short_volume, long_volume - short_volume AS net_position FROM positions
WHERE exchange = 'EX0' AND trade_date >= DATE '1998-01-01'""")
def positions_filter(f):
    out = Q.select_where(f.positions, equals={"exchange": "EX0"}, start={"trade_date": "1998-01-01"},
                         order=[F.desc("trade_date"), F.desc("long_volume")])
    return out.select("trade_date", "contract_code", "member_name", "long_volume", "short_volume",
                      (F.col("long_volume") - F.col("short_volume")).alias("net_position"))


@query("contracts_by_type", "B04 B26", """
SELECT contract_code, exchange, product_code, contract_type, listing_date, last_trade_date, status FROM contracts WHERE contract_type = 'futures'""")
def contracts_filter(f):
    return Q.select_where(f.contracts, equals={"contract_type": "futures", "product_code": None}, order=["contract_code"])


@query("contracts_by_prefix", "B30 H03", """
SELECT contract_code, count(*) AS n, upper(regexp_extract(contract_code, '^([A-Za-z]+)', 1)) AS product FROM daily_quotes
WHERE starts_with(contract_code, 'S') GROUP BY contract_code""")
def prefix_filter(f):
    out = Q.select_where(f.daily_quotes, prefix={"contract_code": "S"})
    return out.groupBy("contract_code").agg(F.count(F.lit(1)).alias("n")) \
              .withColumn("product", S.product_code("contract_code"))


@query("snapshots_of_symbols", "B29", """
SELECT contract_code, max(ts) AS updated_at, arg_max(price, ts) AS price FROM ticks WHERE contract_code IN ('U1', 'U2', 'U3', 'U5', 'U8') GROUP BY contract_code""")
def batch_symbols(f):
    rows = Q.select_where(f.ticks, isin={"contract_code": ["U1", "U2", "U3", "U5", "U8"]})
    return rows.groupBy("contract_code").agg(F.max("ts").alias("updated_at"), F.max_by("price", "ts").alias("price"))


@query("minute_page", "B17 B18", """
SELECT id, contract_code, trade_date, trade_time, price FROM ticks WHERE trade_date >= DATE '2024-01-03'
ORDER BY trade_date, trade_time, id LIMIT 100 OFFSET 200""")
def minute_page(f):
    rows = Q.select_where(f.ticks, start={"trade_date": "2024-01-03"})
    return Q.page(rows, ["trade_date", "trade_time", "id"], 3, 100).select("id", "contract_code", "trade_date", "trade_time", "price")


@query("minute_page_after_key", "B17 B18", """
SELECT id, contract_code, trade_date, trade_time, price FROM ticks WHERE (trade_date, trade_time, id) > (DATE '2024-01-04', '10:30', 40)
ORDER BY trade_date, trade_time, id LIMIT 100""")
def minute_page_after(f):
    rows = Q.page_after(f.ticks, dict.fromkeys(("trade_date", "trade_time", "id"), True), ("2024-01-04", "10:30", 40))
    return rows.select("id", "contract_code", "trade_date", "trade_time", "price")


@query("minute_page_total", "B17", "SELECT count(*) AS total FROM ticks WHERE trade_date >= DATE '2024-01-03'")
def minute_total(f):
    return Q.total(Q.select_where(f.ticks, start={"trade_date": "2024-01-03"}))


@query("vendor_daily_rows", "B13 H06", """
SELECT contract_code || '.' || exchange AS ts_code, trade_date, close, volume FROM daily_quotes
WHERE trade_date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'""")
def vendor_daily(f):
    rows = f.daily_quotes.withColumn("ts_code", F.concat_ws(".", "contract_code", "exchange"))
    return Q.select_where(rows, start={"trade_date": "1998-01-01"}, end={"trade_date": "1998-06-30"},
                          order=["trade_date"]).select("ts_code", "trade_date", "close", "volume")


@query("index_prices_by_code", "B20", """
SELECT underlying AS index_code, trade_date, close, high, low, volume FROM underlying_daily
WHERE underlying = 'MO' AND trade_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'""")
def index_prices(f):
    rows = f.underlying_daily.withColumnRenamed("underlying", "index_code")
    return Q.select_where(rows, equals={"index_code": "MO"}, start={"trade_date": "1998-01-01"},
                          end={"trade_date": "2000-12-31"}, order=["trade_date"])


@query("events_by_severity", "B27 B32", """
SELECT event_id, event_type, ts FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'
ORDER BY ts DESC, event_id LIMIT 50""")
def event_log(f):
    rows = Q.select_where(f.table("events"), equals={"event_type": "error"},
                          where=[F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"),
                                 F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz")])
    return Q.page(rows, [F.desc("ts"), "event_id"], 1, 50).select("event_id", "event_type", "ts")


# ------------------------------------------------------------------ contracts

@query("expiring_contracts", "B21", """
SELECT contract_code, last_trade_date FROM contracts WHERE status = 'active' AND last_trade_date BETWEEN DATE '2001-10-10' AND DATE '2001-10-10' + 30""")
def expiring(f):
    return contracts.expiring(f.contracts, "2001-10-10", 30).select("contract_code", "last_trade_date")


@query("expired_contracts_marked", "B22", """
SELECT contract_code, last_trade_date, CASE WHEN status = 'active' AND last_trade_date <= DATE '2001-10-20' THEN 'expired' ELSE status END AS status FROM contracts""")
def mark_expired(f):
    return contracts.mark_expired(f.contracts, "2001-10-20").select("contract_code", "last_trade_date", "status")


@query("symbols_auto_deactivated", "B23", """
SELECT contract_code AS symbol, last_trade_date AS subscribe_until, CASE WHEN last_trade_date < DATE '2001-10-20' THEN 0 ELSE 1 END AS is_active FROM contracts""")
def auto_deactivate(f):
    cat = f.contracts.select(F.col("contract_code").alias("symbol"), F.col("last_trade_date").alias("subscribe_until"), F.lit(1).alias("is_active"))
    return contracts.auto_deactivate(cat, "2001-10-20")


@query("events_retained", "B24", "SELECT count(*) AS kept, min(ts) AS first_ts FROM events WHERE ts >= DATE '2024-04-10' - 90")
def retained(f):
    return contracts.retain_since(f.table("events"), "2024-04-10", 90, "ts").agg(
        F.count(F.lit(1)).alias("kept"), F.min("ts").alias("first_ts"))


@query("contract_master_sync", "A21", """
SELECT coalesce(o.contract_code, n.contract_code) AS contract_code, CASE WHEN o.contract_code IS NULL THEN n.listing_date ELSE o.listing_date END AS listing_date,
       CASE WHEN o.contract_code IS NULL THEN n.delisting_date WHEN n.delisting_date IS NOT NULL THEN n.delisting_date END AS delisting_date,
       CASE WHEN o.contract_code IS NULL THEN 'active' WHEN n.delisting_date IS NOT NULL THEN 'delisted' ELSE 'active' END AS status,
       CASE WHEN o.contract_code IS NULL THEN 'inserted' WHEN n.delisting_date IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS sync_action
FROM (SELECT contract_code, listing_date FROM contracts WHERE listing_date < DATE '1995-02-01') o
FULL JOIN (SELECT contract_code, listing_date, CASE WHEN last_trade_date < DATE '2001-10-25' THEN last_trade_date END AS delisting_date FROM contracts) n
  ON n.contract_code = o.contract_code""")
def contract_sync(f):
    current = f.contracts.filter("listing_date < date '1995-02-01'").select(
        "contract_code", "listing_date", F.lit(None).cast("date").alias("delisting_date"), F.lit("active").alias("status"))
    feed = f.contracts.select("contract_code", "listing_date",
                              F.expr("case when last_trade_date < date '2001-10-25' then last_trade_date end").alias("delisting_date"))
    return contracts.sync_contract_master(current, feed)


MAIN_SQL = """
SELECT product_code, trade_date, contract_code FROM (
  SELECT c.product_code, q.trade_date, q.contract_code,
         row_number() OVER (PARTITION BY c.product_code, q.trade_date ORDER BY q.open_interest DESC, q.contract_code) AS rn
  FROM daily_quotes q JOIN contracts c ON c.contract_code = q.contract_code WHERE c.status = 'active') m WHERE rn = 1"""


@query("main_contracts", "F03 C01 F05", MAIN_SQL)
def main_contracts(f):
    return contracts.main_contracts(f.daily_quotes, f.contracts).select("product_code", "trade_date", "contract_code")


@query("main_contracts_auto_populate", "F04", f"""
WITH main AS ({MAIN_SQL}) SELECT * FROM main WHERE trade_date >= DATE '1999-01-01'""")
def auto_populate(f):
    full = contracts.main_contracts(f.daily_quotes, f.contracts)
    have = full.filter("trade_date < date '1999-01-01'")
    return contracts.auto_populate(f.daily_quotes, f.contracts, have).select("product_code", "trade_date", "contract_code")


@query("rollover_dates", "E10", f"""
WITH main AS ({MAIN_SQL}), seq AS (SELECT *, lag(contract_code) OVER (PARTITION BY product_code ORDER BY trade_date) AS prev FROM main)
SELECT product_code, trade_date, prev AS from_contract, contract_code AS to_contract FROM seq WHERE prev <> contract_code""")
def rollover_dates(f):
    return contracts.rollovers(contracts.main_contracts(f.daily_quotes, f.contracts))


@query("live_contract_on_date", "C11", """
SELECT d.product_code, d.trade_date, arg_max(c.contract_code, c.listing_date || c.contract_code) AS contract_code
FROM (SELECT DISTINCT product_code, trade_date FROM catalog_quotes) d
LEFT JOIN contracts c ON c.product_code = d.product_code AND d.trade_date BETWEEN c.listing_date AND c.last_trade_date
GROUP BY ALL""")
def live_contract(f):
    dates = f.catalog_quotes.select("product_code", "trade_date").distinct()
    c = f.contracts.withColumnRenamed("last_trade_date", "delisting_date")
    return joins.live_on_date(dates, c.select("product_code", "contract_code", "listing_date", "delisting_date"), "product_code")


@query("front_month_by_third_friday", "H08", """
SELECT trade_date, third AS third_friday, 'MO' || strftime(CASE WHEN trade_date >= third THEN m + INTERVAL 1 MONTH ELSE m END, '%y%m') AS front_contract
FROM (SELECT trade_date, CAST(date_trunc('month', trade_date) AS DATE) AS m,
             CAST(date_trunc('month', trade_date) AS DATE) + ((5 - isodow(CAST(date_trunc('month', trade_date) AS DATE)) + 7) % 7)::INT + 14 AS third
      FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS trade_date FROM orders) x) y""")
def front_month(f):
    d = f.table("orders").select(F.to_date("o_orderdate").alias("trade_date")).distinct()
    return d.select("trade_date", S.third_friday("trade_date").alias("third_friday"),
                    S.front_month_contract("MO", "trade_date").alias("front_contract"))


# ------------------------------------------------------------------ positions

WIDE_SQL = """SELECT l.trade_date, l.contract_code, l.rank, l.member_name AS long_member, l.long_volume, s.member_name AS short_member, s.short_volume
  FROM positions l JOIN (SELECT *, row_number() OVER (PARTITION BY trade_date, contract_code ORDER BY short_volume DESC, member_name) AS srank FROM positions) s
    ON s.trade_date = l.trade_date AND s.contract_code = l.contract_code AND s.srank = l.rank"""


def _wide(f):
    from pyspark.sql import Window
    w = Window.partitionBy("trade_date", "contract_code").orderBy(F.desc("short_volume"), "member_name")
    s = f.positions.select("trade_date", "contract_code", F.row_number().over(w).alias("rank"),
                           F.col("member_name").alias("short_member"), "short_volume")
    l = f.positions.select("trade_date", "contract_code", "rank", F.col("member_name").alias("long_member"), "long_volume")
    return l.join(s, ["trade_date", "contract_code", "rank"]) \
            .withColumn("long_change", F.lit(0).cast("bigint")).withColumn("short_change", F.lit(0).cast("bigint"))


@query("ranking_one_row_per_side", "A04", f"""
WITH w AS ({WIDE_SQL})
SELECT trade_date, contract_code, rank, 'long' AS side, long_member AS member_name, long_volume AS volume FROM w
UNION ALL SELECT trade_date, contract_code, rank, 'short', short_member, short_volume FROM w""")
def ranking_sides(f):
    return positions.unpivot_ranking(_wide(f)).select("trade_date", "contract_code", "rank", "side", "member_name", "volume")


@query("ranking_merged_by_rank", "A05", f"""
WITH w AS ({WIDE_SQL}) SELECT trade_date, contract_code, rank, long_member AS member_name, long_volume, short_volume FROM w""")
def merged_by_rank(f):
    return positions.merge_by_rank(positions.unpivot_ranking(_wide(f))) \
        .select("trade_date", "contract_code", "rank", "member_name", "long_volume", "short_volume")


@query("ranking_merged_by_member", "A05", "SELECT trade_date, contract_code, member_name, long_volume, short_volume FROM positions")
def merged_by_member(f):
    return positions.merge_by_member(positions.unpivot_ranking(_wide(f))) \
        .select("trade_date", "contract_code", "member_name", "long_volume", "short_volume")


@query("contract_position_summary", "D07", """
SELECT trade_date, contract_code, count(member_name) AS member_count, CAST(sum(long_volume) AS BIGINT) AS total_long, CAST(sum(short_volume) AS BIGINT) AS total_short,
       first(member_name ORDER BY long_volume DESC, member_name) AS top_long_member, first(member_name ORDER BY short_volume DESC, member_name) AS top_short_member,
       CAST(sum(long_volume) - sum(short_volume) AS BIGINT) AS total_net
FROM positions GROUP BY trade_date, contract_code""")
def position_summary(f):
    return positions.contract_position_summary(f.positions)


@query("position_feature_daily", "D30", """
SELECT trade_date, contract_code, max(long_volume) AS top_long_volume, max(short_volume) AS top_short_volume,
       CAST(sum(long_volume) - sum(short_volume) AS BIGINT) AS net_institutional_flow,
       round(CAST(sum(long_volume) AS DOUBLE) / nullif(sum(short_volume), 0), 6) AS oi_ratio,
       round(CAST(sum(long_volume) AS DOUBLE) / nullif(sum(long_volume) + sum(short_volume), 0), 6) AS long_institutional_pct,
       round(CAST(sum(long_volume) - sum(short_volume) AS DOUBLE) / nullif(sum(long_volume) + sum(short_volume), 0), 6) AS sentiment_score
FROM positions GROUP BY trade_date, contract_code""")
def position_features(f):
    out = rounded(positions.feature_daily(f.positions), 6, "oi_ratio", "long_institutional_pct", "sentiment_score")
    return out.select("trade_date", "contract_code", "top_long_volume", "top_short_volume", "net_institutional_flow",
                      "oi_ratio", "long_institutional_pct", "sentiment_score")


@query("top_holders", "F01", """
SELECT trade_date, contract_code, side, member_name, volume, position FROM (
  SELECT trade_date, contract_code, side, member_name, volume, row_number() OVER (PARTITION BY trade_date, contract_code, side ORDER BY volume DESC, member_name) AS position
  FROM (SELECT trade_date, contract_code, member_name, 'long' AS side, long_volume AS volume FROM positions
        UNION ALL SELECT trade_date, contract_code, member_name, 'short', short_volume FROM positions) u) r WHERE position <= 20""")
def top_holders(f):
    return positions.top_holders(f.positions, 20)


@query("top_members_of_day", "F02", """
SELECT trade_date, side, member_name, volume, position FROM (
  SELECT *, row_number() OVER (PARTITION BY trade_date, side ORDER BY volume DESC, member_name) AS position
  FROM (SELECT trade_date, member_name, 'long' AS side, CAST(sum(long_volume) AS BIGINT) AS volume FROM positions GROUP BY ALL
        UNION ALL SELECT trade_date, member_name, 'short', CAST(sum(short_volume) AS BIGINT) FROM positions GROUP BY ALL) u) r WHERE position <= 10""")
def top_members(f):
    return positions.top_members(f.positions, 10)


# ------------------------------------------------------------------ merge semantics of the writers

@query("upsert_last_write_wins", "A13 A15", """
SELECT exchange, contract_code, trade_date, close, volume FROM (
  SELECT exchange, contract_code, trade_date, price AS close, volume, row_number() OVER (PARTITION BY contract_code, trade_date ORDER BY id) AS first_rn,
         row_number() OVER (PARTITION BY contract_code, trade_date ORDER BY id DESC) AS last_rn FROM ticks) x
WHERE CASE WHEN trade_date >= DATE '2024-01-10' THEN last_rn = 1 ELSE first_rn = 1 END""")
def upsert_last(f):
    keys = ["exchange", "contract_code", "trade_date"]
    rows = f.ticks.select(*keys, F.col("price").alias("close"), "volume", "id")
    stored = rows.groupBy(*keys).agg(F.min_by("close", "id").alias("close"), F.min_by("volume", "id").alias("volume"))
    return tables.merge_last_wins(stored, rows.filter("trade_date >= date '2024-01-10'"), keys, ["id"])


@query("append_first_write_wins", "A16", """
SELECT contract_code, trade_date, price AS close FROM (
  SELECT *, row_number() OVER (PARTITION BY contract_code, trade_date ORDER BY id) AS rn FROM ticks) x
WHERE rn = 1 AND (contract_code, trade_date) NOT IN (SELECT (contract_code, trade_date) FROM ticks WHERE source = 'view')""")
def append_first(f):
    rows = f.ticks.select("contract_code", "trade_date", F.col("price").alias("close"), "id", "source")
    have = rows.filter("source = 'view'").select("contract_code", "trade_date").distinct()
    return tables.merge_first_wins(have, rows, ["contract_code", "trade_date"], ["id"]).select("contract_code", "trade_date", "close")


@query("replace_touched_groups", "A14", """
SELECT trade_date, contract_code, member_name, long_volume FROM positions
WHERE long_volume >= 50 OR (trade_date, contract_code) NOT IN (SELECT (trade_date, contract_code) FROM positions WHERE long_volume >= 50)""")
def replace_groups(f):
    cols = ["trade_date", "contract_code", "member_name", "long_volume"]
    incoming = f.positions.filter("long_volume >= 50").select(*cols)
    return tables.replace_groups(f.positions.select(*cols), incoming, ["trade_date", "contract_code"])


@query("copy_latest_day", "A20 A19", """
SELECT trade_date, contract_code, member_name, long_volume, short_volume FROM positions WHERE trade_date = (SELECT max(trade_date) FROM positions)""")
def copy_latest(f):
    """Copies twice into a table of the shared folder (the second time changes nothing) and reads it."""
    path = f"{shared_dir(f.spark)}/latest-{uuid.uuid4().hex}"
    rows = f.positions.select("trade_date", "contract_code", "member_name", "long_volume", "short_volume")
    for _ in range(2):
        tables.copy_latest_day(f.spark, rows, path, ["trade_date", "contract_code", "member_name"], ["long_volume"])
    return f.spark.read.parquet(path).select(*rows.columns)


@query("archive_rows", "A19 A17", """
SELECT CASE WHEN trade_date < DATE '2024-01-21' THEN 'archive' ELSE 'table' END AS place, trade_date, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume
FROM ticks GROUP BY ALL""")
def archive_rows(f):
    """Moves the old days of a written table into an archive, twice, and reads both back."""
    work = f"{shared_dir(f.spark)}/archive-{uuid.uuid4().hex}"
    tables.write_partitioned(f.ticks.select("id", "contract_code", "trade_date", "volume"), f"{work}/table")
    for _ in range(2):
        tables.move_to_archive(f.spark, f"{work}/table", f"{work}/archive", "2024-02-20", 30)
    both = [f.spark.read.parquet(f"{work}/{place}").withColumn("place", F.lit(place)) for place in ("table", "archive")]
    return both[0].unionByName(both[1]).groupBy("place", "trade_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


MIGRATED = struct_of("exchange string, contract_code string, trade_date date, close double, settle double, volume bigint, source string")


@query("migrate_legacy_quotes", "A18", """
SELECT 'CFFEX' AS exchange, contract_code, trade_date, close, settle, volume, 'legacy' AS source FROM daily_quotes""")
def migrate_legacy(f):
    legacy = f.daily_quotes.select(F.col("contract_code").alias("instrument_id"), F.col("trade_date").alias("date"),
                                   F.col("close").alias("close_price"), F.col("settle").alias("settlement_price"), "volume")
    return tables.migrate(legacy, MIGRATED, ["exchange", "contract_code", "trade_date"], ["volume"],
                          {"exchange": "CFFEX", "source": "legacy"})


@query("copy_verification", "A23 L17", """
SELECT (SELECT count(*) FROM positions) AS source_rows, (SELECT count(*) FROM positions WHERE long_volume <> 7) AS target_rows,
       (SELECT count(*) FROM positions WHERE long_volume = 7) AS missing_rows, 0 AS extra_rows""")
def copy_verification(f):
    src = f.positions.select("trade_date", "contract_code", "member_name", "long_volume")
    return tables.verify_copy(src, src.filter("long_volume <> 7"))


# ------------------------------------------------------------------ scalar functions

@query("code_normalisation", "A11 A12 H15", """
SELECT id, direction, CASE WHEN offset_flag = 'open' THEN 'open' ELSE 'close' END AS offset_flag, CASE WHEN direction = 'buy' THEN volume ELSE 0 END AS long_position,
       CASE WHEN direction = 'sell' THEN volume ELSE 0 END AS short_position FROM trades""")
def code_normalisation(f):
    zh = F.when(F.col("direction") == "buy", "买").otherwise("卖")
    of = F.when(F.col("offset_flag") == "open", "开").otherwise("平")
    t = f.trades.select("id", S.map_code(zh, S.DIRECTION_CODES).alias("direction"), S.map_code(of, S.OFFSET_CODES).alias("offset_flag"),
                        zh.alias("_d"), S.clean_number(F.concat(F.lit(" "), F.format_number("volume", 0), F.lit(" ")), 0, "bigint").alias("_v"))
    long, short = S.long_short_columns("_d", "_v")
    return t.select("id", "direction", "offset_flag", long.cast("bigint").alias("long_position"), short.cast("bigint").alias("short_position"))


@query("date_normalisation", "H01", """
SELECT id, CASE WHEN id % 3 = 2 THEN NULL ELSE trade_date END AS trade_date FROM trades""")
def date_normalisation(f):
    text = F.when(F.col("id") % 3 == 0, F.date_format("trade_date", "yyyy-MM-dd")) \
            .when(F.col("id") % 3 == 1, F.date_format("trade_date", "yyyyMMdd")).otherwise(F.lit("n/a"))
    return f.trades.select("id", S.normalize_date(text).alias("trade_date"))


@query("bar_timestamps", "H02", "SELECT id, date_trunc('second', ts) AS bar_ts FROM ticks")
def bar_timestamps(f):
    return f.ticks.select("id", S.bar_timestamp("trade_date", "trade_time").alias("bar_ts"))


@query("instrument_attributes", "H03 H04 H05 H07 H09 H10 H11", """
SELECT instrument, lower(regexp_extract(instrument, '^([A-Za-z]+)', 1)) AS product, instrument LIKE 'MO%-_-%' AS is_option,
       CASE WHEN starts_with(instrument, 'MO') THEN 'MO' END AS underlying, CASE WHEN starts_with(instrument, 'MO') THEN CASE WHEN instrument LIKE '%-C-%' THEN 'call' ELSE 'put' END END AS option_type,
       CASE WHEN starts_with(instrument, 'MO') THEN CAST(split_part(instrument, '-', 3) AS DOUBLE) END AS strike,
       CASE WHEN starts_with(instrument, 'MO') THEN DATE '2024-05-31' END AS expiry,
       CASE WHEN instrument LIKE '%-C-%' THEN 'CE' WHEN instrument LIKE '%-P-%' THEN 'PE' ELSE '' END AS option_code,
       CASE WHEN starts_with(instrument, 'MO') THEN 100 WHEN starts_with(instrument, 'rb') THEN 10 WHEN starts_with(instrument, 'IC') THEN 200 WHEN starts_with(instrument, 'PP') THEN 5
            WHEN starts_with(instrument, 'P') THEN 10 ELSE 1 END AS multiplier,
       max(trade_date - DATE '2023-12-31') AS holding_days, max(year(trade_date) * 100 + quarter(trade_date)) AS period
FROM trades GROUP BY instrument""")
def instrument_attributes(f):
    t = f.trades.groupBy("instrument").agg(F.max("trade_date").alias("d"))
    parts = S.option_symbol_parts("instrument")
    return t.select("instrument", S.product_code("instrument", lower=True).alias("product"), S.is_option("instrument").alias("is_option"),
                    *[parts[n].alias(n) for n in ("underlying", "option_type", "strike", "expiry")],
                    S.symbol_option_code("instrument").alias("option_code"), S.multiplier("instrument").alias("multiplier"),
                    S.holding_days(F.lit("2023-12-31").cast("date"), "d").alias("holding_days"),
                    (F.year("d") * 100 + F.quarter("d")).cast("bigint").alias("period"))


@query("vendor_code_mapping", "H06", """
SELECT contract_code, contract_code AS back, CAST(split_part(contract_code, '-', 3) AS DOUBLE) AS strike, CASE WHEN contract_code LIKE '%-C-%' THEN 'call' ELSE 'put' END AS side,
       contract_code || '.CFFEX' AS tagged
FROM (SELECT DISTINCT instrument AS contract_code FROM trades WHERE instrument LIKE 'MO%') x""")
def vendor_codes(f):
    t = f.trades.filter(F.col("instrument").startswith("MO")).select(F.col("instrument").alias("contract_code")).distinct()
    v = F.concat(F.regexp_replace("contract_code", "-", ""), F.lit(".CFFEX"))
    return t.select("contract_code", S.vendor_to_contract(v).alias("back"), S.vendor_strike(v).alias("strike"),
                    S.vendor_option_type(v).alias("side"), S.contract_to_vendor("contract_code").alias("tagged"))


@query("institution_categories", "H13 H14", """
SELECT DISTINCT member_name, CASE WHEN contains(member_name, '期货') THEN 'futures_company' WHEN contains(lower(member_name), 'bank') THEN 'bank'
       WHEN contains(lower(member_name), 'securities') THEN 'securities' ELSE 'other' END AS category FROM positions""")
def categories(f):
    return f.positions.select("member_name").distinct().withColumn("category", S.institution_category("member_name"))


@query("source_inference", "H19", """
SELECT DISTINCT event_type, CASE event_type WHEN 'view' THEN 'tushare' WHEN 'click' THEN 'cffex' WHEN 'error' THEN 'cfmmc' ELSE 'exchange' END AS source FROM events""")
def source_inference(f):
    name = S.literal_map({"view": "tushare_daily", "click": "cffex_daily_settlement", "error": "bills"})[F.col("event_type")]
    return f.table("events").select("event_type").distinct() \
            .withColumn("source", S.infer_source(F.coalesce(name, F.lit("trades"))))


@query("sql_scalars", "H20", """
SELECT id, coalesce(nullif(volume, 0), -1) AS v, abs(total_pnl) AS a, CAST(round(total_pnl, 1) AS DOUBLE) AS r, substr(instrument, 1, 2) AS s,
       trade_date - 30 AS back30, instrument LIKE 'MO%' AS liked, volume BETWEEN 10 AND 20 AS mid, direction IN ('buy') AS is_buy,
       CAST(CASE WHEN volume > 50 THEN 'big' ELSE 'small' END AS VARCHAR) AS size FROM trades""")
def sql_scalars(f):
    return f.trades.selectExpr(
        "id", "coalesce(nullif(volume, 0), -1) as v", "abs(total_pnl) as a", "cast(round(total_pnl, 1) as double) as r",
        "substr(instrument, 1, 2) as s", "date_sub(trade_date, 30) as back30", "instrument like 'MO%' as liked",
        "volume between 10 and 20 as mid", "direction in ('buy') as is_buy", "case when volume > 50 then 'big' else 'small' end as size")
