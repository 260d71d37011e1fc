"""Trading-calendar queries over order dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import calendar as cal
from tickloom.operators import joins
from tickloom.plans.registry import query


def _orders(f):
    return f.table("orders").select(F.to_date("o_orderdate").alias("trade_date"), "o_orderkey")


@query("calendar_rows", "J01", "SELECT trade_date, exchange_code, product_code, is_holiday, holiday_name FROM calendar")
def calendar_rows(f):
    return f.calendar


@query("product_calendar", "J02", """
SELECT c.trade_date, p.exchange AS exchange_code, p.product_code, CASE WHEN c.trade_date < p.listing_date OR c.is_holiday = 1 THEN 1 ELSE 0 END AS is_holiday,
       CASE WHEN c.trade_date < p.listing_date THEN '未上市' ELSE coalesce(c.holiday_name, '') END AS holiday_name
FROM calendar c, (SELECT product_code, min(exchange) AS exchange, min(listing_date) AS listing_date FROM contracts GROUP BY product_code) p""")
def product_calendar(f):
    p = f.contracts.groupBy("product_code").agg(F.min("exchange").alias("exchange_code"), F.min("listing_date").alias("listing_date"))
    return cal.product_calendar(f.calendar, p)


@query("resolved_calendar", "C13 J04 J09", "SELECT trade_date, is_trading, td_index, next_td, prev_td FROM resolved")
def resolved_calendar(f):
    return f.resolved.select("trade_date", "is_trading", "td_index", "next_td", "prev_td")


@query("trading_days_in_range", "J03", "SELECT trade_date FROM resolved WHERE is_trading AND trade_date BETWEEN DATE '1996-03-01' AND DATE '1999-08-31'")
def trading_days(f):
    return cal.trading_days(f.resolved, "1996-03-01", "1999-08-31").select("trade_date")


@query("orders_plus_three_trading_days", "J05", """
SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS trade_date, t.trade_date AS target_date
FROM orders o JOIN resolved r ON r.trade_date = CAST(o.o_orderdate AS DATE)
LEFT JOIN (SELECT * FROM resolved WHERE is_trading) t ON t.td_index = r.td_index + 3""")
def plus_three(f):
    return cal.add_trading_days(_orders(f), f.resolved, 3)


@query("orders_minus_two_trading_days", "J05", """
SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS trade_date, t.trade_date AS target_date
FROM orders o JOIN resolved r ON r.trade_date = CAST(o.o_orderdate AS DATE)
LEFT JOIN (SELECT * FROM resolved WHERE is_trading) t ON t.td_index = r.td_index - 2 + CASE WHEN r.is_trading THEN 0 ELSE 1 END""")
def minus_two(f):
    return cal.add_trading_days(_orders(f), f.resolved, -2)


@query("trading_days_between", "J06 J05", """
SELECT x.account, x.a AS start_date, x.b AS end_date, CAST(sum(CASE WHEN r.is_trading THEN 1 ELSE 0 END) AS BIGINT) AS trading_days,
       CASE WHEN x.a = x.b THEN 0 ELSE CAST(sum(CASE WHEN r.is_trading THEN 1 ELSE 0 END) AS BIGINT) - 1 END AS "offset"
FROM (SELECT o_custkey AS account, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY o_custkey) x
JOIN resolved r ON r.trade_date BETWEEN x.a AND x.b GROUP BY x.account, x.a, x.b""")
def days_between(f):
    spans = f.table("orders").groupBy(F.col("o_custkey").alias("account")).agg(
        F.min(F.to_date("o_orderdate")).alias("start_date"), F.max(F.to_date("o_orderdate")).alias("end_date"))
    out = cal.count_trading_days(spans, f.resolved, "start_date", "end_date")
    return cal.trading_day_offset(out, f.resolved, "start_date", "end_date")


@query("orders_snapped", "J07 F09", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS trade_date, r.next_td AS forward, r.prev_td AS backward,
       CASE WHEN r.next_td IS NULL THEN r.prev_td WHEN r.prev_td IS NULL THEN r.next_td
            WHEN r.trade_date - r.prev_td <= r.next_td - r.trade_date THEN r.prev_td ELSE r.next_td END AS nearest
FROM orders JOIN resolved r ON r.trade_date = CAST(o_orderdate AS DATE)""")
def snapped(f):
    out = cal.snap(_orders(f), f.resolved, "forward", out="forward")
    out = cal.snap(out, f.resolved, "backward", out="backward")
    return cal.snap(out, f.resolved, "nearest", out="nearest")


@query("latest_trading_day", "F09", """
SELECT o_orderkey, r.prev_td AS latest_td FROM orders JOIN resolved r ON r.trade_date = CAST(o_orderdate AS DATE)""")
def latest_td(f):
    return cal.latest_trading_day(_orders(f), f.resolved).select("o_orderkey", "latest_td")


@query("month_edges", "J08", """
SELECT CAST(year(trade_date) AS BIGINT) AS year, CAST(month(trade_date) AS BIGINT) AS month, min(trade_date) AS first_day, max(trade_date) AS last_day
FROM resolved WHERE is_trading GROUP BY ALL""")
def month_edges(f):
    return cal.month_edges(f.resolved).selectExpr("cast(year as bigint) year", "cast(month as bigint) month", "first_day", "last_day")


@query("calendar_stats", "D31", """
SELECT product_code, CAST(year(trade_date) AS BIGINT) AS year, min(trade_date) AS first_date, max(trade_date) AS last_date, count(*) AS total_days,
       count(CASE WHEN is_holiday = 0 THEN 1 END) AS trading_days, count(CASE WHEN is_holiday = 1 THEN 1 END) AS holidays
FROM calendar GROUP BY ALL""")
def calendar_stats(f):
    return cal.calendar_stats(f.calendar).withColumn("year", F.col("year").cast("bigint"))


@query("year_view", "J11", """
SELECT CAST(year(trade_date) AS BIGINT) AS year, CAST(month(trade_date) AS BIGINT) AS month,
       string_agg(day(trade_date) || ':' || is_holiday, ',' ORDER BY trade_date) AS days, CAST(sum(1 - is_holiday) AS BIGINT) AS trading_days
FROM calendar GROUP BY ALL""")
def year_view(f):
    text = F.array_join(F.transform("days", lambda d: F.concat_ws(":", d["day"].cast("string"), d["is_holiday"].cast("string"))), ",")
    return cal.year_view(f.calendar).select(F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month"),
                                            text.alias("days"), "trading_days")


@query("override_upsert", "J09", """
SELECT exchange_code, trade_date, CASE WHEN exchange_code = 'ALL' AND override_type = 'holiday' THEN 'workday' ELSE override_type END AS override_type FROM overrides""")
def override_upsert(f):
    changes = f.overrides.filter("exchange_code = 'ALL' and override_type = 'holiday'").withColumn("override_type", F.lit("workday"))
    return cal.upsert_overrides(f.overrides, changes).select("exchange_code", "trade_date", "override_type")


@query("ticks_in_sessions", "C14 J10", """
SELECT id, trade_time FROM ticks WHERE substr(trade_time, 1, 5) BETWEEN '09:30' AND '11:30' OR substr(trade_time, 1, 5) BETWEEN '13:00' AND '15:00'
 OR substr(trade_time, 1, 5) >= '21:00' OR substr(trade_time, 1, 5) <= '02:30'""")
def ticks_in_sessions(f):
    t = f.spark.range(1).selectExpr(
        "'T1' as template_id", "array(named_struct('start','09:30','end','11:30'), named_struct('start','13:00','end','15:00')) as normal_schedule",
        "array(named_struct('start','21:00','end','02:30')) as night_schedule")
    rows = f.ticks.select("id", "trade_time").withColumn("template_id", F.lit("T1"))
    return cal.within_sessions(rows, cal.template_sessions(t)).select("id", "trade_time")


@query("missing_trading_dates", "C08 G03", """
SELECT c.contract_code, r.trade_date FROM contracts c JOIN resolved r ON r.is_trading AND r.trade_date BETWEEN c.listing_date AND c.last_trade_date
WHERE (c.contract_code, r.trade_date) NOT IN (SELECT (contract_code, trade_date) FROM daily_quotes)""")
def missing_dates(f):
    from tickloom.operators import quality
    series = f.contracts.select("contract_code", F.col("listing_date").alias("earliest_date"), F.col("last_trade_date").alias("latest_date"))
    return quality.missing_dates(series, f.daily_quotes, f.resolved, ["contract_code"]).select("contract_code", "trade_date")


@query("common_dates", "C09 G02", """
SELECT DISTINCT trade_date FROM daily_quotes WHERE trade_date IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def common_dates(f):
    a = f.daily_quotes.select("trade_date").distinct()
    return joins.common_keys(a, _orders(f), ["trade_date"])


@query("date_union_status", "G01", """
SELECT coalesce(a.trade_date, b.trade_date) AS trade_date, CASE WHEN a.trade_date IS NULL THEN 'right_only' WHEN b.trade_date IS NULL THEN 'left_only'
       WHEN abs(a.n - b.n) > 5 THEN 'mismatch' ELSE 'match' END AS status
FROM (SELECT CAST(l_shipdate AS DATE) AS trade_date, count(*) AS n FROM lineitem GROUP BY 1) a
FULL JOIN (SELECT CAST(o_orderdate AS DATE) AS trade_date, count(*) AS n FROM orders GROUP BY 1) b ON a.trade_date = b.trade_date""")
def date_union(f):
    a = f.table("lineitem").groupBy(F.to_date("l_shipdate").alias("trade_date")).agg(F.count(F.lit(1)).alias("n"))
    b = _orders(f).groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    return joins.compare_rows(a, b, ["trade_date"], ["n"], 5).select("trade_date", "status")
