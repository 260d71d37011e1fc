"""Volatility and option-chain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import black_scholes as bs
from tickloom.functions import scalars as S
from tickloom.operators import joins, options as opt, query as Q
from tickloom.plans.registry import query

KEYS = ["trade_date", "underlying"]


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("rolling_hv", "E01 E21", "SELECT underlying, trade_date, hv_5, hv_10, hv_20, hv_60 FROM hv")
def rolling_hv(f):
    return opt.historical_volatility(f.underlying_daily, (5, 10, 20, 60)).select("underlying", "trade_date", "hv_5", "hv_10", "hv_20", "hv_60")


@query("rolling_hv_per_contract", "E01", """
SELECT contract_code, trade_date, CASE WHEN n > 20 THEN round(stddev_samp(r) OVER (PARTITION BY contract_code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252.0), 4) END AS hv_20
FROM (SELECT contract_code, trade_date, ln(close / lag(close) OVER (PARTITION BY contract_code ORDER BY trade_date)) AS r,
             row_number() OVER (PARTITION BY contract_code ORDER BY trade_date) AS n FROM daily_quotes) x""")
def hv_contract(f):
    return opt.historical_volatility(f.daily_quotes, (20,), ["contract_code"]).select("contract_code", "trade_date", "hv_20")


@query("asof_spot", "C02", "SELECT contract_code, trade_date, spot_price FROM spotted")
def asof_spot(f):
    return opt.with_spot(f.chain, f.underlying_daily).select("contract_code", "trade_date", "spot_price")


@query("asof_tick_for_each_order_event", "C02", """
SELECT a.id, a.ts, b.ts AS quote_ts, b.price FROM (SELECT * FROM ticks WHERE source = 'purchase') a
ASOF LEFT JOIN (SELECT * FROM ticks WHERE source = 'view') b ON b.contract_code = a.contract_code AND b.ts <= a.ts""")
def asof_ticks(f):
    left = f.ticks.filter("source = 'purchase'").select("id", "contract_code", "ts")
    right = f.ticks.filter("source = 'view'").select("contract_code", F.col("ts").alias("quote_ts"), "price")
    out = joins.asof_join(left, right, ["contract_code"], "ts", "quote_ts", ["price"], "day")
    return out.select("id", "ts", F.col("quote_ts_asof").alias("quote_ts"), "price")


@query("atm_pick", "F06", "SELECT trade_date, underlying, atm_iv, atm_strike FROM atm")
def atm(f):
    return opt.atm_pick(opt.with_spot(f.chain, f.underlying_daily), KEYS)


@query("skew_25delta", "I08", "SELECT trade_date, underlying, round(put_25, 6) AS put_25, round(call_25, 6) AS call_25, round(skew_25delta, 6) AS skew_25delta FROM skew")
def skew(f):
    return rounded(opt.skew_25delta(f.chain), 6, "put_25", "call_25", "skew_25delta")


@query("term_structure_map", "I06 H17", """
SELECT trade_date, underlying, string_agg(expiry_month || '=' || CAST(round(atm_iv, 4) AS DECIMAL(18,4)), ';' ORDER BY expiry_month) AS term_structure
FROM term_rows GROUP BY trade_date, underlying""")
def term_map(f):
    out = opt.term_structure_map(opt.with_spot(f.chain, f.underlying_daily))
    return out.select(*KEYS, _term_text("term_structure").alias("term_structure"))


def _term_text(column):
    """A term structure map as ``month=iv;...``."""
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat_ws(
        "=", e["key"], e["value"].cast("decimal(18,4)").cast("string"))), ";")


@query("term_structure_rows", "I06", """
SELECT trade_date, underlying, expire_date, round(iv, 4) AS atm_iv, round(strike, 1) AS atm_strike FROM (
  SELECT *, row_number() OVER (PARTITION BY trade_date, underlying, expire_date ORDER BY abs(strike - spot_price), strike, option_type, contract_code) AS rn
  FROM spotted WHERE iv > 0 AND spot_price IS NOT NULL) a WHERE rn = 1""")
def term_rows(f):
    out = opt.term_structure_rows(opt.with_spot(f.chain, f.underlying_daily))
    return out.select(*KEYS, "expire_date", F.round("atm_iv", 4).alias("atm_iv"), F.round("atm_strike", 1).alias("atm_strike"))


@query("iv_surface", "I07", """
SELECT trade_date, underlying, expire_date, strike, max(CASE WHEN option_type = 'C' THEN iv END) AS call_iv, max(CASE WHEN option_type = 'P' THEN iv END) AS put_iv
FROM chain GROUP BY ALL""")
def surface(f):
    return opt.iv_surface(f.chain)


@query("iv_smile_snapshot", "I05 H17", """
WITH s AS (SELECT trade_date, underlying, expire_date, strike, max(CASE WHEN option_type = 'C' THEN iv END) AS c, max(CASE WHEN option_type = 'P' THEN iv END) AS p FROM chain GROUP BY ALL),
m AS (SELECT trade_date, underlying, expire_date, (min(strike) + max(strike)) / 2 AS mid FROM s GROUP BY ALL),
a AS (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY x.trade_date, x.underlying, x.expire_date ORDER BY abs(x.strike - m.mid), x.strike, x.option_type, x.contract_code) AS rn
      FROM chain x JOIN m ON m.trade_date = x.trade_date AND m.underlying = x.underlying AND m.expire_date = x.expire_date WHERE x.iv > 0) y WHERE rn = 1)
SELECT s.trade_date, s.underlying AS variety, s.expire_date AS expiry_date, string_agg(CAST(CAST(s.strike AS DECIMAL(18,2)) AS VARCHAR), ',' ORDER BY s.strike) AS strikes,
       string_agg(coalesce(CAST(CAST(s.c AS DECIMAL(18,4)) AS VARCHAR), 'x'), ',' ORDER BY s.strike) AS call_iv,
       string_agg(coalesce(CAST(CAST(s.p AS DECIMAL(18,4)) AS VARCHAR), 'x'), ',' ORDER BY s.strike) AS put_iv, round(max(a.iv), 4) AS atm_iv,
       round((CAST(sum(CAST(s.p AS DECIMAL(28,12))) AS DOUBLE) / nullif(count(s.p), 0)) / (CAST(sum(CAST(s.c AS DECIMAL(28,12))) AS DOUBLE) / nullif(count(s.c), 0)), 4) AS skew_ratio_all,
       round((CAST(sum(CASE WHEN s.strike < m.mid THEN CAST(s.p AS DECIMAL(28,12)) END) AS DOUBLE) / nullif(count(CASE WHEN s.strike < m.mid THEN s.p END), 0))
           / (CAST(sum(CASE WHEN s.strike > m.mid THEN CAST(s.c AS DECIMAL(28,12)) END) AS DOUBLE) / nullif(count(CASE WHEN s.strike > m.mid THEN s.c END), 0)), 4) AS skew_ratio_otm
FROM s JOIN m ON m.trade_date = s.trade_date AND m.underlying = s.underlying AND m.expire_date = s.expire_date
JOIN a ON a.trade_date = s.trade_date AND a.underlying = s.underlying AND a.expire_date = s.expire_date
GROUP BY s.trade_date, s.underlying, s.expire_date""")
def smile(f):
    def text(c):
        return F.array_join(F.transform(c, lambda v: F.coalesce(v.cast("decimal(18,4)").cast("string"), F.lit("x"))), ",")

    out = opt.smile_snapshot(f.chain)
    return out.select("trade_date", "variety", "expiry_date", F.array_join(F.transform("strikes", lambda v: v.cast("decimal(18,2)").cast("string")), ",").alias("strikes"), text("call_iv").alias("call_iv"),
                      text("put_iv").alias("put_iv"), "atm_iv", "skew_ratio_all", "skew_ratio_otm")


@query("put_call_ratio", "D05", "SELECT trade_date, underlying, put_volume, call_volume, put_oi, call_oi, pcr_volume, pcr_oi FROM pcr")
def pcr(f):
    return opt.put_call_ratio(f.chain)


@query("average_iv", "D06", """
SELECT trade_date, underlying, round(CAST(sum(CAST(iv AS DECIMAL(28,12))) AS DOUBLE) / count(iv), 8) AS avg_iv, count(iv) AS contracts FROM chain WHERE iv > 0 GROUP BY ALL""")
def avg_iv(f):
    return rounded(opt.average_iv(f.chain), 8, "avg_iv")


@query("iv_benchmark", "I09 E02 H16 B25", """
SELECT b.*, t.term_structure FROM benchmark_rows b LEFT JOIN (
  SELECT trade_date, underlying, string_agg(expiry_month || '=' || CAST(round(atm_iv, 4) AS DECIMAL(18,4)), ';' ORDER BY expiry_month) AS term_structure
  FROM term_rows GROUP BY trade_date, underlying) t ON t.trade_date = b.trade_date AND t.underlying = b.variety""")
def benchmark(f):
    return opt.iv_benchmark(f.chain, f.underlying_daily).withColumn("term_structure", _term_text("term_structure"))


@query("iv_hv_spread_series", "B25", "SELECT trade_date, variety, atm_iv, hv_20, hv_60, iv_hv_spread FROM benchmark_rows WHERE iv_hv_spread IS NOT NULL")
def spread(f):
    return opt.iv_hv_spread(opt.iv_benchmark(f.chain, f.underlying_daily))


@query("iv_percentile_trailing", "E02", "SELECT trade_date, variety, round(pct, 4) AS iv_percentile FROM atm_pct")
def percentile(f):
    rows = opt.atm_pick(opt.with_spot(f.chain, f.underlying_daily), KEYS).withColumnRenamed("underlying", "variety")
    return rounded(opt.rolling_percentile(rows, "atm_iv"), 4, "iv_percentile").select("trade_date", "variety", "iv_percentile")


@query("iv_percentile_latest", "E03", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY underlying ORDER BY trade_date DESC) AS rn FROM atm), c AS (SELECT underlying, trade_date, atm_iv FROM r WHERE rn = 1)
SELECT c.underlying AS variety, c.trade_date, c.atm_iv AS current_iv,
       round(count(CASE WHEN r.rn <= 30 AND r.atm_iv < c.atm_iv THEN 1 END) / CAST(count(CASE WHEN r.rn <= 30 THEN 1 END) AS DOUBLE) * 100, 1) AS percentile_30d,
       round(count(CASE WHEN r.rn <= 90 AND r.atm_iv < c.atm_iv THEN 1 END) / CAST(count(CASE WHEN r.rn <= 90 THEN 1 END) AS DOUBLE) * 100, 1) AS percentile_90d,
       round(count(CASE WHEN r.rn <= 252 AND r.atm_iv < c.atm_iv THEN 1 END) / CAST(count(CASE WHEN r.rn <= 252 THEN 1 END) AS DOUBLE) * 100, 1) AS percentile_252d
FROM c JOIN r ON r.underlying = c.underlying GROUP BY ALL""")
def latest_pct(f):
    rows = opt.atm_pick(opt.with_spot(f.chain, f.underlying_daily), KEYS).withColumnRenamed("underlying", "variety")
    return opt.latest_percentiles(rows)


@query("iv_return_correlation", "E04 C09", """
WITH iv AS (SELECT underlying, trade_date, CAST(volume AS DOUBLE) AS x, close FROM underlying_daily),
ch AS (SELECT underlying, trade_date, (x - lag(x) OVER w) / lag(x) OVER w * 100 AS dx, ln(close / lag(close) OVER w) * 100 AS dy FROM iv WINDOW w AS (PARTITION BY underlying ORDER BY trade_date)),
ok AS (SELECT * FROM ch WHERE dx IS NOT NULL AND dy IS NOT NULL)
SELECT underlying AS variety, trade_date, round(c, 4) AS correlation FROM (
  SELECT underlying, trade_date, corr(dx, dy) OVER (PARTITION BY underlying ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS c,
         row_number() OVER (PARTITION BY underlying ORDER BY trade_date) AS n FROM ok) z WHERE n >= 60""")
def correlation(f):
    u = f.underlying_daily.withColumnRenamed("underlying", "variety")
    iv = u.select("variety", "trade_date", F.col("volume").cast("double").alias("atm_iv"))
    return opt.iv_return_correlation(iv, u, 60).select("variety", "trade_date", "correlation")


# ------------------------------------------------------------------ pricing

def _cdf(x: str) -> str:
    """Normal distribution function as SQL (Hart rational form)."""
    def poly(cs):
        out = f"{cs[0]!r}"
        for c in cs[1:]:
            out = f"({out} * abs({x}) + {c!r})"
        return out.replace("e-", "e-")

    num = poly([f"{c:.17e}" for c in bs.HART_NUMERATOR]).replace("'", "")
    den = poly([f"{c:.17e}" for c in bs.HART_DENOMINATOR]).replace("'", "")
    low = f"(CASE WHEN abs({x}) < 7.07106781186547e0 THEN exp(-{x} * {x} / 2e0) * {num} / {den} ELSE 0e0 END)"
    return f"(CASE WHEN {x} > 0 THEN 1e0 - {low} ELSE {low} END)"


PRICED_SQL = """
SELECT *, d1 - iv * st AS d2 FROM (
  SELECT *, sqrt(t) AS st, strike * exp(-2e-2 * t) AS kd, (ln(spot_price / strike) + (2e-2 + iv * iv * 5e-1) * t) / (iv * sqrt(t)) AS d1
  FROM (SELECT *, (expire_date - trade_date) / 365e0 AS t FROM spotted WHERE spot_price IS NOT NULL) a) b"""


@query("chain_prices", "I01", f"""
SELECT trade_date, contract_code, round(CASE WHEN option_type = 'C' THEN spot_price * {_cdf('d1')} - kd * {_cdf('d2')}
       ELSE kd * {_cdf('(-d2)')} - spot_price * {_cdf('(-d1)')} END, 6) AS model_price FROM ({PRICED_SQL}) p""")
def chain_prices(f):
    rows = opt.with_spot(f.chain, f.underlying_daily).filter("spot_price is not null")
    return opt.price_chain(rows).select("trade_date", "contract_code", F.round("model_price", 6).alias("model_price"))


@query("chain_greeks", "I02 H12", f"""
SELECT trade_date, contract_code, round({_cdf('d1')} - CASE WHEN option_type = 'C' THEN 0 ELSE 1 END, 6) AS delta,
       round(exp(-d1 * d1 / 2e0) / sqrt(2e0 * pi()) / (spot_price * iv * st), 8) AS gamma, round(spot_price * exp(-d1 * d1 / 2e0) / sqrt(2e0 * pi()) * st, 5) AS vega,
       round((-(spot_price * exp(-d1 * d1 / 2e0) / sqrt(2e0 * pi()) * iv) / (2e0 * st) + 2e-2 * kd * CASE WHEN option_type = 'C' THEN -{_cdf('d2')} ELSE {_cdf('(-d2)')} END) / 365e0, 6) AS theta,
       round(t * kd * CASE WHEN option_type = 'C' THEN {_cdf('d2')} ELSE -{_cdf('(-d2)')} END, 5) AS rho
FROM ({PRICED_SQL}) p""")
def chain_greeks(f):
    rows = opt.with_spot(f.chain, f.underlying_daily).filter("spot_price is not null").drop("delta")
    g = opt.chain_greeks(rows)
    return g.select("trade_date", "contract_code", F.round("delta", 6).alias("delta"), F.round("gamma", 8).alias("gamma"),
                    F.round("vega", 5).alias("vega"), F.round("theta", 6).alias("theta"), F.round("rho", 5).alias("rho"))


@query("implied_vol_round_trip", "I03", "SELECT trade_date, contract_code, round(iv, 4) AS iv FROM spotted WHERE spot_price IS NOT NULL")
def iv_round_trip(f):
    rows = opt.price_chain(opt.with_spot(f.chain, f.underlying_daily).filter("spot_price is not null"))
    solved = bs.implied_vol("model_price", "spot_price", "strike", "years", opt.RISK_FREE_RATE, "option_type")
    return rows.select("trade_date", "contract_code", F.round(solved, 4).alias("iv"))


def _minutes_and_contracts(f):
    """Option minute bars: each tick becomes an option price on its contract."""
    uid = F.regexp_extract("contract_code", r"(\d+)", 1).cast("int")
    contracts = f.ticks.select("contract_code").distinct().select(
        "contract_code", F.lit("MO").alias("underlying"), F.when(uid % 2 == 0, "C").otherwise("P").alias("option_type"),
        (F.lit(900.0) + uid % 200).alias("strike"), F.add_months(F.lit("2024-02-16").cast("date"), uid % 4).alias("expire_date"))
    spots = f.ticks.groupBy("trade_date").agg((F.lit(950.0) + F.sum("volume") % 100).cast("double").alias("close")) \
        .withColumn("underlying", F.lit("MO"))
    return f.ticks, contracts, spots


@query("daily_iv_pipeline", "I04 C05 C01")
def daily_iv(f):
    minutes, contracts, spots = _minutes_and_contracts(f)
    return opt.daily_iv(minutes.filter("close is not null"), spots, contracts)


@query("daily_iv_repriced", "I04 C05 C02", f"""
WITH q AS (SELECT contract_code, trade_date, arg_max(close, trade_time) AS option_price FROM ticks WHERE close IS NOT NULL GROUP BY ALL),
s AS (SELECT trade_date, CAST(950 + sum(volume) % 100 AS DOUBLE) AS spot_price FROM ticks GROUP BY trade_date),
n AS (SELECT *, CAST(substr(contract_code, 2) AS INTEGER) AS uid FROM q),
c AS (SELECT *, CASE WHEN uid % 2 = 0 THEN 'C' ELSE 'P' END AS option_type, 900e0 + uid % 200 AS strike,
             CAST(DATE '2024-02-16' + to_months(uid % 4) AS DATE) AS expire_date FROM n),
t AS (SELECT c.*, s.spot_price, (expire_date - trade_date) / 365e0 AS t, strike * exp(-2e-2 * (expire_date - trade_date) / 365e0) AS kd
      FROM c JOIN s USING (trade_date) WHERE expire_date > trade_date AND option_price > 0),
v AS (SELECT t.*, x.iv, (ln(spot_price / strike) + (2e-2 + x.iv * x.iv * 5e-1) * t.t) / (x.iv * sqrt(t.t)) AS d1 FROM t CROSS JOIN (VALUES (1e-3), (5e0), (1e2)) x(iv)),
w AS (SELECT *, d1 - iv * sqrt(t) AS d2 FROM v),
p AS (SELECT *, CASE WHEN option_type = 'C' THEN spot_price * {_cdf('d1')} - kd * {_cdf('d2')} ELSE kd * {_cdf('(-d2)')} - spot_price * {_cdf('(-d1)')} END AS price FROM w),
r AS (SELECT trade_date, contract_code, option_type, strike, expire_date, option_price, spot_price, kd,
             max(price) FILTER (iv = 1e-3) AS least, max(price) FILTER (iv = 5e0) AS most, max(price) FILTER (iv = 1e2) AS bound FROM p GROUP BY ALL)
SELECT trade_date, contract_code, option_type, strike, expire_date, round(option_price, 6) AS option_price, spot_price,
       round(least(greatest(option_price, least), most), 4) AS repriced
FROM r WHERE option_price >= greatest(CASE WHEN option_type = 'C' THEN spot_price - kd ELSE kd - spot_price END, 0) - 1e-2
  AND (option_price <= most OR option_price > bound)""")
def daily_iv_repriced(f):
    """The solved volatilities, put back into the pricing formula, give the option prices again."""
    minutes, contracts, spots = _minutes_and_contracts(f)
    solved = opt.daily_iv(minutes.filter("close is not null"), spots, contracts).withColumnRenamed("underlying_price", "spot_price")
    return opt.price_chain(solved).select("trade_date", "contract_code", "option_type", "strike", "expire_date", F.round("option_price", 6).alias("option_price"),
                                          "spot_price", F.round("model_price", 4).alias("repriced"))


@query("option_greeks_table", "I10 B20")
def greeks_table(f):
    minutes, contracts, spots = _minutes_and_contracts(f)
    return opt.greeks_daily(opt.daily_iv(minutes.filter("close is not null"), spots, contracts))


@query("last_bar_close", "C05", """
SELECT contract_code, trade_date, close AS option_price FROM (
  SELECT *, row_number() OVER (PARTITION BY contract_code, trade_date ORDER BY trade_time DESC) AS rn FROM ticks WHERE close IS NOT NULL) x WHERE rn = 1""")
def last_bar(f):
    return opt.last_bar_close(f.ticks.filter("close is not null"))


@query("option_features", "E21 B14", """
SELECT c.trade_date, c.contract_code, round(CASE WHEN len(past) >= 20 THEN len(list_filter(past, lambda x: x < c.iv)) / CAST(len(past) AS DOUBLE) * 100 END, 4) AS iv_percentile,
       round(CASE WHEN hi > lo THEN (c.iv - lo) / (hi - lo) END, 6) AS iv_rank, h.hv_5, h.hv_10, h.hv_20,
       round(c.iv - h.hv_20, 4) AS iv_hv_spread_20, round(CAST(c.volume AS DOUBLE) / nullif(c.open_interest, 0), 6) AS volume_oi_ratio
FROM (SELECT *, min(iv) OVER w AS lo, max(iv) OVER w AS hi, list(iv) OVER w AS past FROM chain WINDOW w AS (PARTITION BY contract_code ORDER BY trade_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) c
ASOF LEFT JOIN hv h ON h.underlying = c.underlying AND h.trade_date <= c.trade_date""")
def features(f):
    out = opt.option_features(f.chain, f.underlying_daily)
    return rounded(rounded(out, 6, "iv_rank", "volume_oi_ratio"), 4, "iv_percentile").select(
        "trade_date", "contract_code", "iv_percentile", "iv_rank", "hv_5", "hv_10", "hv_20", "iv_hv_spread_20", "volume_oi_ratio")


@query("iv_snapshot_by_underlying", "B15", """
SELECT trade_date, contract_code, strike, iv FROM chain WHERE starts_with(underlying, 'MO') AND trade_date = DATE '1999-06-01'""")
def iv_snapshot(f):
    return Q.select_where(f.chain, prefix={"underlying": "MO"}, where=[F.col("trade_date") == F.lit("1999-06-01").cast("date")],
                          order=["iv"]).select("trade_date", "contract_code", "strike", "iv")


@query("regime_bands", "H16", """
SELECT CASE WHEN pct IS NULL THEN 'normal' WHEN pct < 10 THEN 'very_low' WHEN pct < 30 THEN 'low' WHEN pct < 70 THEN 'normal' WHEN pct < 90 THEN 'high' ELSE 'very_high' END AS regime,
       CASE WHEN pct >= 95 THEN 'excellent' WHEN pct >= 85 THEN 'good' WHEN pct >= 70 THEN 'fair' WHEN pct >= 50 THEN 'poor' ELSE 'critical' END AS level, count(*) AS n
FROM (SELECT o_totalprice - floor(o_totalprice / 100) * 100 AS pct FROM orders) x GROUP BY ALL""")
def regime_bands(f):
    p = F.col("o_totalprice") - F.floor(F.col("o_totalprice") / 100) * 100
    return f.table("orders").select(p.alias("pct")).groupBy(S.iv_regime("pct").alias("regime"), S.quality_level("pct").alias("level")) \
            .agg(F.count(F.lit(1)).alias("n"))
