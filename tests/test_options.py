import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import black_scholes as bs
from tickloom.operators import options as opt

FIXED = [
    # S, K, days, sigma, call, put, delta call, delta put, gamma, vega, theta call, theta put, rho call, rho put
    (6000.0, 6000.0, 30, 0.25, 176.354730, 166.499819, 0.523433, -0.476567, 0.00092609, 685.0550, -3.016820, -2.688593, 243.6364, -248.7043),
    (6000.0, 6500.0, 60, 0.30, 121.455234, 600.120461, 0.284263, -0.715737, 0.00046462, 824.8674, -2.148970, -1.793975, 260.4040, -804.5821),
]


def chain(spark):
    rows = [(s, k, d / 365.0, v, t) for s, k, d, v, *_ in FIXED for t in ("C", "put")]
    return spark.createDataFrame(rows, "spot_price double, strike double, years double, iv double, option_type string")


def test_prices_and_greeks(spark):
    out = bs.with_greeks(bs.with_price(chain(spark))).collect()
    for i, (_, _, _, _, c, p, dc, dp, g, ve, tc, tp, rc, rp) in enumerate(FIXED):
        call, put = out[2 * i], out[2 * i + 1]
        assert call.model_price == pytest.approx(c, abs=1e-5) and put.model_price == pytest.approx(p, abs=1e-5)
        assert (call.delta, put.delta) == (pytest.approx(dc, abs=1e-6), pytest.approx(dp, abs=1e-6))
        assert (call.gamma, call.vega) == (pytest.approx(g, abs=1e-8), pytest.approx(ve, abs=1e-3))
        assert (call.theta, put.theta) == (pytest.approx(tc, abs=1e-5), pytest.approx(tp, abs=1e-5))
        assert (call.rho, put.rho) == (pytest.approx(rc, abs=1e-3), pytest.approx(rp, abs=1e-3))


def test_expired_options_are_intrinsic_without_greeks(spark):
    df = spark.createDataFrame([(110.0, 100.0, 0.0, 0.2, "C"), (110.0, 100.0, 0.5, 0.0, "P")],
                               "spot_price double, strike double, years double, iv double, option_type string")
    a, b = bs.with_greeks(bs.with_price(df)).collect()
    assert (a.model_price, b.model_price, a.delta, b.vega) == (10.0, 0.0, None, None)


def test_norm_cdf_against_erf(spark):
    xs = [x / 10 for x in range(-80, 81)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", bs.norm_cdf(F.col("x")).alias("n"))
    assert max(abs(r.n - 0.5 * math.erfc(-r.x / math.sqrt(2))) for r in df.collect()) < 1e-14


def test_iv_round_trip_and_null_cases(spark):
    priced = bs.with_price(chain(spark)).withColumn("v", bs.implied_vol("model_price", "spot_price", "strike", "years", 0.02, "option_type"))
    assert all(r.v == pytest.approx(r.iv, abs=1e-6) for r in priced.collect())
    bad = spark.createDataFrame([(10.0, 0.0), (0.0, 0.5), (5.0, 0.5), (None, 0.5)], "p double, t double") \
        .select(bs.implied_vol("p", F.lit(120.0), F.lit(100.0), "t", 0.02, F.lit("C")).alias("v"))
    assert [r.v for r in bad.collect()] == [None] * 4


def test_iv_solver_reprices_random_chains():
    rnd = np.random.default_rng(7)
    n = 4000
    s, k = rnd.uniform(50, 150, n), rnd.uniform(50, 150, n)
    t, v = rnd.uniform(0.02, 2, n), rnd.uniform(0.05, 1.5, n)
    r, call = np.full(n, 0.02), rnd.random(n) < 0.5
    px, _ = bs._np_price_vega(s, k, t, r, v, call)
    got = bs.solve_implied_vol(px, s, k, t, r, call)
    back, _ = bs._np_price_vega(s, k, t, r, np.nan_to_num(got, nan=0.3), call)
    usable = px > 1e-6
    assert np.all(np.abs(back - px)[usable] < 1e-6)


def test_hv_window_5(spark):
    from datetime import date, timedelta
    rows = [("X", date(2024, 1, 1) + timedelta(days=i), float(c)) for i, c in enumerate([100, 101, 100, 102, 101, 103])]
    out = opt.historical_volatility(spark.createDataFrame(rows, "underlying string, trade_date date, close double"), (5,)).collect()
    assert [r.hv_5 for r in out] == [None] * 5 + [0.2377]


def test_atm_and_skew(spark):
    atm = spark.createDataFrame([("d", "MO", f"c{k}", "C", float(k), iv, 5800.0) for k, iv in ((5700, .2), (5790, .21), (5900, .22))],
                                "trade_date string, underlying string, contract_code string, option_type string, strike double, iv double, spot_price double")
    assert opt.atm_pick(atm, ["trade_date", "underlying"]).collect()[0].atm_strike == 5790
    legs = [("P", -0.30, 0.28), ("P", -0.20, 0.32), ("C", 0.20, 0.26), ("C", 0.30, 0.24)]
    ch = spark.createDataFrame([("d", "MO", t, d, iv) for t, d, iv in legs], "trade_date string, underlying string, option_type string, delta double, iv double")
    [r] = opt.skew_25delta(ch).collect()
    assert (round(r.put_25, 6), round(r.call_25, 6), round(r.skew_25delta, 6)) == (0.30, 0.25, 0.05)
    [one] = opt.skew_25delta(ch.filter("delta in (-0.3, 0.2, 0.3)")).collect()
    assert one.put_25 is None and one.skew_25delta is None


def test_percentile_needs_twenty_values(spark):
    rows = [("MO", i, float(i)) for i in range(30)]
    out = opt.rolling_percentile(spark.createDataFrame(rows, "variety string, trade_date int, atm_iv double"), "atm_iv").collect()
    got = [r.iv_percentile for r in sorted(out, key=lambda r: r.trade_date)]
    assert got[18] is None and round(got[29], 2) == 96.67


def test_regime_bands(spark):
    from tickloom.functions.scalars import iv_regime
    df = spark.createDataFrame([(x,) for x in (9.9, 10.0, 30.0, 70.0, 90.0, None)], "p double")
    assert [r.r for r in df.select(iv_regime("p").alias("r")).collect()] == ["very_low", "low", "normal", "high", "very_high", "normal"]


def test_daily_iv_pipeline_recovers_the_volatility(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(40):
        k, days, iv, side = 900 + 5 * i, 20 + i, rnd.uniform(0.1, 0.6), rnd.choice("CP")
        rows.append((f"c{i}", "MO", side, float(k), days, iv))
    c = spark.createDataFrame(rows, "contract_code string, underlying string, option_type string, strike double, days int, true_iv double") \
        .withColumn("trade_date", F.lit("2024-03-01").cast("date")).withColumn("expire_date", F.date_add("trade_date", F.col("days")))
    priced = bs.with_price(c.withColumn("years", F.col("days") / 365.0).withColumn("spot_price", F.lit(1000.0)), sigma="true_iv")
    minutes = priced.filter("model_price > 0.05").select("contract_code", "trade_date", F.lit("15:00:00").alias("trade_time"), F.col("model_price").alias("close"))
    minutes = minutes.unionByName(minutes.withColumn("trade_time", F.lit("09:31:00")).withColumn("close", F.lit(1.0)))
    spots = spark.createDataFrame([("MO", "2024-02-27", 1000.0)], "underlying string, d string, close double").select(
        "underlying", F.col("d").cast("date").alias("trade_date"), "close")
    out = opt.daily_iv(minutes, spots, c.select("contract_code", "underlying", "option_type", "strike", "expire_date"))
    got = {r.contract_code: r for r in out.collect()}
    truth = {r[0]: r[5] for r in rows}
    assert len(got) > 30
    assert all(r.iv == pytest.approx(truth[n], abs=1e-4) and r.delta is not None for n, r in got.items())
    assert opt.greeks_daily(out).count() == len(got)
