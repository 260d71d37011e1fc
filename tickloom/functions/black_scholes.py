"""Option pricing as Column expressions, plus one Arrow solver for implied volatility.

Spark has no ``erf``; the normal distribution function uses the Hart rational
approximation in the double-precision form published by G. West, "Better
approximations to cumulative normal functions" (Wilmott, 2005).
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code that runs in Python workers travels with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Published coefficients, highest power first.
HART_NUMERATOR = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165,
                  33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
HART_DENOMINATOR = [8.83883476483184e-02, 1.75566716318264, 16.064177579207,
                    86.7807322029461, 296.564248779674, 637.333633378831,
                    793.826512519948, 440.413735824752]
HART_SPLIT = 7.07106781186547
SQRT_2PI = 2.506628274631
INV_SQRT_2PI = 1.0 / math.sqrt(2.0 * math.pi)


def _horner(x: Column, coefficients: list[float]) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + F.lit(c)
    return acc


def lower_tail(x: Column) -> Column:
    """Probability beyond |x| on one side."""
    a = F.abs(x)
    e = F.exp(-a * a / F.lit(2.0))
    core = e * _horner(a, HART_NUMERATOR) / _horner(a, HART_DENOMINATOR)
    tail = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + F.lit(k) / tail
    return F.when(a > 37, F.lit(0.0)).when(a < HART_SPLIT, core).otherwise(e / tail / F.lit(SQRT_2PI))


def norm_cdf(x: Column) -> Column:
    return F.when(x > 0, F.lit(1.0) - lower_tail(x)).otherwise(lower_tail(x))


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / F.lit(2.0)) * F.lit(INV_SQRT_2PI)


def is_call(option_type) -> Column:
    """Normalised call test: C / call / CE in any case."""
    t = F.col(option_type) if isinstance(option_type, str) else option_type
    return F.upper(F.substring(t, 1, 1)) == "C"


def _cols(*names):
    return [F.col(n) if isinstance(n, str) else (n if isinstance(n, Column) else F.lit(float(n)))
            for n in names]


TERMS = ["_st", "_kd", "_d1", "_d2", "_l1", "_l2", "_n1", "_n2", "_m1", "_m2"]


def _with_terms(df: DataFrame, spot, strike, years, rate, sigma) -> DataFrame:
    """Shared Black-Scholes terms as columns, one small projection per step.

    Each step refers to finished columns, which keeps the generated code far below the method size
    limit; a single nested expression would repeat d1 dozens of times and fall out of codegen.
    """
    s, k, t, r, v = _cols(spot, strike, years, rate, sigma)
    ok = (t > 0) & (v > 0) & (s > 0) & (k > 0)
    df = df.withColumn("_st", F.when(ok, F.sqrt(t))).withColumn("_kd", F.when(ok, k * F.exp(-r * t)))
    df = df.withColumn("_d1", F.when(ok, (F.log(s / k) + (r + v * v * F.lit(0.5)) * t) / (v * F.col("_st"))))
    df = df.withColumn("_d2", F.col("_d1") - v * F.col("_st"))
    df = df.withColumn("_l1", lower_tail(F.col("_d1"))).withColumn("_l2", lower_tail(F.col("_d2")))
    one = F.lit(1.0)
    return df.withColumns({
        "_n1": F.when(F.col("_d1") > 0, one - F.col("_l1")).otherwise(F.col("_l1")),
        "_n2": F.when(F.col("_d2") > 0, one - F.col("_l2")).otherwise(F.col("_l2")),
        "_m1": F.when(F.col("_d1") > 0, F.col("_l1")).otherwise(one - F.col("_l1")),
        "_m2": F.when(F.col("_d2") > 0, F.col("_l2")).otherwise(one - F.col("_l2"))})


def with_price(df: DataFrame, spot="spot_price", strike="strike", years="years", rate=0.02, sigma="iv",
               option_type="option_type", out: str = "model_price") -> DataFrame:
    """Black-Scholes value; intrinsic when any input is not positive."""
    s, k = _cols(spot, strike)
    call = is_call(option_type)
    intrinsic = F.greatest(F.when(call, s - k).otherwise(k - s), F.lit(0.0))
    model = F.when(call, s * F.col("_n1") - F.col("_kd") * F.col("_n2")) \
             .otherwise(F.col("_kd") * F.col("_m2") - s * F.col("_m1"))
    return _with_terms(df, spot, strike, years, rate, sigma) \
        .withColumn(out, F.coalesce(model, intrinsic)).drop(*TERMS)


def with_greeks(df: DataFrame, spot="spot_price", strike="strike", years="years", rate=0.02, sigma="iv",
                option_type="option_type") -> DataFrame:
    """delta, gamma, theta (per day), vega, rho; null when the tenor or sigma is too small."""
    s, t, r, v = _cols(spot, years, rate, sigma)
    call, st, kd = is_call(option_type), F.col("_st"), F.col("_kd")
    ok = t > 1e-6
    pdf = F.col("_pdf")
    decay = -(s * pdf * v) / (F.lit(2.0) * st)
    out = {
        "delta": F.when(call, F.col("_n1")).otherwise(F.col("_n1") - F.lit(1.0)),
        "gamma": pdf / (s * v * st),
        "theta": F.when(call, decay - r * kd * F.col("_n2")).otherwise(decay + r * kd * F.col("_m2")) / F.lit(365.0),
        "vega": s * pdf * st,
        "rho": F.when(call, t * kd * F.col("_n2")).otherwise(-t * kd * F.col("_m2")),
    }
    return _with_terms(df, spot, strike, years, rate, sigma).withColumn("_pdf", norm_pdf(F.col("_d1"))) \
        .withColumns({name: F.when(ok & F.col("_d1").isNotNull(), expr) for name, expr in out.items()}) \
        .drop(*TERMS, "_pdf")


# --------------------------------------------------------------------------
# Implied volatility: iterative, so it runs as one vectorised Arrow function.
# --------------------------------------------------------------------------

def _np_cdf(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    e = np.exp(-a * a / 2.0)
    core = e * np.polyval(HART_NUMERATOR, a) / np.polyval(HART_DENOMINATOR, a)
    tail = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + k / tail
    lower = np.where(a > 37, 0.0, np.where(a < HART_SPLIT, core, e / tail / SQRT_2PI))
    return np.where(x > 0, 1.0 - lower, lower)


def _np_price_vega(s, k, t, r, v, call):
    sqrt_t = np.sqrt(t)
    d1 = (np.log(s / k) + (r + 0.5 * v * v) * t) / (v * sqrt_t)
    d2 = d1 - v * sqrt_t
    disc = k * np.exp(-r * t)
    n1, n2 = _np_cdf(d1), _np_cdf(d2)
    value = s * n1 - disc * n2
    value = np.where(call, value, value - s + disc)
    vega = s * np.exp(-d1 * d1 / 2.0) * INV_SQRT_2PI * sqrt_t
    return value, vega


def _bracketed_newton(px, s, k, t, r, call, low, high, tol, steps):
    """Newton steps kept inside a shrinking bracket; returns (sigma, converged)."""
    n = len(px)
    sigma, converged = np.full(n, np.nan), np.zeros(n, dtype=bool)
    idx = np.arange(n)
    lo, hi = np.full(n, low), np.full(n, high)
    v = np.clip(np.full(n, 0.3), low, high)
    for _ in range(steps):
        if not len(idx):
            break
        value, vega = _np_price_vega(s[idx], k[idx], t[idx], r[idx], v, call[idx])
        diff = value - px[idx]
        hit = np.abs(diff) < tol
        done = hit | (hi - lo < tol)
        sigma[idx] = v
        converged[idx[hit]] = True
        hi = np.where(diff > 0, np.minimum(hi, v), hi)
        lo = np.where(diff > 0, lo, np.maximum(lo, v))
        step = v - diff / vega
        v = np.where(np.isfinite(step) & (step > lo) & (step < hi), step, (lo + hi) / 2.0)
        keep = ~done
        idx, lo, hi, v = idx[keep], lo[keep], hi[keep], v[keep]
    return sigma, converged


def solve_implied_vol(px, s, k, t, r, call, low=0.001, high=5.0, tol=1e-8, steps=80):
    """Implied volatility of a whole batch.

    Null for an expired tenor, non-positive inputs or a price under intrinsic - 0.01.
    A price no volatility in [low, high] reaches settles at that end of the bracket, unless
    a larger volatility does reach it.
    """
    with np.errstate(all="ignore"):
        disc = k * np.exp(-r * t)
        intrinsic = np.where(call, np.maximum(s - disc, 0.0), np.maximum(disc - s, 0.0))
        ok = (t > 1e-6) & (s > 0) & (k > 0) & (px > 0) & (px >= intrinsic - 0.01)
        ok &= np.isfinite(px + s + k + t + r)
        out = np.full(len(px), np.nan)
        i = np.flatnonzero(ok)
        sigma, hit = _bracketed_newton(px[i], s[i], k[i], t[i], r[i], call[i],
                                       low, high, tol, steps)
        out[i] = sigma
        j = i[~hit & (sigma > high - 1e-6)]
        if len(j):
            wide, found = _bracketed_newton(px[j], s[j], k[j], t[j], r[j], call[j],
                                            high, 100.0, tol, steps)
            out[j] = np.where(found, wide, high)
        return out


@F.pandas_udf(T.DoubleType())
def implied_vol_udf(px: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series,
                    call: pd.Series) -> pd.Series:
    args = [x.to_numpy(dtype="float64", na_value=np.nan) for x in (px, s, k, t, r)]
    flags = call.fillna(False).to_numpy(dtype=bool)
    vol = solve_implied_vol(*args, flags)
    return pd.Series(vol).where(np.isfinite(vol), None)


def implied_vol(market_price, spot, strike, years, rate, option_type) -> Column:
    p, s, k, t, r = _cols(market_price, spot, strike, years, rate)
    return implied_vol_udf(p, s, k, t, r, is_call(option_type))
