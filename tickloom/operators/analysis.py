"""Market regimes, institution features and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import scalars as S


# ------------------------------------------------------------------ regimes

def regime_metrics(daily: DataFrame, lookback: int = 20, keys: list[str] | None = None) -> DataFrame:
    """Trend strength, true-range volatility and volume trend over the trailing rows.

    One row per contract and day, so each window partition is bounded by the number of days.
    """
    keys = keys or ["contract_code"]
    base = Window.partitionBy(*keys).orderBy("trade_date")

    def rows(a, b):
        return base.rowsBetween(a, b)

    prev = F.lag("close").over(base)
    half = lookback // 2
    vol = F.coalesce(F.col("volume"), F.lit(0))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    d = daily.withColumn("_tr", F.when(prev.isNotNull(), tr)).withColumn("_v", vol)
    d = d.withColumns({
        "_n": F.count(F.lit(1)).over(rows(-(lookback - 1), 0)),
        "short_ma": F.avg("close").over(rows(-4, 0)),
        "long_ma": F.avg("close").over(rows(-(lookback - 1), 0)),
        "_atr": F.avg("_tr").over(rows(-(lookback - 2), 0)),
        "_v1": F.sum("_v").over(rows(-(lookback - 1), -(lookback - half))),
        "_v2": F.sum("_v").over(rows(-(lookback - half - 1), 0)),
        "_first": F.first("close").over(rows(-(lookback - 1), 0)),
        "_back5": F.lag("close", 4).over(base)})
    d = d.filter(F.col("_n") == lookback)
    ma = F.nullif(F.col("long_ma"), F.lit(0.0))
    return d.select(
        *keys, "trade_date", "close", "_first", "_back5",
        F.coalesce(F.abs(F.col("short_ma") - F.col("long_ma")) / ma, F.lit(0.0)).alias("_trend"),
        F.coalesce(F.col("_atr") / ma, F.lit(0.0)).alias("_vol"),
        F.coalesce(F.col("_v2") / F.nullif(F.col("_v1"), F.lit(0)), F.lit(1.0)).alias("_vt"))


def classify_regimes(daily: DataFrame, lookback: int = 20, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["contract_code"]
    m = regime_metrics(daily, lookback, keys)
    trend, vol = F.col("_trend"), F.col("_vol")
    kind = F.when(vol > 0.03, "volatile") \
            .when(trend > 0.01, F.when(F.col("close") > F.col("_first"), "trending_up").otherwise("trending_down")) \
            .otherwise("range")
    iv = F.when(vol > 0.025, "high_iv").when(vol < 0.01, "low_iv") \
          .when(F.col("close") > F.col("_back5"), "rising_iv").otherwise("falling_iv")
    if lookback < 10:
        iv = F.lit("unknown")
    score = F.least(F.lit(1.0), trend * 2 + (F.lit(1.0) - vol) * 0.5)
    return m.select("trade_date", *keys, kind.alias("regime_type"),
                    F.round(trend, 4).alias("trend_strength"), F.round(vol, 4).alias("volatility_level"),
                    F.round("_vt", 3).alias("volume_trend"), iv.alias("iv_regime"),
                    F.round(score, 3).alias("regime_score"))


def market_environment(index_daily: DataFrame, avg_iv: DataFrame, keys: list[str] | None = None,
                       rows: int = 20) -> DataFrame:
    """Trailing return, amplitude, IV change and volume with the environment label.

    index_daily has one row per key and day; avg_iv carries ``avg_iv`` for the same keys and dates.
    """
    keys = keys or ["underlying"]
    base = Window.partitionBy(*keys).orderBy("trade_date")
    w = base.rowsBetween(-(rows - 1), 0)
    w10 = base.rowsBetween(-9, 0)
    d = index_daily.join(avg_iv.select(*keys, "trade_date", "avg_iv"), [*keys, "trade_date"], "left")
    first = F.first("close").over(w)
    low = F.min("low").over(w)
    iv0 = F.first("avg_iv", ignorenulls=True).over(w)
    iv1 = F.last("avg_iv", ignorenulls=True).over(w)
    vol = F.coalesce(F.col("volume"), F.lit(0))
    d = d.withColumns({
        "_n": F.count(F.lit(1)).over(w),
        "_ret": F.coalesce((F.col("close") - first) / F.nullif(first, F.lit(0.0)) * 100, F.lit(0.0)),
        "_amp": F.coalesce((F.max("high").over(w) - low) / F.nullif(low, F.lit(0.0)) * 100, F.lit(0.0)),
        "_iv": F.coalesce((iv1 - iv0) / F.nullif(iv0, F.lit(0.0)) * 100, F.lit(0.0)),
        "sum_volume_10d": F.sum(vol).over(w10),
        "avg_volume_20d": F.round(F.avg(vol).over(w), 2)}).filter(F.col("_n") >= 5)
    env = F.when(F.col("_ret") > 3, "trend_up").when(F.col("_ret") < -3, "trend_down") \
           .when((F.col("_amp") > 5) & (F.col("_iv") > 10), "high_vol") \
           .when((F.col("_amp") < 2) & (F.col("_iv") < -5), "low_vol").otherwise("neutral")
    return d.select(*keys, "trade_date", env.alias("env_type"), F.round("_ret", 2).alias("ret_20d"),
                    F.round("_amp", 2).alias("amplitude_20d"), F.round("_iv", 2).alias("iv_change_pct"),
                    "sum_volume_10d", "avg_volume_20d")


# ------------------------------------------------------------------ institutions

def institution_features(positions: DataFrame) -> DataFrame:
    """Member features per day and contract: net, changes, ranks, market shares, concentration.

    Market totals come from a pre-aggregated join and the changes from the source columns or, where
    they are missing, the member's previous day. Ranks count members per distinct volume first.
    """
    p = positions.filter(F.coalesce(F.col("member_name"), F.lit("")) != "")
    zero = F.lit(0)
    p = p.withColumn("long_volume", F.coalesce("long_volume", zero)) \
         .withColumn("short_volume", F.coalesce("short_volume", zero))
    totals = p.groupBy("trade_date").agg(F.sum("long_volume").alias("total_market_long"),
                                         F.sum("short_volume").alias("total_market_short"))
    out = p.join(totals, "trade_date")
    # One row per member, contract and day: partitions bounded by days.
    w = Window.partitionBy("exchange", "contract_code", "member_name").orderBy("trade_date")

    def change(side):
        lagged = F.coalesce(F.col(f"{side}_volume") - F.lag(f"{side}_volume").over(w), zero)
        return F.coalesce(F.col(f"{side}_change"), lagged) if f"{side}_change" in p.columns else lagged

    # One row per member of a contract on a day: partitions bounded by the members of an exchange.
    def rank(side):
        return F.rank().over(Window.partitionBy("trade_date", "exchange", "contract_code")
                             .orderBy(F.desc(f"{side}_volume")))

    def share(side):
        return F.coalesce(F.col(f"{side}_volume") / F.nullif(F.col(f"total_market_{side}"), zero), F.lit(0.0))

    out = out.withColumns({"long_change": change("long"), "short_change": change("short")})
    return out.select(
        "trade_date", "exchange", "contract_code", "member_name", "long_volume", "short_volume",
        (F.col("long_volume") - F.col("short_volume")).alias("net_volume"),
        "long_change", "short_change", (F.col("long_change") - F.col("short_change")).alias("net_change"),
        rank("long").alias("member_rank_long"), rank("short").alias("member_rank_short"),
        "total_market_long", "total_market_short", share("long").alias("member_long_pct"),
        share("short").alias("member_short_pct"),
        ((share("long") + share("short")) / 2).alias("concentration_score"))


def institution_profiles(features: DataFrame, upto=None) -> DataFrame:
    if upto is not None:
        features = features.filter(F.col("trade_date") <= F.lit(upto).cast("date"))
    out = features.groupBy("member_name").agg(
        F.sum("long_volume").alias("total_long"), F.sum("short_volume").alias("total_short"),
        F.min("trade_date").alias("first_appearance"), F.max("trade_date").alias("last_appearance"))
    net = F.col("total_long") - F.col("total_short")
    return out.withColumn("total_net", net).withColumn(
        "bias_direction", F.when(net > 0, "long_bias").when(net < 0, "short_bias").otherwise("neutral"))


def member_flows(features: DataFrame) -> DataFrame:
    """Net change per member and day over all contracts."""
    return features.groupBy("trade_date", "member_name").agg(F.sum("net_change").alias("net_change"))


def lead_lag(features: DataFrame, lookback: int = 5, leaders: int = 5, threshold: float = 0.3) -> DataFrame:
    """Edges from the day's leading members to same-direction followers.

    Leaders are the ``leaders`` members with the largest absolute net change in the trailing
    ``lookback`` days of the member. They travel as one short array per day, so each follower row
    meets at most that many leaders and member pairs are never formed.
    """
    flows = member_flows(features)
    w = Window.partitionBy("member_name").orderBy("trade_date").rowsBetween(-(lookback - 1), 0)
    scored = flows.withColumn("_move", F.max(F.abs("net_change")).over(w)) \
                  .withColumn("_seen", F.count(F.lit(1)).over(w))
    day = Window.partitionBy("trade_date").orderBy(F.desc("_move"), "member_name")
    top = scored.withColumn("_r", F.row_number().over(day)).filter(F.col("_r") <= leaders) \
        .filter(F.col("net_change") != 0) \
        .groupBy("trade_date").agg(F.collect_list(F.struct(F.col("member_name").alias("leading_member"),
                                                           F.col("net_change").alias("leader_change"))).alias("_leaders"))
    followers = scored.filter((F.col("net_change") != 0) & (F.col("_seen") >= 2)) \
        .select("trade_date", F.col("member_name").alias("lagging_member"),
                F.col("net_change").alias("follower_change"))
    pairs = followers.join(top, "trade_date").select("*", F.inline("_leaders")).drop("_leaders")
    corr = F.least(F.lit(1.0), F.abs("follower_change") / F.greatest(F.abs("leader_change"), F.lit(1)))
    same = (F.col("leader_change") > 0) == (F.col("follower_change") > 0)
    return pairs.filter(F.col("leading_member") != F.col("lagging_member")) \
        .withColumn("_corr", corr).filter(same & (F.col("_corr") > threshold)) \
        .select("trade_date", "leading_member", "lagging_member", F.round("_corr", 3).alias("correlation"),
                F.lit(1).alias("lag_days"),
                F.when(F.col("leader_change") > 0, "bullish").otherwise("bearish").alias("signal_direction"))


def new_institutions(features: DataFrame, master: DataFrame) -> DataFrame:
    """Members not yet in the master, with their category."""
    seen = features.groupBy("member_name").agg(F.min("exchange").alias("exchange"))
    return seen.join(master.select("member_name"), "member_name", "left_anti") \
        .select("exchange", "member_name", S.institution_category("member_name").alias("category"),
                F.lit("active").alias("status"))


def resolve_names(rows: DataFrame, mapping: DataFrame, raw: str = "raw_name") -> DataFrame:
    """Canonical member name; unmapped names stand for themselves with confidence 0.5."""
    m = mapping.select(F.col("raw_name").alias(raw), "exchange", F.col("canonical_name").alias("_to"),
                       F.col("confidence").alias("_conf"))
    return rows.join(m, [raw, "exchange"], "left") \
        .withColumn("canonical_name", F.coalesce("_to", raw)) \
        .withColumn("confidence", F.when(F.col("_to").isNull(), F.lit(0.5)).otherwise(F.col("_conf"))) \
        .drop("_to", "_conf")


# ------------------------------------------------------------------ signals

def generate_signals(features: DataFrame, regimes: DataFrame | None = None, threshold: float = 0.6) -> DataFrame:
    """Entry signals from concentrated, growing positions; a contrary trend vetoes.

    The regime is that of the same contract, else of its product when ``regimes`` carries one.
    """
    f = features.filter(F.col("concentration_score") >= threshold)
    net, change = F.col("net_volume"), F.col("net_change")
    kind = F.when((net > 0) & (change > 0), "entry_long").when((net < 0) & (change < 0), "entry_short")
    f = f.withColumn("signal_type", kind).filter(F.col("signal_type").isNotNull())
    regime = F.lit(None).cast("string")
    if regimes is not None:
        r = regimes.select("trade_date", "contract_code", F.col("regime_type").alias("_regime"))
        f = f.join(r, ["trade_date", "contract_code"], "left")
        regime = F.col("_regime")
        if "product_code" in regimes.columns and "product_code" in f.columns:
            by_product = regimes.groupBy("trade_date", "product_code") \
                .agg(F.min_by("regime_type", "contract_code").alias("_product_regime"))
            f = f.join(by_product, ["trade_date", "product_code"], "left")
            regime = F.coalesce("_regime", "_product_regime")
        against = ((F.col("signal_type") == "entry_long") & (regime == "trending_down")) | \
                  ((F.col("signal_type") == "entry_short") & (regime == "trending_up"))
        f = f.filter(~F.coalesce(against, F.lit(False)))
    strength = F.least(F.lit(1.0), F.col("concentration_score") * 0.5
                       + F.abs("net_change") / F.greatest(F.abs("net_volume"), F.lit(1)) * 0.5)
    return f.select(
        F.col("trade_date").alias("signal_date"), F.col("contract_code").alias("product"), "exchange",
        "signal_type", F.round(strength, 3).alias("strength"),
        F.when(regime.isNull(), "institution_flow").otherwise("composite").alias("source"),
        F.struct("member_name", "concentration_score", "net_volume", "net_change",
                 regime.alias("regime")).alias("detail"),
        F.lit(0).alias("triggered"))


def active_signals(signals: DataFrame, upto) -> DataFrame:
    return signals.filter((F.col("signal_date") <= F.lit(upto).cast("date")) & (F.col("triggered") == 0)) \
                  .orderBy(F.desc("strength"))


def trigger_signals(signals: DataFrame, entries: DataFrame) -> DataFrame:
    """Mark signals that were entered (entries: id, trigger_date, entry_price)."""
    e = entries.groupBy("id").agg(F.min("trigger_date").alias("_d"))
    return signals.join(e, "id", "left") \
        .withColumn("triggered", F.when(F.col("_d").isNotNull(), 1).otherwise(F.col("triggered"))) \
        .withColumn("triggered_date", F.col("_d")).drop("_d")


def close_triggers(triggers: DataFrame, signals: DataFrame) -> DataFrame:
    """Signed P&L of closed triggers: exit minus entry for longs, the reverse for shorts."""
    s = signals.select(F.col("id").alias("signal_id"), "signal_type")
    move = F.col("exit_price") - F.col("entry_price")
    pnl = F.when(F.col("signal_type") == "entry_long", move) \
           .when(F.col("signal_type") == "entry_short", -move).otherwise(move * 0)
    return triggers.join(s, "signal_id").withColumn("pnl", pnl).withColumn("status", F.lit("closed"))


def signal_performance(closed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    n = F.count(F.lit(1))
    return closed.filter(F.col("status") == "closed").groupBy(*(keys or [])).agg(
        n.alias("total"), (F.sum("pnl").cast("double") / n).alias("avg_pnl"),
        (F.count_if(F.col("pnl") > 0) / n).alias("win_rate"), F.sum("pnl").alias("total_pnl"),
        (F.sum("holding_days").cast("double") / n).alias("avg_holding_days"))


def analysis_pipeline(positions: DataFrame, daily: DataFrame, threshold: float = 0.6) -> dict[str, DataFrame]:
    """Institution features, profiles, edges, regimes and signals for a whole date range."""
    features = institution_features(positions)
    regimes = classify_regimes(daily)
    return {"features": features, "profiles": institution_profiles(features), "lead_lag": lead_lag(features),
            "regimes": regimes, "signals": generate_signals(features, regimes, threshold)}
