"""OHLCV bars and quote aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.calendar import session_predicate

FREQUENCY_MINUTES = {"1min": 1, "5min": 5, "15min": 15, "30min": 30, "60min": 60}
TARGET_FREQUENCIES = ["5min", "15min", "30min", "60min"]


def _ohlcv(first_key: Column, last_key: Column) -> list[Column]:
    """Bar aggregates; first / last skip null opens and null open interest."""
    def first(c):
        return F.min_by(c, F.when(F.col(c).isNotNull(), first_key)).alias(c)

    def last(c):
        return F.max_by(c, F.when(F.col(c).isNotNull(), last_key)).alias(c)

    return [first("open"), F.max("high").alias("high"), F.min("low").alias("low"), last("close"),
            F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"),
            last("open_interest")]


def bucket(ts, minutes: int) -> Column:
    """Start of the bar that holds ``ts`` (``minutes`` divides an hour); keeps the timestamp type."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return t - F.make_dt_interval(mins=F.minute(t) % minutes, secs=F.extract(F.lit("second"), t))


def resample(ticks: DataFrame, freqs: list[str] | None = None, ts: str = "ts",
             keys: list[str] | None = None, sessions: list[tuple[str, str]] | None = None) -> DataFrame:
    """Bars of one or several frequencies, left-closed and left-labelled.

    Rows without a close are dropped first. The raw rows are shuffled once, already combined to
    the finest bar on the map side; coarser bars are rolled up from those finest bars.
    """
    freqs = freqs or TARGET_FREQUENCIES
    keys = keys or ["exchange", "contract_code"]
    rows = ticks.filter(F.col("close").isNotNull())
    if sessions:
        rows = rows.filter(session_predicate(F.date_format(ts, "HH:mm"), sessions))
    minutes = sorted(FREQUENCY_MINUTES[f] for f in freqs)
    base = minutes[0]
    if any(m % base for m in minutes):
        base = 5 if all(m % 5 == 0 for m in minutes) else 1
    span = [F.min(ts).alias("_t0"), F.max(ts).alias("_t1")]
    bars = rows.groupBy(*keys, bucket(ts, base).alias("bar_start")) \
               .agg(*_ohlcv(F.col(ts), F.col(ts)), *span)
    if freqs == [f"{base}min"]:
        bars = bars.withColumn("frequency", F.lit(freqs[0]))
    else:
        grid = F.array(*[F.struct(F.lit(f).alias("frequency"),
                                  bucket("bar_start", FREQUENCY_MINUTES[f]).alias("slot"))
                         for f in freqs])
        bars = bars.select("*", F.inline(grid)).drop("bar_start") \
                   .groupBy(*keys, "frequency", F.col("slot").alias("bar_start")) \
                   .agg(*_ohlcv(F.col("_t0"), F.col("_t1")))
    vwap = F.when(F.col("volume") != 0, F.col("turnover").cast("double") / F.col("volume"))
    return bars.select(*keys, "frequency", "bar_start",
                       F.to_date("bar_start").alias("trade_date"),
                       F.date_format("bar_start", "HH:mm:ss").alias("trade_time"),
                       "open", "high", "low", "close", "volume", "turnover", "open_interest",
                       vwap.alias("vwap"), F.lit("resampled").alias("source"))


def daily_to_weekly(daily: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Weekly bars labelled by the Sunday that ends the week."""
    keys = keys or ["contract_code"]
    week = F.next_day(F.date_sub("trade_date", 1), "SUN").alias("week_end")
    order = F.col("trade_date")
    return daily.filter(F.col("close").isNotNull()) \
        .groupBy(*keys, week).agg(*_ohlcv(order, order)) \
        .withColumn("frequency", F.lit("1w")).withColumn("source", F.lit("resampled_weekly"))


def validate_resample(source: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """Bar counts against rows // ratio, allowed within 0.5x to 1.5x."""
    n = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("original_bars"))
    m = bars.groupBy(*keys, "frequency").agg(F.count(F.lit(1)).alias("resampled_bars"))
    ratio = F.regexp_extract("frequency", r"(\d+)", 1).cast("bigint")
    expected = F.greatest(F.lit(1), F.floor(F.col("original_bars") / ratio))
    return m.join(n, keys).withColumn("expected_bars", expected.cast("bigint")) \
        .withColumn("valid", F.col("resampled_bars").between(F.col("expected_bars") * 0.5,
                                                            F.col("expected_bars") * 1.5))


def daily_vwap(minutes: DataFrame, price: str = "close", keys: list[str] | None = None,
               traded: DataFrame | None = None) -> DataFrame:
    """Volume-weighted price per instrument and day, 4 decimals; only ``traded`` keys if given."""
    keys = keys or ["contract_code", "trade_date"]
    rows = minutes.filter((F.col("volume") > 0) & F.col(price).isNotNull())
    out = rows.groupBy(*keys).agg(
        (F.sum(F.col(price) * F.col("volume")).cast("double") / F.sum("volume")).alias("_v"))
    if traded is not None:
        out = out.join(traded.select(*keys).distinct(), keys, "left_semi")
    return out.select(*keys, F.round("_v", 4).alias("vwap"))


def daily_market_stats(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, extremes and means per product and day plus the number of contracts."""
    aggs = []
    for field in ("volume", "turnover", "open_interest", "oi_change"):
        if field in daily.columns:
            c = F.col(field)
            aggs += [F.sum(c).alias(f"total_{field}"), F.max(c).alias(f"max_{field}"),
                     F.min(c).alias(f"min_{field}"),
                     (F.sum(c).cast("double") / F.count(c)).alias(f"mean_{field}")]
    return daily.groupBy(*keys).agg(*aggs, F.countDistinct("contract_code").alias("contract_count"))


def contract_stats(daily: DataFrame, order: str = "trade_date") -> DataFrame:
    return daily.groupBy("contract_code").agg(
        F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"),
        F.max_by("open_interest", F.when(F.col("open_interest").isNotNull(), F.col(order)))
         .alias("open_interest"))


def quote_summary(daily: DataFrame) -> DataFrame:
    """Per contract: points, date range and close / volume extremes (zero and null skipped)."""
    close = F.when(F.col("close") != 0, F.col("close"))
    vol = F.when(F.col("volume") != 0, F.col("volume"))
    return daily.groupBy("contract_code").agg(
        F.count(F.lit(1)).alias("data_points"), F.min("trade_date").alias("first_date"),
        F.max("trade_date").alias("last_date"), F.avg(close).alias("avg_close"),
        F.max(close).alias("max_close"), F.min(close).alias("min_close"), F.max(vol).alias("max_volume"))


def minute_summary(minutes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return minutes.groupBy(*(keys or ["contract_code"])).agg(
        F.count(F.lit(1)).alias("bar_count"), F.min("trade_time").alias("first_time"),
        F.max("trade_time").alias("last_time"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("volume").alias("total_volume"), F.sum("turnover").alias("total_turnover"),
        F.countDistinct("trade_date").alias("day_count"))


# Display rank of a frequency; unknown ones sort last.
FREQUENCY_RANK = {"1min": 1, "5min": 2, "15min": 3, "30min": 4, "60min": 5}


def list_frequencies(minutes: DataFrame) -> DataFrame:
    rank = F.lit(9)
    for name, r in FREQUENCY_RANK.items():
        rank = F.when(F.col("frequency") == name, F.lit(r)).otherwise(rank)
    return minutes.groupBy("contract_code", "frequency").agg(
        F.count(F.lit(1)).alias("bar_count"), F.min("trade_date").alias("min_date"),
        F.max("trade_date").alias("max_date")) \
        .withColumn("sort_rank", rank).orderBy("contract_code", "sort_rank", "frequency")


def minute_contracts(minutes: DataFrame, trade_date=None) -> DataFrame:
    if trade_date is not None:
        minutes = minutes.filter(F.col("trade_date") == F.lit(trade_date).cast("date"))
    return minutes.select("contract_code").distinct().orderBy("contract_code")
