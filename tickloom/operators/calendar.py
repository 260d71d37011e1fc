"""Trading-calendar operators around one dimension.

``resolve_calendar`` numbers trading days once (``td_index``); next / previous / nth day, counts,
offsets and snapping are then equi joins against it. The dimension has one row per calendar day
and exchange, so its windows and broadcasts are bounded by the number of days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import minute_of_day

# Listing dates and home exchange of known products.
PRODUCT_LISTING = {
    "IF": ("CFFEX", "2010-04-16"), "IH": ("CFFEX", "2015-04-16"), "IC": ("CFFEX", "2015-04-16"),
    "IM": ("CFFEX", "2022-07-22"), "IO": ("CFFEX", "2019-12-23"), "HO": ("CFFEX", "2022-07-22"),
    "MO": ("CFFEX", "2022-07-22"), "AU": ("SHFE", "2008-01-09"), "AG": ("SHFE", "2012-05-10"),
    "CU": ("SHFE", "1999-10-01"), "AL": ("SHFE", "1999-10-01"), "ZN": ("SHFE", "2007-03-26"),
    "SN": ("SHFE", "2007-04-10"),
}
NOT_LISTED = "未上市"


def is_weekend(date) -> Column:
    return F.dayofweek(date).isin(1, 7)


def day_range(spark: SparkSession, start, end) -> DataFrame:
    """One row per calendar day, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(
        F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day")))
        .alias("trade_date"))


def build_calendar(days: DataFrame, holidays: DataFrame, exchange: str = "ALL") -> DataFrame:
    """Day rows with weekend / holiday flag and holiday name (``holidays``: trade_date, holiday_name)."""
    names = holidays.groupBy("trade_date").agg(F.min("holiday_name").alias("holiday_name"))
    return (days.join(names, "trade_date", "left")
                .select("trade_date", F.lit(exchange).alias("exchange_code"),
                        F.lit("").alias("product_code"),
                        F.when(is_weekend("trade_date") | F.col("holiday_name").isNotNull(), 1)
                         .otherwise(0).alias("is_holiday"),
                        "holiday_name"))


def product_calendar(calendar: DataFrame, products: DataFrame) -> DataFrame:
    """Product rows (product_code, exchange_code, listing_date) over every calendar day.

    Each product expands its own day sequence, then picks up the exchange flags by date.
    """
    span = calendar.filter(F.col("exchange_code") == "ALL")
    first = span.agg(F.min("trade_date")).scalar()
    last = span.agg(F.max("trade_date")).scalar()
    grid = products.withColumn("_a", first).withColumn("_b", last).select(
        "product_code", "exchange_code", "listing_date",
        F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias("trade_date"))
    flags = span.select("trade_date", F.col("is_holiday").alias("_h"), "holiday_name")
    unlisted = F.col("trade_date") < F.col("listing_date")
    return grid.join(flags, "trade_date", "left").select(
        "trade_date", "exchange_code", "product_code",
        F.when(unlisted, 1).when(is_weekend("trade_date"), 1)
         .otherwise(F.coalesce("_h", F.lit(0))).alias("is_holiday"),
        F.when(unlisted, F.lit(NOT_LISTED))
         .otherwise(F.coalesce("holiday_name", F.lit(""))).alias("holiday_name"))


def resolve_calendar(days: DataFrame, calendar: DataFrame, overrides: DataFrame | None = None,
                     exchange: str = "ALL") -> DataFrame:
    """is_trading per day: exchange override, ALL override, calendar row, weekday rule.

    Also adds ``td_index`` (trading days up to and including the day), ``next_td`` (first trading
    day on or after) and ``prev_td`` (last trading day on or before).
    """
    out = days.select("trade_date").distinct()
    out = out.withColumn("_exchange", F.lit(exchange))
    rows = calendar.filter((F.col("exchange_code") == exchange)) \
        .groupBy("trade_date").agg(F.min_by("is_holiday", "product_code").alias("_holiday"))
    out = out.join(rows, "trade_date", "left")
    rule = F.when(F.col("_holiday").isNotNull(), F.col("_holiday") == 0) \
            .otherwise(~is_weekend("trade_date"))
    if overrides is not None:
        ranked = overrides.filter(F.col("exchange_code").isin(exchange, "ALL")) \
            .groupBy("trade_date") \
            .agg(F.max_by("override_type", F.when(F.col("exchange_code") == exchange, 1).otherwise(0))
                  .alias("_override"))
        out = out.join(ranked, "trade_date", "left")
        rule = F.when(F.col("_override").isNotNull(),
                      F.col("_override").isin("workday", "half_day")).otherwise(rule)
    out = out.select(F.col("_exchange").alias("exchange_code"), "trade_date", rule.alias("is_trading"))
    w = Window.partitionBy("exchange_code").orderBy("trade_date")
    td = F.when(F.col("is_trading"), F.col("trade_date"))
    return out.select(
        "*",
        F.sum(F.col("is_trading").cast("bigint")).over(w).alias("td_index"),
        F.first(td, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("next_td"),
        F.last(td, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("prev_td"))


def trading_days(resolved: DataFrame, start=None, end=None) -> DataFrame:
    out = resolved.filter("is_trading")
    if start is not None:
        out = out.filter(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("trade_date") <= F.lit(end).cast("date"))
    return out


def _dim(resolved: DataFrame, date: str, **columns: str) -> DataFrame:
    """Calendar columns renamed for one join; bounded by the number of days, so broadcast."""
    return F.broadcast(resolved.select(F.col("trade_date").alias(date),
                                       *[F.col(src).alias(dst) for dst, src in columns.items()]))


def add_trading_days(df: DataFrame, resolved: DataFrame, n: int, date: str = "trade_date",
                     out: str = "target_date") -> DataFrame:
    """The nth trading day after (n > 0) or before (n < 0) the date; n = 0 keeps the date."""
    if n == 0:
        return df.withColumn(out, F.col(date))
    base = df.join(_dim(resolved, date, _idx="td_index", _open="is_trading"), date, "left")
    # td_index of a closed day equals that of the last open day before it.
    want = F.col("_idx") + n if n > 0 else \
        F.when(F.col("_open"), F.col("_idx") + n).otherwise(F.col("_idx") + n + 1)
    targets = F.broadcast(resolved.filter("is_trading")
                          .select(F.col("td_index").alias("_want"), F.col("trade_date").alias(out)))
    return base.withColumn("_want", want).join(targets, "_want", "left") \
               .drop("_want", "_idx", "_open")


def count_trading_days(df: DataFrame, resolved: DataFrame, start: str, end: str,
                       out: str = "trading_days") -> DataFrame:
    """Trading days in [start, end]; 0 when reversed."""
    a = _dim(resolved, start, _ia="td_index", _oa="is_trading")
    b = _dim(resolved, end, _ib="td_index")
    n = F.col("_ib") - F.col("_ia") + F.col("_oa").cast("bigint")
    return df.join(a, start, "left").join(b, end, "left") \
             .withColumn(out, F.when(F.col(start) > F.col(end), F.lit(0)).otherwise(n).cast("bigint")) \
             .drop("_ia", "_oa", "_ib")


def trading_day_offset(df: DataFrame, resolved: DataFrame, start: str, end: str,
                       out: str = "offset") -> DataFrame:
    """Signed distance in trading days: inclusive count minus one, negative when reversed."""
    a = _dim(resolved, start, _ia="td_index", _oa="is_trading")
    b = _dim(resolved, end, _ib="td_index", _ob="is_trading")
    ahead = F.col("_ib") - F.col("_ia") + F.col("_oa").cast("bigint") - 1
    back = -(F.col("_ia") - F.col("_ib") + F.col("_ob").cast("bigint") - 1)
    return df.join(a, start, "left").join(b, end, "left") \
             .withColumn(out, F.when(F.col(start) == F.col(end), F.lit(0))
                         .when(F.col(start) < F.col(end), ahead).otherwise(back).cast("bigint")) \
             .drop("_ia", "_oa", "_ib", "_ob")


def snap(df: DataFrame, resolved: DataFrame, direction: str = "forward", date: str = "trade_date",
         out: str = "snapped") -> DataFrame:
    """Nearest trading day forward, backward, or nearest (a tie goes backward)."""
    base = df.join(_dim(resolved, date, _n="next_td", _p="prev_td"), date, "left")
    if direction == "forward":
        pick = F.col("_n")
    elif direction == "backward":
        pick = F.col("_p")
    else:
        closer_back = F.datediff(F.col(date), F.col("_p")) <= F.datediff(F.col("_n"), F.col(date))
        pick = F.when(F.col("_n").isNull(), F.col("_p")).when(F.col("_p").isNull(), F.col("_n")) \
                .when(closer_back, F.col("_p")).otherwise(F.col("_n"))
    return base.withColumn(out, pick).drop("_n", "_p")


def month_edges(resolved: DataFrame) -> DataFrame:
    """First and last trading day of each month."""
    return resolved.filter("is_trading") \
        .groupBy("exchange_code", F.year("trade_date").alias("year"), F.month("trade_date").alias("month")) \
        .agg(F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))


def latest_trading_day(df: DataFrame, resolved: DataFrame, date: str = "trade_date",
                       out: str = "latest_td") -> DataFrame:
    return df.join(_dim(resolved, date, **{out: "prev_td"}), date, "left")


def year_view(calendar: DataFrame) -> DataFrame:
    """One row per month with its days as an array of flags."""
    day = F.struct(F.dayofmonth("trade_date").alias("day"), F.col("is_holiday"), F.col("holiday_name"))
    return calendar.groupBy(F.year("trade_date").alias("year"), F.month("trade_date").alias("month")) \
        .agg(F.array_sort(F.collect_list(day)).alias("days"),
             F.sum(1 - F.col("is_holiday")).alias("trading_days"))


def calendar_stats(calendar: DataFrame) -> DataFrame:
    """Coverage per product and year."""
    return calendar.groupBy("product_code", F.year("trade_date").alias("year")).agg(
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"),
        F.count(F.lit(1)).alias("total_days"),
        F.count_if(F.col("is_holiday") == 0).alias("trading_days"),
        F.count_if(F.col("is_holiday") == 1).alias("holidays"))


def upsert_overrides(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """Overrides keyed by (exchange_code, trade_date); changes win."""
    key = ["exchange_code", "trade_date"]
    return existing.join(changes.select(*key).distinct(), key, "left_anti") \
                   .unionByName(changes, allowMissingColumns=True)


# ---------------------------------------------------------------- trading hours

def template_sessions(templates: DataFrame) -> DataFrame:
    """Day and night sessions of each template, one row per session."""
    day = F.transform(F.coalesce("normal_schedule", F.array().cast("array<struct<start:string,end:string>>")),
                      lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                         F.lit("day").alias("type")))
    night = F.transform(F.coalesce("night_schedule", F.array().cast("array<struct<start:string,end:string>>")),
                        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                           F.lit("night").alias("type")))
    return templates.select("template_id", F.inline(F.concat(day, night)))


def session_minutes(sessions: DataFrame, key: str = "template_id") -> DataFrame:
    """Minutes of day covered by any session (overnight sessions wrap); at most 1440 per key."""
    a, b = minute_of_day("start"), minute_of_day("end")
    minutes = F.when(b < a, F.concat(F.sequence(a, F.lit(1439)), F.sequence(F.lit(0), b))) \
               .otherwise(F.sequence(a, b))
    return sessions.select(key, F.explode(minutes).alias("minute")).distinct()


def within_sessions(df: DataFrame, sessions: DataFrame, time: str = "trade_time",
                    key: str = "template_id") -> DataFrame:
    """Keep rows whose time falls in a session of their template."""
    return df.withColumn("minute", minute_of_day(time)) \
             .join(session_minutes(sessions, key), [key, "minute"], "left_semi").drop("minute")


def session_predicate(time, sessions: list[tuple[str, str]]) -> Column:
    """In-session test for a fixed session list, as one expression."""
    m = minute_of_day(time)
    cond = F.lit(False)
    for start, end in sessions:
        a = int(start[:2]) * 60 + int(start[3:5])
        b = int(end[:2]) * 60 + int(end[3:5])
        cond = cond | ((m >= a) | (m <= b) if b < a else m.between(a, b))
    return cond
