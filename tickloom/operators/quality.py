"""Data-quality checks.

Row-level checks return the offending rows tagged with a check name; summary checks return tidy
rows (check, status, source, expected, actual, deviation, message).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import scalars as S

KEYS = ["exchange", "contract_code"]

# Bars expected per day session, with a night session, and the minimum accepted.
EXPECTED_BARS = {
    "1min": (240, 480, 180), "5min": (48, 96, 36), "15min": (16, 32, 12),
    "30min": (8, 16, 6), "60min": (4, 8, 3),
}


def _by_day(keys: list[str]):
    """Per-series day order; a series has one row per day, so partitions stay bounded."""
    return Window.partitionBy(*keys).orderBy("trade_date")


# ------------------------------------------------------------------ anomalies

def price_spikes(daily: DataFrame, threshold: float = 0.20) -> DataFrame:
    """Close moved more than the threshold against the previous trading row."""
    w = _by_day(KEYS)
    return daily.filter(F.col("close") > 0).withColumn("prev_close", F.lag("close").over(w)) \
        .withColumn("pct_change", F.round(F.abs(F.col("close") - F.col("prev_close")) / F.col("prev_close") * 100, 2)) \
        .filter(F.abs(F.col("close") - F.col("prev_close")) / F.col("prev_close") > threshold) \
        .select(*KEYS, "trade_date", "prev_close", "close", "pct_change")


def price_spikes_all_pairs(daily: DataFrame, days: int, threshold: float = 0.20) -> DataFrame:
    """Close against every later close within ``days`` calendar days.

    Each row is copied onto the days it can be compared with, which turns the later-date
    condition into an equi join bounded by ``days`` rows per quote.
    """
    d = daily.filter(F.col("close") > 0).select(*KEYS, "trade_date", "close")
    earlier = d.select(*KEYS, F.col("trade_date").alias("prev_date"), F.col("close").alias("prev_close"),
                       F.explode(F.sequence(F.date_add("trade_date", 1), F.date_add("trade_date", days)))
                        .alias("trade_date"))
    return d.join(earlier, [*KEYS, "trade_date"]) \
        .filter(F.abs(F.col("close") - F.col("prev_close")) / F.col("prev_close") > threshold)


def volume_anomalies(daily: DataFrame, days: int = 30, factor: float = 3.0, ref=None) -> DataFrame:
    """Volume above ``factor`` times the mean of the previous ``days`` calendar days.

    With ``ref`` the look-back window is anchored at that date instead of each row.
    """
    d = daily.withColumn("_day", F.datediff("trade_date", F.lit("1970-01-01").cast("date")))
    by_day = Window.partitionBy(*KEYS).orderBy("_day")
    if ref is None:
        w, base = by_day.rangeBetween(-days, -1), F.col("volume")
    else:
        start = F.date_sub(F.lit(ref).cast("date"), days)
        d = d.filter(F.col("trade_date") >= start)
        w, base = by_day.rangeBetween(Window.unboundedPreceding, -1), F.col("volume")
    n = F.count(base).over(w)
    mean = F.sum(base).over(w).cast("double") / F.nullif(n, F.lit(0))
    return d.withColumn("avg_volume", mean) \
        .filter((F.col("volume") > 0) & (F.col("avg_volume") > 0) & (F.col("volume") > F.col("avg_volume") * factor)) \
        .select(*KEYS, "trade_date", "volume", "avg_volume")


def zero_prices(daily: DataFrame) -> DataFrame:
    bad = (F.coalesce(F.col("close"), F.lit(0)) == 0) & (F.col("volume") > 0)
    return daily.filter(bad).select(*KEYS, "trade_date", "volume")


def position_spikes(positions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Total position of a contract moved more than the threshold against its previous day."""
    total = positions.groupBy(*KEYS, "trade_date").agg(
        F.sum(F.coalesce("long_volume", F.lit(0)) + F.coalesce("short_volume", F.lit(0))).alias("curr_total"))
    return total.withColumn("prev_total", F.lag("curr_total").over(_by_day(KEYS))) \
        .filter((F.col("prev_total") > 0)
                & (F.abs(F.col("curr_total") - F.col("prev_total")) / F.nullif(F.col("prev_total"), F.lit(0)) > threshold))


def iv_anomalies(iv: DataFrame, threshold: float = 0.3, key: str = "contract_code") -> DataFrame:
    rows = iv.filter(F.col("iv").isNotNull())
    return rows.withColumn("prev_iv", F.lag("iv").over(_by_day([key]))) \
        .filter(F.abs(F.col("iv") - F.col("prev_iv")) > threshold) \
        .select(key, "trade_date", "prev_iv", "iv")


def with_anomalies(daily: DataFrame, extreme: float = 9.0, divergence: float = 2.0) -> DataFrame:
    """Quotes with the names of the five rules that each row breaks, in one pass."""
    prev = F.lag("close").over(_by_day(KEYS))
    c, s, v = F.col("close"), F.col("settle"), F.col("volume")
    rules = {
        "zero_price": ((c == 0) | (s == 0)) & (v > 0),
        "extreme_change": (F.col("_prev") > 0) & (F.abs(c - F.col("_prev")) * 100.0
                                                  / F.nullif(F.col("_prev"), F.lit(0.0)) > extreme),
        "zero_volume_with_price": (c > 0) & (v == 0),
        "close_settle_divergence": (c > 0) & (s > 0)
                                   & (F.abs(c - s) * 100.0 / F.nullif(s, F.lit(0.0)) > divergence),
        "negative_volume": v < 0,
    }
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return daily.withColumn("_prev", prev).withColumn("checks", tags).drop("_prev")


def daily_anomalies(daily: DataFrame, extreme: float = 9.0, divergence: float = 2.0) -> DataFrame:
    """One row per quote and violated rule."""
    return with_anomalies(daily, extreme, divergence).select(*KEYS, "trade_date", F.explode("checks").alias("check"))


def cap_issues(issues: DataFrame, cap: int, order: list, by: str = "check") -> DataFrame:
    """The first ``cap`` issues of each check, for display lists."""
    w = Window.partitionBy(by).orderBy(*order)
    return issues.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r")


def position_consistency(positions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rank out of 1..20, negative volume, empty member; score max(0, 100 - 2 x issue %)."""
    out = positions.groupBy(*(keys or KEYS)).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if((F.col("rank") < 1) | (F.col("rank") > 20)).alias("bad_rank"),
        F.count_if((F.col("long_volume") < 0) | (F.col("short_volume") < 0)).alias("negative_volume"),
        F.count_if(F.coalesce(F.col("member_name"), F.lit("")) == "").alias("empty_member"))
    issues = F.col("bad_rank") + F.col("negative_volume") + F.col("empty_member")
    return out.withColumn("score", F.greatest(F.lit(0.0), F.lit(100.0) - issues / F.col("total_rows") * 100 * 2))


# ------------------------------------------------------------------ completeness and scores

def expected_days(series: DataFrame, resolved: DataFrame, keys: list[str], start: str = "earliest_date",
                  end: str = "latest_date") -> DataFrame:
    """Trading days between each series' first and last date, one row per series and day."""
    days = F.broadcast(resolved.filter("is_trading").select("trade_date"))
    return series.filter(F.col(start) <= F.col(end)) \
        .select(*keys, F.explode(F.sequence(start, end, F.expr("interval 1 day"))).alias("trade_date")) \
        .join(days, "trade_date", "left_semi")


def completeness(series: DataFrame, actual: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Expected, present and missing trading days per series with the percentage present.

    Counts come from the calendar index; the actual days are reduced to one row per series and day
    before the join, so nothing grows with the raw rows.
    """
    have = actual.select(*keys, "trade_date").distinct() \
        .join(F.broadcast(resolved.filter("is_trading").select("trade_date")), "trade_date", "left_semi")
    bounds = series.select(*keys, "earliest_date", "latest_date")
    present = have.join(bounds, keys) \
        .filter(F.col("trade_date").between(F.col("earliest_date"), F.col("latest_date"))) \
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("actual_days"))
    from tickloom.operators.calendar import count_trading_days
    want = count_trading_days(bounds, resolved, "earliest_date", "latest_date", "expected_days")
    out = want.join(present, keys, "left").withColumn("actual_days", F.coalesce("actual_days", F.lit(0)))
    missing = F.greatest(F.lit(0), F.col("expected_days") - F.col("actual_days"))
    pct = F.when(F.col("expected_days") > 0,
                 F.round((F.col("expected_days") - missing) / F.nullif(F.col("expected_days"), F.lit(0)) * 100, 2)) \
           .otherwise(100.0)
    return out.withColumn("missing_days", missing).withColumn("completeness_pct", pct) \
              .withColumn("status", F.when(missing == 0, "complete").otherwise("incomplete"))


def missing_dates(series: DataFrame, actual: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    want = expected_days(series, resolved, keys)
    return want.join(actual.select(*keys, "trade_date").distinct(), [*keys, "trade_date"], "left_anti")


def _expected(index: int) -> Column:
    m = S.literal_map({k: v[index] for k, v in EXPECTED_BARS.items()})
    return F.coalesce(m[F.col("frequency")], F.lit(EXPECTED_BARS["1min"][index]))


def minute_completeness(minutes: DataFrame, expected: DataFrame, night: bool = False) -> DataFrame:
    """Bars present per (contract, day, frequency) against the session size.

    expected: the contract_code, trade_date, frequency combinations that should exist.
    """
    keys = ["contract_code", "trade_date", "frequency"]
    n = minutes.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual_count"))
    out = expected.select(*keys).join(n, keys, "left").withColumn("actual_count", F.coalesce("actual_count", F.lit(0)))
    want, floor = _expected(1 if night else 0), _expected(2)
    a = F.col("actual_count")
    return out.withColumns({
        "expected_count": F.when(a == 0, 0).otherwise(want).cast("bigint"),
        "completeness_pct": F.when(a == 0, 0.0).otherwise(F.round(F.least(F.lit(100.0), a / want * 100), 1)),
        "status": F.when(a == 0, "missing").when(a >= want * 0.9, "complete")
                   .when(a >= floor, "partial").otherwise("incomplete")})


def minute_range_score(days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    out = days.groupBy(*(keys or ["contract_code", "frequency"])).agg(
        F.count(F.lit(1)).alias("total_days"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_days") for s in ("complete", "partial", "missing")])
    score = (F.col("complete_days") + F.col("partial_days") * 0.5) / F.col("total_days") * 100
    return out.withColumn("overall_pct", F.round(score, 1))


def accuracy_score(diffs: DataFrame, last: int | None = None, tie: str = "id") -> DataFrame:
    """100 minus 20 points per percent of mean deviation over the latest ``last`` comparisons (all by default)."""
    recent = diffs
    if last is not None:
        w = Window.partitionBy("catalog_id").orderBy(F.desc("trade_date"), F.desc(tie))
        recent = diffs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last)
    d = F.col("deviation_pct").cast("decimal(28,10)")
    mean = F.sum(d).cast("double") / F.nullif(F.count(d), F.lit(0))
    return recent.groupBy("catalog_id").agg(
        F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(mean, F.lit(0.0)) * 20).alias("accuracy"))


def consistency_score(catalogs: DataFrame, anomalies: DataFrame, position_scores: DataFrame) -> DataFrame:
    """Daily series lose 5 points per anomaly (50 at most); position series take their own score."""
    n = anomalies.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("_n"))
    p = position_scores.select("catalog_id", F.col("score").alias("_p"))
    daily = F.lit(100.0) - F.least(F.lit(50.0), F.coalesce("_n", F.lit(0)) * 5.0)
    kind = F.col("data_type")
    return catalogs.join(n, "catalog_id", "left").join(p, "catalog_id", "left").select(
        "catalog_id", F.when(kind == "daily", daily)
                       .when(kind.isin("top20_holdings", "position"), F.coalesce("_p", F.lit(100.0)))
                       .otherwise(100.0).alias("consistency"))


def quality_summary(quotes: DataFrame, positions: DataFrame, since=None) -> DataFrame:
    """One row per series and day: rows, broken rules, deviations from a second source and position
    errors. Every score is taken from this table, so the quotes are read once.

    quotes: catalog_id and ``other_close`` beside the quote columns. ``since`` returns the days from
    there on; the days before only give the previous close.
    """
    gap = F.abs(F.col("close") - F.col("other_close")) / F.nullif(F.abs("other_close"), F.lit(0.0)) * 100
    deviation = F.round(gap, 4).cast("decimal(28,10)")
    none = F.lit(0).cast("bigint")
    daily = with_anomalies(quotes).groupBy("catalog_id", "trade_date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.size("checks")).cast("bigint").alias("anomalies"),
        F.coalesce(F.sum(deviation), F.lit(0)).cast("decimal(38,10)").alias("deviation_sum"),
        F.count(deviation).alias("deviations"), none.alias("errors"))
    held = position_consistency(positions, ["catalog_id", "trade_date"]).select(
        "catalog_id", "trade_date", F.col("total_rows").alias("rows"), none.alias("anomalies"),
        F.lit(0).cast("decimal(38,10)").alias("deviation_sum"), none.alias("deviations"),
        (F.col("bad_rank") + F.col("negative_volume") + F.col("empty_member")).alias("errors"))
    out = daily.unionByName(held)
    return out if since is None else out.filter(F.col("trade_date") >= F.lit(since).cast("date"))


def update_quality_summary(spark: SparkSession, batch: DataFrame, path: str) -> None:
    """Days of a batch replace the same days of the stored summary; only their years are rewritten."""
    from tickloom.sources.tables import upsert
    upsert(spark, batch, path, ["catalog_id", "trade_date"], ["trade_date"], by="year")


def scores_from_summary(series: DataFrame, summary: DataFrame, resolved: DataFrame, last: int = 100) -> DataFrame:
    """Quality score of every series; accuracy looks at the latest ``last`` days with a comparison."""
    w = Window.partitionBy("catalog_id").orderBy(F.desc("trade_date"))
    recent = summary.filter("deviations > 0").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last)
    mean = F.sum("deviation_sum").cast("double") / F.sum("deviations")
    accuracy = recent.groupBy("catalog_id").agg(F.greatest(F.lit(0.0), F.lit(100.0) - mean * 20).alias("accuracy"))
    sums = summary.groupBy("catalog_id").agg(*[F.sum(c).alias(c) for c in ("rows", "anomalies", "errors")])
    daily = F.lit(100.0) - F.least(F.lit(50.0), F.col("anomalies") * 5.0)
    held = F.greatest(F.lit(0.0), F.lit(100.0) - F.col("errors") / F.col("rows") * 100 * 2)
    consistency = series.select("catalog_id", "data_type").join(sums, "catalog_id").select(
        "catalog_id", F.when(F.col("data_type") == "daily", daily)
                       .when(F.col("data_type").isin("top20_holdings", "position"), held).otherwise(100.0).alias("consistency"))
    return quality_score(series, completeness(series, summary, resolved, ["catalog_id"]), accuracy, consistency)


def quality_score(catalogs: DataFrame, complete: DataFrame, accuracy: DataFrame,
                  consistency: DataFrame) -> DataFrame:
    """Weighted score 0.5 / 0.3 / 0.2 with its level and alert messages."""
    j = catalogs.select("catalog_id") \
        .join(complete.select("catalog_id", F.col("completeness_pct").alias("completeness")), "catalog_id", "left") \
        .join(accuracy.select("catalog_id", "accuracy"), "catalog_id", "left") \
        .join(consistency.select("catalog_id", "consistency"), "catalog_id", "left") \
        .na.fill({"completeness": 0.0, "accuracy": 100.0, "consistency": 100.0})
    total = F.col("completeness") * 0.5 + F.col("accuracy") * 0.3 + F.col("consistency") * 0.2
    alerts = F.array_compact(F.array(
        F.when(F.col("completeness") < 90, "low_completeness"),
        F.when(F.col("completeness") < 70, "critical_completeness"),
        F.when(F.col("accuracy") < 95, "accuracy"),
        F.when(F.col("consistency") < 90, "consistency")))
    return j.select("catalog_id", F.round("completeness", 2).alias("completeness"),
                    F.round("accuracy", 2).alias("accuracy"), F.round("consistency", 2).alias("consistency"),
                    F.round(total, 2).alias("total_score"), S.quality_level(total).alias("quality_level"),
                    alerts.alias("alerts"))


def compare_sources(values: DataFrame, source_a: str, source_b: str, keys: list[str], field: str = "close",
                    threshold_pct: float = 0.5) -> DataFrame:
    """Deviation of one field between two sources of the same rows (0 when b is zero).

    Both sources come out of one conditional aggregation, so there is no self join.
    """
    both = values.filter(F.col("source").isin(source_a, source_b)).groupBy(*keys).agg(
        F.max(F.when(F.col("source") == source_a, F.col(field))).alias("value_a"),
        F.max(F.when(F.col("source") == source_b, F.col(field))).alias("value_b"))
    a, b = F.col("value_a"), F.col("value_b")
    dev = F.when(b != 0, F.abs(a - b) / F.nullif(F.abs(b), F.lit(0.0)) * 100).otherwise(0.0)
    missing = a.isNull() | b.isNull()
    return both.withColumn("deviation_pct", F.when(~missing, F.round(dev, 4))) \
        .withColumn("status", F.when(missing, "skipped").when(dev > threshold_pct, "alert").otherwise("normal"))


def deviation_summary(diffs: DataFrame, ref, days: int) -> DataFrame:
    since = F.date_sub(F.lit(ref).cast("date"), days)
    return diffs.filter((F.col("is_alert") == 1) & (F.col("trade_date") >= since)).agg(
        F.count(F.lit(1)).alias("total_alerts"), F.countDistinct("catalog_id").alias("affected_catalogs"),
        F.countDistinct("trade_date").alias("affected_dates"))


def recorded_vs_actual(recorded: DataFrame, actual_counts: DataFrame, key: str = "catalog_id") -> DataFrame:
    j = recorded.join(actual_counts, key, "left").withColumn("actual_total", F.coalesce("actual_total", F.lit(0))) \
                .withColumn("recorded_total", F.coalesce("recorded_total", F.lit(0)))
    j = j.withColumn("drift", F.abs(F.col("recorded_total") - F.col("actual_total")))
    return j.withColumn("drift_status", S.drift_status("drift", "actual_total"))


def reconcile_totals(status: DataFrame, actual_counts: DataFrame, key: str = "catalog_id") -> DataFrame:
    """Status frame with the recorded total replaced by the counted one."""
    return status.join(actual_counts, key, "left") \
        .withColumn("total_records", F.coalesce("actual_total", "total_records")).drop("actual_total")


def overview(recorded: DataFrame, actual_counts: DataFrame, complete: DataFrame, missing: DataFrame,
             key: str = "catalog_id") -> DataFrame:
    """Drift, completeness and all missing dates per catalog."""
    gaps = missing.groupBy(key).agg(F.array_sort(F.collect_list("trade_date")).alias("missing_dates"))
    return recorded_vs_actual(recorded, actual_counts, key) \
        .join(complete.select(key, "expected_days", "actual_days", "missing_days", "completeness_pct"), key, "left") \
        .join(gaps, key, "left")


def health_snapshot(quality: DataFrame, complete: DataFrame, sync_tasks: DataFrame, snapshot_date) -> DataFrame:
    """Daily health row per catalog: score, missing days, consistency and last synchronisation."""
    last = sync_tasks.groupBy("catalog_id").agg(
        F.max_by(F.struct("status", S.json_error("checkpoint_data").alias("error")),
                 F.struct("created_at", "id")).alias("_s"))
    return quality.join(complete.select("catalog_id", "missing_days", "completeness_pct"), "catalog_id", "left") \
        .join(last, "catalog_id", "left").select(
            "catalog_id", F.lit(snapshot_date).cast("date").alias("snapshot_date"),
            F.coalesce("missing_days", F.lit(0)).alias("missing_days"),
            F.col("total_score").alias("data_quality_score"),
            F.coalesce("completeness_pct", F.lit(0.0)).alias("completeness_pct"),
            S.consistency_status("consistency").alias("consistency_status"),
            F.coalesce("_s.status", F.lit("never_synced")).alias("last_sync_status"),
            F.col("_s.error").alias("last_sync_error"), "quality_level", "alerts")


def health_by_exchange(catalogs: DataFrame, latest: DataFrame) -> DataFrame:
    """Catalogs, mean quality, synced and troubled counts per exchange."""
    j = catalogs.join(latest.drop("snapshot_date"), "catalog_id", "left")
    n = F.count(F.lit(1))
    q = F.coalesce(F.col("data_quality_score"), F.lit(0.0)).cast("decimal(20,4)")
    return j.groupBy("exchange_code").agg(
        n.alias("catalog_count"), F.round(F.sum(q).cast("double") / n, 1).alias("avg_quality"),
        F.count_if(F.col("last_sync_status") == "completed").alias("synced_count"),
        F.count_if(F.col("missing_days") > 0).alias("with_issues"))


def catalog_panel(catalogs: DataFrame, latest: DataFrame, status: DataFrame) -> DataFrame:
    """Catalog rows of the dashboard with defaults for what is not known yet."""
    j = catalogs.join(latest.select("catalog_id", "data_quality_score", "completeness_pct", "missing_days",
                                    "last_sync_status"), "catalog_id", "left") \
                .join(status.select("catalog_id", "earliest_date", "latest_date", "total_records"), "catalog_id", "left")
    has = F.coalesce(F.col("total_records"), F.lit(0)) > 0
    sync = F.coalesce("last_sync_status", F.lit("unknown"))
    return j.select(
        *catalogs.columns,
        F.coalesce("data_quality_score", F.when(has, 50.0).otherwise(0.0)).alias("quality_score"),
        F.coalesce("completeness_pct", F.lit(0.0)).alias("completeness_pct"),
        F.coalesce("missing_days", F.lit(0)).alias("missing_days"),
        F.when(sync.isin("unknown", "never_synced") & has, "completed").otherwise(sync).alias("sync_status"),
        "earliest_date", "latest_date", F.coalesce("total_records", F.lit(0)).alias("total_records"))


def last_runs(audit_log: DataFrame) -> DataFrame:
    """Latest finished run per task."""
    return audit_log.filter(F.col("end_time").isNotNull()).groupBy("task_name").agg(
        F.max("end_time").alias("last_run"),
        F.max_by(F.when(F.col("success") == 1, "success").otherwise("failed"), F.struct("end_time", "id"))
         .alias("last_status"),
        F.max_by("records_fetched", F.struct("end_time", "id")).alias("last_records"))


def dashboard_summary(catalog_rows: DataFrame, runs: DataFrame, table_stats: DataFrame, today) -> DataFrame:
    """Single summary row over the three panels."""
    scored = F.when(F.col("quality_score") != 0, F.col("quality_score").cast("decimal(20,4)"))
    c = catalog_rows.agg(F.count(F.lit(1)).alias("total_catalogs"),
                         F.round(F.sum(scored).cast("double") / F.nullif(F.count(scored), F.lit(0)), 1).alias("avg_quality_score"))
    run_day = F.to_date("last_run") == F.lit(today).cast("date")
    r = runs.agg(F.count_if(run_day).alias("tasks_today"),
                 F.count_if(run_day & (F.col("last_status") == "failed")).alias("tasks_failed_today"))
    t = table_stats.agg(F.count(F.lit(1)).alias("total_tables"), F.sum("row_count").alias("total_records"))
    # Three one-row frames side by side.
    one = F.lit(1).alias("_k")
    return c.select("*", one).join(r.select("*", one), "_k").join(t.select("*", one), "_k").drop("_k")


# ------------------------------------------------------------------ freshness

def freshness(latest: DataFrame, resolved: DataFrame, ref) -> DataFrame:
    """Lag in trading days of each series behind the last trading day before ``ref``.

    latest: group, series, latest_date. A series with no date is expired.
    """
    # Last trading day strictly before the reference date.
    ref = ref if isinstance(ref, Column) else F.lit(ref)
    anchor = resolved.filter(F.col("is_trading") & (F.col("trade_date") < ref.cast("date"))) \
                     .agg(F.max("td_index")).scalar()
    idx = F.broadcast(resolved.select(F.col("trade_date").alias("latest_date"), "td_index", "is_trading"))
    # Inclusive count from the data date to the anchor minus one, never negative.
    span = anchor - F.col("td_index") + F.col("is_trading").cast("bigint") - 1
    lag = F.when(F.col("latest_date").isNull() | F.col("td_index").isNull(), F.lit(999)) \
           .otherwise(F.greatest(F.lit(0), span))
    return latest.join(idx, "latest_date", "left").withColumn("lag_trading_days", lag.cast("bigint")) \
        .withColumn("status", F.when(F.col("lag_trading_days") <= 1, "ok")
                    .when(F.col("lag_trading_days") <= 3, "stale").otherwise("expired")) \
        .drop("td_index", "is_trading")


def freshness_verdict(fresh: DataFrame, error_group: str = "iv") -> DataFrame:
    n = F.count(F.lit(1))
    return fresh.agg(
        F.when(F.count_if((F.col("group") == error_group) & (F.col("status") == "expired")) > 0, "error")
         .when(F.count_if(F.col("status") != "ok") > 0, "degraded").otherwise("ok").alias("overall"),
        F.round(F.count_if(F.col("status") == "ok") / n, 2).alias("healthy_ratio"), n.alias("series_count"))


def iv_completeness(iv: DataFrame, last: int | None = None, min_contracts: int = 8, min_rate: float = 0.8,
                    key: str = "underlying") -> DataFrame:
    """Contract count and share of usable IV over the latest ``last`` dates (all by default) of each underlying."""
    per_day = iv.groupBy(key, "trade_date").agg(
        F.count(F.lit(1)).alias("contracts"), F.count_if(F.col("iv") > 0).alias("with_iv"))
    if last is not None:
        w = Window.partitionBy(key).orderBy(F.desc("trade_date"))
        per_day = per_day.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last)
    return per_day.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_dates"),
        F.count_if(F.col("contracts") < min_contracts).alias("incomplete_count"),
        F.count_if(F.col("with_iv") / F.col("contracts") < min_rate).alias("low_iv_count"))


def lag_consistency(fresh: DataFrame) -> DataFrame:
    """Series of one group whose lag is more than one trading day behind the group's freshest.

    Comparing with the freshest finds every group that holds an inconsistent pair without forming
    the pairs.
    """
    best = fresh.groupBy("group").agg(F.min("lag_trading_days").alias("_best"))
    j = fresh.join(best, "group")
    return j.withColumn("diff_trading_days", F.col("lag_trading_days") - F.col("_best")) \
        .withColumn("consistent", F.col("diff_trading_days") <= 1).drop("_best")


# ------------------------------------------------------------------ cross-store and audit checks

def check_row(name: str, status: Column, source: str, expected: Column, actual: Column,
              deviation: Column | None = None) -> Column:
    return F.struct(F.lit(name).alias("check"), status.alias("status"), F.lit(source).alias("source"),
                    expected.cast("string").alias("expected"), actual.cast("string").alias("actual"),
                    (deviation if deviation is not None else F.lit(0)).cast("double").alias("deviation"))


def _checks(one_row: DataFrame, rows: list[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array(*rows)))


def _pass(cond: Column, otherwise: str = "FAIL") -> Column:
    return F.when(cond, "PASS").otherwise(otherwise)


def cross_store(left: DataFrame, right: DataFrame, table: str, sums: list[str]) -> DataFrame:
    """Row counts and column sums of the same table in two stores (sums agree within 0.01)."""
    def totals(df, tag):
        return df.agg(F.count(F.lit(1)).alias(f"n_{tag}"),
                      *[F.coalesce(F.sum(F.col(c).cast("decimal(28,4)")), F.lit(0)).alias(f"{c}_{tag}") for c in sums],
                      F.lit(1).alias("_k"))

    one = totals(left, "a").join(totals(right, "b").withColumnRenamed("_k", "_k2"), F.col("_k") == F.col("_k2"))
    rows = [check_row(f"{table}_count", _pass(F.col("n_a") == F.col("n_b")), table, F.col("n_a"), F.col("n_b"),
                      F.abs(F.col("n_a") - F.col("n_b")))]
    for c in sums:
        gap = F.abs(F.col(f"{c}_a") - F.col(f"{c}_b"))
        rows.append(check_row(f"{table}_sum_{c}", _pass(gap < 0.01), f"{table}.{c}",
                              F.col(f"{c}_a").cast("decimal(28,2)"), F.col(f"{c}_b").cast("decimal(28,2)"), gap))
    return _checks(one, rows)


def account_summary_consistency(left: DataFrame, right: DataFrame) -> DataFrame:
    from tickloom.operators.joins import compare_rows
    rows = compare_rows(left, right, ["account_id", "year", "month"],
                        ["balance_b_f", "balance_c_f", "client_equity"])
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "match").alias("bad"))
    return _checks(one, [check_row("account_summary_consistency",
                                   F.when(F.col("n") == 0, "SKIP").otherwise(_pass(F.col("bad") == 0)),
                                   "account_summary", F.col("n"), F.col("bad"), F.col("bad"))])


def date_gaps(rows: DataFrame, keys: list[str] | None = None, limit: int = 5, date: str = "trade_date") -> DataFrame:
    """Gaps over ``limit`` days between consecutive distinct dates, and the longest gap."""
    keys = keys or []
    days = rows.filter(F.col(date).isNotNull()).select(*keys, date).distinct()
    w = Window.partitionBy(*keys).orderBy(date) if keys else Window.partitionBy(F.lit(0)).orderBy(date)
    gap = F.datediff(date, F.lag(date).over(w))
    return days.withColumn("_gap", gap).groupBy(*keys).agg(
        F.count_if(F.col("_gap") > limit).alias("gaps"),
        F.coalesce(F.max("_gap"), F.lit(0)).alias("max_gap"))


def analysis_checks(trades: DataFrame, matched: DataFrame, summary: DataFrame) -> DataFrame:
    """P&L present, fee ratio, date continuity, pair coverage and P&L size as check rows."""
    k = F.lit(1).alias("_k")
    money = "decimal(28,4)"
    s = summary.agg(F.coalesce(F.sum(F.col("total_pnl").cast(money)), F.lit(0)).alias("acct_pnl"),
                    F.coalesce(F.sum(F.col("commission").cast(money)), F.lit(0)).alias("acct_fee"),
                    F.max(F.when(F.col("client_equity") > 0, F.col("client_equity"))).alias("max_equity"), k)
    limit = summary.agg(F.max(F.when(F.col("client_equity") > 0, F.col("client_equity")))).scalar()
    t = trades.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("offset_flag") == "open").alias("opens"),
                   F.coalesce(F.sum(F.col("commission").cast(money)), F.lit(0)).alias("fee"),
                   F.count_if(F.abs("total_pnl") > limit * 0.5).alias("extreme"), k)
    m = matched.agg(F.count(F.lit(1)).alias("matched"), k)
    g = date_gaps(trades).select("gaps", "max_gap", k)
    one = t.join(s, "_k").join(m, "_k").join(g, "_k")
    ratio = F.col("fee") / F.nullif(F.col("acct_fee"), F.lit(0))
    fee = F.when(F.col("acct_fee") == 0, "WARN").when((ratio < 0.5) | (ratio > 2.0), "FAIL") \
           .when(ratio > 1.0, "WARN").otherwise("PASS")
    cover = F.col("matched") / F.nullif(F.col("opens"), F.lit(0))
    return _checks(one, [
        check_row("pnl_data_exists", _pass((F.col("n") > 0) & (F.col("acct_pnl") != 0)), "trades and account summaries",
                  F.lit("a result other than 0"), F.col("n")),
        check_row("fee_consistency", fee, "commission", F.col("fee").cast("decimal(28,2)"),
                  F.col("acct_fee").cast("decimal(28,2)"),
                  F.abs(F.col("fee") - F.col("acct_fee")).cast("decimal(28,2)")),
        check_row("trade_date_continuity", F.when(F.col("n") == 0, "SKIP").otherwise(_pass(F.col("gaps") == 0, "WARN")),
                  "trade dates", F.lit("no pause above 5 days"), F.col("gaps"), F.col("gaps")),
        check_row("pair_coverage", F.when(F.col("opens") == 0, "SKIP").otherwise(_pass(cover >= 0.8, "WARN")),
                  "matches per opening trade", F.lit("at least 0.8"), F.col("matched"), F.round(cover, 4)),
        check_row("pnl_reasonableness", F.when(F.col("max_equity").isNull(), "SKIP")
                  .otherwise(_pass(F.col("extreme") == 0, "WARN")), "results against the highest equity",
                  F.lit("at most half of it"), F.col("extreme"), F.col("extreme"))])


def trading_rules(trades: DataFrame, matched: DataFrame, summary: DataFrame) -> DataFrame:
    """Business rules on trades, matches and account summaries."""
    k = F.lit(1).alias("_k")
    t = trades.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("volume") <= 0).alias("nonpos"),
                   F.count_if(F.coalesce(F.col("instrument"), F.lit("")) == "").alias("noname"),
                   F.coalesce(F.sum(F.when(F.col("offset_flag") == "open", F.col("volume"))), F.lit(0)).alias("open_vol"), k)
    m = matched.agg(F.coalesce(F.sum("open_volume"), F.lit(0)).alias("matched_vol"),
                    F.count(F.lit(1)).alias("matches"), F.max(F.abs("net_pnl")).alias("max_pnl"),
                    (F.sum(F.abs("net_pnl").cast("decimal(28,6)")).cast("double") / F.count("net_pnl")).alias("mean_pnl"), k)
    s = summary.agg(F.count(F.lit(1)).alias("periods"), k)
    one = t.join(m, "_k").join(s, "_k")
    return _checks(one, [
        check_row("trades_non_empty", _pass(F.col("n") > 0), "trades", F.lit("some rows"), F.col("n")),
        check_row("trades_positive_volume", _pass(F.col("nonpos") == 0), "trade volumes", F.lit("none at or below 0"), F.col("nonpos")),
        check_row("trades_contract_not_empty", _pass(F.col("noname") == 0), "trade instruments", F.lit("none empty"), F.col("noname")),
        check_row("trades_vs_matched_volume", _pass(F.col("matched_vol") <= F.col("open_vol"), "WARN"),
                  "opened and matched volume", F.col("open_vol"), F.col("matched_vol")),
        check_row("matched_trades_pnl", F.when(F.col("matches") == 0, "SKIP").otherwise("PASS"), "matches",
                  F.lit("some rows"), F.col("matches")),
        # The spread of absolute results is reported, not judged: mean as expected, maximum as actual.
        check_row("matched_trades_pnl_range", F.when(F.col("matches") == 0, "SKIP").otherwise("PASS"), "mean and largest result of a match",
                  F.round("mean_pnl", 2).cast("decimal(28,2)"), F.round("max_pnl", 2).cast("decimal(28,2)")),
        check_row("account_summary_populated", _pass(F.col("periods") > 0), "account summaries", F.lit("some rows"), F.col("periods"))])


def fund_balance_check(rows: DataFrame) -> DataFrame:
    """Verdict over the rows of ``fund_balance_rows``."""
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "fail").alias("bad"),
                   F.count_if(F.col("verdict") == "warn").alias("warned"))
    return _checks(one, [check_row("fund_balance_equation",
                                   F.when(F.col("n") == 0, "SKIP").otherwise(_pass(F.col("bad") == 0)),
                                   "account_summary", F.col("n"), F.col("bad"), F.col("bad"))])


def statement_field_presence(summaries: DataFrame) -> DataFrame:
    """Opening, closing and equity must be non-zero, one check row per file and field."""
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c), F.lit(0.0)).alias("actual"),
                              _pass(F.coalesce(F.col(c), F.lit(0.0)) != 0, "WARN").alias("status"))
                     for c in ("balance_bf", "balance_cf", "client_equity")])
    return summaries.select("file", F.inline(rows))


def parsed_statement_audit(files: DataFrame, summaries: DataFrame, transactions: DataFrame) -> DataFrame:
    """Per file: parsed or not, balance within 5 % and number of trades found."""
    n = transactions.groupBy("file").agg(F.count(F.lit(1)).alias("trades"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    want = (z("balance_bf") + z("deposit_withdrawal") + z("realized_pl") + z("mtm_pl") - z("commission")
            + z("premium_received") - z("premium_paid"))
    gap = F.abs(z("balance_cf") - want)
    return files.select("file").join(summaries, "file", "left").join(n, "file", "left").select(
        "file", F.col("client_id").isNotNull().alias("parsed"),
        F.when(F.col("client_id").isNull(), F.lit(None))
         .otherwise((z("balance_cf") == 0) | (gap <= F.abs(z("balance_cf")) * 0.05)).alias("balance_ok"),
        F.coalesce("trades", F.lit(0)).alias("trades"))


def verdict(checks: DataFrame) -> DataFrame:
    """Counts by status and the overall verdict of a report."""
    c = checks.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "WARN", "FAIL", "SKIP")])
    return c.withColumn("overall", F.when(F.col("fail") > 0, "UNRELIABLE").when(F.col("warn") > 0, "QUESTIONABLE")
                        .when(F.col("pass") > 0, "TRUSTWORTHY").otherwise("NO_DATA"))


def full_audit(parts: dict[str, DataFrame], scope: str = "all") -> DataFrame:
    """Union of the check frames of a scope, tagged with the scope they belong to."""
    chosen = [df.withColumn("scope", F.lit(name)) for name, df in parts.items() if scope in ("all", name)]
    return reduce(lambda a, b: a.unionByName(b), chosen)


# ------------------------------------------------------------------ monitoring aggregates

def quality_report(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    def mean(c):
        return F.sum(F.col(c).cast("decimal(20,4)")).cast("double") / F.nullif(F.count(c), F.lit(0))

    return metrics.groupBy(*(keys or ["source_name"])).agg(
        mean("quality_score").alias("avg_score"), F.sum("gap_count").alias("total_gaps"),
        F.sum("suspect_count").alias("total_suspects"), mean("delay_ms").alias("avg_delay"),
        F.countDistinct("symbol").alias("symbols_tracked"))


def symbol_heat(metrics: DataFrame) -> DataFrame:
    s = F.sum(F.col("quality_score").cast("decimal(20,4)")).cast("double") / F.count("quality_score")
    return metrics.groupBy("symbol").agg(s.alias("avg_score"), F.sum("suspect_count").alias("suspects")) \
                  .withColumn("heat", S.heat_band("avg_score"))


def failure_counts(failures: DataFrame, by: str, since=None) -> DataFrame:
    if since is not None:
        failures = failures.filter(F.col("failed_at") >= F.lit(since).cast("timestamp"))
    return failures.groupBy(by).agg(F.count(F.lit(1)).alias("failures"), F.max("failed_at").alias("last_failure"))


def table_stats(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Rows, columns and first / last valid date per table, one aggregate per table."""
    out = []
    for name, (df, date) in tables.items():
        d = S.normalize_date(date) if date else F.lit(None).cast("date")
        out.append(df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"),
                          F.lit(len(df.columns)).alias("column_count"),
                          F.min(d).alias("earliest"), F.max(d).alias("latest")))
    return reduce(lambda a, b: a.unionByName(b), out)


# ------------------------------------------------------------------ synchronisation windows

def sync_window(status: DataFrame, resolved: DataFrame, days: int = 365) -> DataFrame:
    """First and last date still to fetch per catalog.

    status: catalog_id, local_latest, remote_latest. Without local data the window is the last
    ``days`` days; otherwise it runs over the trading days after the local date.
    """
    after = F.broadcast(resolved.select(F.date_sub("trade_date", 1).alias("local_latest"), F.col("next_td").alias("_start")))
    upto = F.broadcast(resolved.select(F.col("trade_date").alias("remote_latest"), F.col("prev_td").alias("_end")))
    j = status.filter(F.col("remote_latest").isNotNull()) \
              .join(after, "local_latest", "left").join(upto, "remote_latest", "left")
    fresh = F.col("local_latest").isNull()
    start = F.when(fresh, F.date_sub("remote_latest", days)).otherwise(F.col("_start"))
    end = F.when(fresh, F.col("remote_latest")).otherwise(F.col("_end"))
    return j.withColumn("start_date", start).withColumn("end_date", end).drop("_start", "_end") \
            .filter(F.col("start_date") <= F.col("end_date"))


def sync_batches(windows: DataFrame, batch_days: int = 30) -> DataFrame:
    """Windows cut into batches of ``batch_days`` calendar days."""
    n = F.ceil((F.datediff("end_date", "start_date") + 1) / F.lit(batch_days)).cast("int")
    b = windows.withColumn("total_batches", n) \
        .select("catalog_id", "start_date", "end_date", "total_batches",
                F.explode(F.sequence(F.lit(0), F.col("total_batches") - 1)).alias("batch_index"))
    first = F.date_add("start_date", F.col("batch_index") * batch_days)
    return b.select("catalog_id", "batch_index", "total_batches", first.alias("batch_start"),
                    F.least(F.date_add(first, batch_days - 1), F.col("end_date")).alias("batch_end"))
