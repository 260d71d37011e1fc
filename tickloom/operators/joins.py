"""Join shapes Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ordered import BLOCK_ROWS, Scan, prefix_scan, row_blocks


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str,
              values: list[str], unit: str = "month", bounded: bool = False, rows: int = BLOCK_ROWS) -> DataFrame:
    """Attach the latest ``right`` row at or before each ``left`` row.

    Both sides are unioned and the last right row is carried forward, so there is no range join.
    Long keys are cut by time ``unit``, and a unit with more than ``rows`` rows by its row counts.
    ``bounded`` says that a key holds at most one row per day on each side, so one plain window per
    key is enough.
    Several right rows with one (key, time) resolve to the greatest value struct.
    """
    payload = F.struct(*[F.col(right_on).alias("_at"), *[F.col(v) for v in values]])
    right_rows = (right.groupBy(*keys, F.col(right_on).alias("_t"))
                       .agg(F.max(payload).alias("_right"))
                       .withColumn("_side", F.lit(0)))
    left_cols = left.columns
    left_rows = left.select(*keys, F.col(left_on).alias("_t"), F.lit(1).alias("_side"),
                            F.struct(*left_cols).alias("_left"))
    both = left_rows.unionByName(right_rows, allowMissingColumns=True)
    if bounded:
        w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
        filled = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(w))
    else:
        both = row_blocks(both, keys, "_t", unit, rows)
        filled = prefix_scan(both, keys, ["_block", "_part"], ["_t", "_side"],
                             [Scan("_hit", "last", F.col("_right"))])
    return (filled.filter(F.col("_left").isNotNull())
                  .select("_left.*", F.col("_hit._at").alias(f"{right_on}_asof"),
                          *[F.col(f"_hit.{v}").alias(v) for v in values]))


def live_on_date(dates: DataFrame, contracts: DataFrame, key: str, date: str = "trade_date",
                 code: str = "contract_code", start: str = "listing_date",
                 end: str = "delisting_date") -> DataFrame:
    """The most recently listed contract whose life covers the date, per key.

    A life becomes one row per day (an equi join), so no range condition is evaluated. Open
    ends stop at the last date asked for.
    """
    horizon = dates.agg(F.max(date)).scalar()
    lives = contracts \
        .withColumn("_last", horizon) \
        .withColumn("_end", F.least(F.coalesce(end, "_last"), F.col("_last"))) \
        .filter(F.col(start) <= F.col("_end")) \
        .select(key, code, start,
                F.explode(F.sequence(F.col(start), F.col("_end"), F.expr("interval 1 day")))
                 .alias(date))
    pick = lives.groupBy(key, date).agg(
        F.max_by(code, F.struct(start, code)).alias(code))
    return dates.join(pick, [key, date], "left")


def lookup(left: DataFrame, dim: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join to a dimension; AQE broadcasts it only when its measured size allows."""
    return left.join(dim, keys, how)


def missing_keys(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys with no actual row."""
    return expected.join(actual.select(*keys).distinct(), keys, "left_anti")


def common_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_semi")


def compare_rows(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str],
                 tolerance: float = 0.01) -> DataFrame:
    """Full outer row compare: ``status`` is match, mismatch, left_only or right_only."""
    a = left.select(*keys, *[F.col(f).alias(f"{f}_left") for f in fields],
                    F.lit(True).alias("_l"))
    b = right.select(*keys, *[F.col(f).alias(f"{f}_right") for f in fields],
                     F.lit(True).alias("_r"))
    differs = F.lit(False)
    for f in fields:
        gap = F.abs(F.coalesce(F.col(f"{f}_left"), F.lit(0)) - F.coalesce(F.col(f"{f}_right"), F.lit(0)))
        differs = differs | (gap > F.lit(tolerance))
    return (a.join(b, keys, "full")
             .withColumn("status", F.when(F.col("_l").isNull(), F.lit("right_only"))
                         .when(F.col("_r").isNull(), F.lit("left_only"))
                         .when(differs, F.lit("mismatch")).otherwise(F.lit("match")))
             .drop("_l", "_r"))
