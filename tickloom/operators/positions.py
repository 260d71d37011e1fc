"""Member position rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unpivot_ranking(wide: DataFrame) -> DataFrame:
    """One row per side from a ranking row that lists both sides next to each other.

    Input columns: trade_date, contract_code, rank, long_member, long_volume, long_change,
    short_member, short_volume, short_change.
    """
    def side(name):
        return F.struct(F.lit(name).alias("side"), F.col(f"{name}_member").alias("member_name"),
                        F.col(f"{name}_volume").alias("volume"), F.col(f"{name}_change").alias("volume_change"))

    return wide.select("trade_date", "contract_code", "rank", F.inline(F.array(side("long"), side("short")))) \
               .filter(F.coalesce(F.col("member_name"), F.lit("")) != "")


def merge_by_rank(sides: DataFrame) -> DataFrame:
    """Long and short row of the same rank on one row (member of the long side)."""
    def pick(side, c):
        return F.max(F.when(F.col("side") == side, F.col(c)))

    return sides.groupBy("trade_date", "contract_code", "rank").agg(
        F.coalesce(pick("long", "member_name"), F.lit("")).alias("member_name"),
        *[F.coalesce(pick(s, c), F.lit(0)).alias(f"{s}_{c.replace('volume_', '')}")
          for s in ("long", "short") for c in ("volume", "volume_change")])


def merge_by_member(sides: DataFrame) -> DataFrame:
    """Long and short volume of the same member on one row."""
    def pick(side, c):
        return F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c))), F.lit(0))

    return sides.groupBy("trade_date", "contract_code", "member_name").agg(
        F.min(F.when(F.col("side") == "long", F.col("rank"))).alias("long_rank"),
        F.min(F.when(F.col("side") == "short", F.col("rank"))).alias("short_rank"),
        pick("long", "volume").alias("long_volume"), pick("short", "volume").alias("short_volume"),
        pick("long", "volume_change").alias("long_change"),
        pick("short", "volume_change").alias("short_change"))


def contract_position_summary(positions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Members, long / short totals, net and the largest member of each side."""
    keys = keys or ["trade_date", "contract_code"]

    def top(c):
        return F.min_by("member_name", F.struct(-F.col(c), F.col("member_name")))

    return positions.groupBy(*keys).agg(
        F.count("member_name").alias("member_count"), F.sum("long_volume").alias("total_long"),
        F.sum("short_volume").alias("total_short"),
        top("long_volume").alias("top_long_member"), top("short_volume").alias("top_short_member")) \
        .withColumn("total_net", F.col("total_long") - F.col("total_short"))


def feature_daily(positions: DataFrame) -> DataFrame:
    """Daily contract features: top members, net flow, side shares and sentiment in -1..1."""
    s = contract_position_summary(positions)
    tops = positions.groupBy("trade_date", "contract_code").agg(
        F.max("long_volume").alias("top_long_volume"), F.max("short_volume").alias("top_short_volume"))
    both = F.col("total_long") + F.col("total_short")
    return s.join(tops, ["trade_date", "contract_code"]).withColumns({
        "oi_ratio": F.col("total_long") / F.nullif(F.col("total_short"), F.lit(0)),
        "net_institutional_flow": F.col("total_net"),
        "long_institutional_pct": F.col("total_long") / F.nullif(both, F.lit(0)),
        "short_institutional_pct": F.col("total_short") / F.nullif(both, F.lit(0)),
        "sentiment_score": F.col("total_net") / F.nullif(both, F.lit(0))})


def top_holders(positions: DataFrame, limit: int = 20, keys: list[str] | None = None) -> DataFrame:
    """Largest members per contract and day on each side (the top-k report itself).

    Spark keeps only ``limit`` rows per group before the shuffle of a ranked window.
    """
    keys = keys or ["trade_date", "contract_code"]
    sides = positions.select(*keys, "member_name", F.inline(F.array(
        F.struct(F.lit("long").alias("side"), F.col("long_volume").alias("volume")),
        F.struct(F.lit("short").alias("side"), F.col("short_volume").alias("volume")))))
    w = Window.partitionBy(*keys, "side").orderBy(F.desc("volume"), "member_name")
    return sides.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def top_members(positions: DataFrame, limit: int = 20) -> DataFrame:
    """Members of a day ranked by summed volume, each side."""
    totals = positions.groupBy("trade_date", "member_name").agg(
        F.sum("long_volume").alias("long_volume"), F.sum("short_volume").alias("short_volume"))
    return top_holders(totals, limit, ["trade_date"])
