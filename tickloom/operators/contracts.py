"""Contract master and main-contract series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sync_contract_master(current: DataFrame, incoming: DataFrame, key: str = "contract_code",
                         force: bool = False) -> DataFrame:
    """Merge a contract feed into the master: insert new, flag delisted, refresh when forced.

    Both frames carry the master's columns plus ``status``. Without ``force`` an existing active
    contract only takes over the delisting date (and becomes delisted) when the feed has one.
    """
    cols = [c for c in current.columns if c != key]
    old = current.select(key, F.struct(*cols).alias("_old"))
    new = incoming.select(key, F.struct(*[F.col(c) for c in cols if c in incoming.columns]).alias("_new"))
    have = {c for c in cols if c in incoming.columns}
    j = old.join(new, key, "full")
    is_new = F.col("_old").isNull()
    touched = F.col("_new").isNotNull()
    delisted = touched & F.col("_new.delisting_date").isNotNull() & (F.col("_old.status") == "active")
    out = []
    for c in cols:
        o = F.col(f"_old.{c}")
        n = F.col(f"_new.{c}") if c in have else F.lit(None)
        if c == "status":
            kept = F.when(touched, "active").otherwise(o) if force else F.when(delisted, "delisted").otherwise(o)
            out.append(F.when(is_new, F.lit("active")).otherwise(kept).alias(c))
        elif force:
            out.append(F.coalesce(n, o).alias(c))
        elif c == "delisting_date":
            out.append(F.when(is_new | delisted, n).otherwise(o).alias(c))
        else:
            out.append(F.when(is_new, n).otherwise(o).alias(c))
    action = F.when(is_new, "inserted")
    action = action.when(touched, "updated") if force else action.when(delisted, "updated")
    return j.select(key, *out, action.otherwise("unchanged").alias("sync_action"))


def expiring(contracts: DataFrame, ref, days: int = 30, date: str = "last_trade_date") -> DataFrame:
    r = F.lit(ref).cast("date")
    return contracts.filter((F.col("status") == "active")
                            & F.col(date).between(r, F.date_add(r, days)))


def mark_expired(contracts: DataFrame, ref, date: str = "last_trade_date") -> DataFrame:
    due = (F.col("status") == "active") & (F.col(date) <= F.lit(ref).cast("date"))
    return contracts.withColumn("status", F.when(due, "expired").otherwise(F.col("status")))


def auto_deactivate(catalog: DataFrame, ref) -> DataFrame:
    """Switch off symbols whose subscription ended before ``ref``."""
    over = (F.col("is_active") == 1) & (F.col("subscribe_until") < F.lit(ref).cast("date"))
    return catalog.withColumn("is_active", F.when(over, 0).otherwise(F.col("is_active")))


def retain_since(events: DataFrame, ref, days: int = 90, ts: str = "created_at") -> DataFrame:
    return events.filter(F.col(ts) >= F.date_sub(F.lit(ref).cast("date"), days))


def main_contracts(quotes: DataFrame, contracts: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Main contract per product and day: manual choice, else open interest, else volume.

    Equal values resolve to the smaller contract code.
    """
    dim = contracts.filter(F.col("status") == "active").select("contract_code", "product_code")
    j = quotes.join(dim, "contract_code")

    def leader(c):
        # min_by over the negated value keeps the smallest code among ties.
        return F.min_by("contract_code", F.when(F.col(c).isNotNull(), F.struct(-F.col(c), F.col("contract_code"))))

    out = j.groupBy("product_code", "trade_date").agg(
        leader("open_interest").alias("_oi"), leader("volume").alias("_vol"))
    pick, method = F.coalesce("_oi", "_vol"), F.lit("volume_oi")
    if manual is not None:
        out = out.join(manual.select("product_code", "trade_date", F.col("contract_code").alias("_manual")),
                       ["product_code", "trade_date"], "full")
        pick = F.coalesce("_manual", "_oi", "_vol")
        method = F.when(F.col("_manual").isNotNull(), "manual").otherwise("volume_oi")
    return out.select("product_code", "trade_date", pick.alias("contract_code"), method.alias("method")) \
              .filter(F.col("contract_code").isNotNull())


def auto_populate(quotes: DataFrame, contracts: DataFrame, existing: DataFrame) -> DataFrame:
    """New main-contract rows (by open interest) for days that have no mapping yet."""
    fresh = main_contracts(quotes.filter(F.col("open_interest").isNotNull()), contracts)
    return fresh.join(existing.select("product_code", "trade_date"), ["product_code", "trade_date"], "left_anti")


def rollovers(series: DataFrame) -> DataFrame:
    """Days the main contract differs from the day before; one row per product and day."""
    w = Window.partitionBy("product_code").orderBy("trade_date")
    return series.withColumn("from_contract", F.lag("contract_code").over(w)) \
        .filter(F.col("from_contract") != F.col("contract_code")) \
        .select("product_code", "trade_date", "from_contract", F.col("contract_code").alias("to_contract"))
