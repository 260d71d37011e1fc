"""Order-dependent work on keys of any size.

A window partitioned only by key puts the whole key into one task. When a key may hold a
third of all rows that task never finishes, so the operators that run over raw rows (trades,
ticks) use a two-level scan instead:

1. every key is cut into ordered blocks of bounded size (a column the caller derives from the
   data: an id range, a volume range, a time unit cut further by row counts);
2. the scan runs inside each (key, block) - many small tasks;
3. one summary row per (key, block), pre-aggregated before its shuffle, is scanned per key;
4. the summary is joined back as the carry into each block.

Daily frames keyed by (contract, date) need none of this: a key holds at most one row per
calendar day, so plain windows are bounded there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scan:
    """One running value: kind is ``sum``, ``max`` or ``last`` (last non-null)."""

    name: str
    kind: str
    value: Column
    inclusive: bool = True


def _aggregate(kind: str, value: Column) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "max":
        return F.max(value)
    return F.last(value, ignorenulls=True)


def prefix_scan(df: DataFrame, keys: list[str], block: list[str], order: list[str],
                scans: list[Scan]) -> DataFrame:
    """Add running values over ``order`` within ``keys``; ``block`` must sort like ``order``."""
    group = keys + block
    rows = Window.partitionBy(*group).orderBy(*order)
    inclusive = rows.rowsBetween(Window.unboundedPreceding, 0)
    exclusive = rows.rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumns({
        f"_local_{s.name}": _aggregate(s.kind, s.value).over(inclusive if s.inclusive else exclusive)
        for s in scans})

    totals = []
    for s in scans:
        if s.kind == "last":
            # A single order column stays a plain value, which keeps this a hash aggregate.
            at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
            present = F.when(s.value.isNotNull(), at)
            totals.append(F.max_by(s.value, present).alias(f"_total_{s.name}"))
        else:
            totals.append(_aggregate(s.kind, s.value).alias(f"_total_{s.name}"))
    before = Window.partitionBy(*keys).orderBy(*block) \
                   .rowsBetween(Window.unboundedPreceding, -1)
    carry = (df.groupBy(*group).agg(*totals)
               .select(*group, *[_aggregate(s.kind, F.col(f"_total_{s.name}")).over(before)
                                 .alias(f"_carry_{s.name}") for s in scans]))

    joined = local.join(carry, group, "left")
    merged = {}
    for s in scans:
        here, prior = F.col(f"_local_{s.name}"), F.col(f"_carry_{s.name}")
        if s.kind == "sum":
            zero = F.lit(0)
            merged[s.name] = F.coalesce(here, zero) + F.coalesce(prior, zero)
        elif s.kind == "max":
            merged[s.name] = F.greatest(here, prior)
        else:
            merged[s.name] = F.coalesce(here, prior)
    drop = [c for s in scans for c in (f"_local_{s.name}", f"_carry_{s.name}")]
    return joined.withColumns(merged).drop(*drop)


def id_block(id_col: str, rows: int) -> Column:
    """Block number that holds at most ``rows`` distinct ids."""
    return F.floor(F.col(id_col) / F.lit(rows)).cast("bigint")


#: Rows that a block may hold.
BLOCK_ROWS = 1 << 20
#: Slices in which the rows of a time block are counted where it has to be cut.
SLICES = {"hour": "second", "day": "second", "month": "minute"}


def row_blocks(df: DataFrame, keys: list[str], ts_col: str, unit: str = "hour",
               rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_block`` (the time unit) and ``_part``; (key, _block, _part) holds at most ``rows``
    rows and one slice, and sorts like ``ts_col``.

    Rows are counted per key and slice, combined before the shuffle. Only units with more than
    ``rows`` rows of a key get cuts, so the table that is joined back is small and mostly empty;
    AQE broadcasts it by its measured size.
    """
    unit_of, slice_of = F.date_trunc(unit, F.col(ts_col)), F.date_trunc(SLICES[unit], F.col(ts_col))
    order = Window.partitionBy(*keys, "_block").orderBy("_slice")
    counted = df.groupBy(*keys, unit_of.alias("_block"), slice_of.alias("_slice")).agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_in", F.floor((F.sum("_n").over(order) - F.col("_n")) / F.lit(rows)))
    starts = counted.groupBy(*keys, "_block", "_in").agg(F.min("_slice").alias("_start")).filter("_in > 0")
    cuts = starts.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list("_start")).alias("_cuts"))
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= slice_of)), F.lit(0))
    return df.withColumn("_block", unit_of).join(cuts, [*keys, "_block"], "left") \
        .withColumn("_part", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(part)).drop("_cuts")


#: Blocks that the values of a key may be cut into.
CUTS = 1024


def exact_quantiles(df: DataFrame, keys: list[str], value: str,
                    fractions: dict[str, float], rows: int = BLOCK_ROWS) -> DataFrame:
    """Nearest-rank quantiles ``sorted[int(n * p)]`` per key, exact and without collecting a key.

    Values are counted first (hot values collapse to one row), blocked between approximate
    quantiles of the key, and the running count comes from the two-level scan. The number of blocks
    follows from the number of distinct values, about ``rows`` in each (with more than ``CUTS`` times
    as many, the blocks grow in proportion).
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value) \
                .agg(F.count(F.lit(1)).alias("_n"))
    cuts = counted.groupBy(*keys).agg(
        F.percentile_approx(value, [i / CUTS for i in range(1, CUTS)], CUTS * 8).alias("_grid"),
        F.least(F.ceil(F.count(F.lit(1)) / F.lit(rows)), F.lit(CUTS)).alias("_parts")).filter("_parts > 1")
    at = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda i: F.floor(i * CUTS / F.col("_parts")))
    cuts = cuts.select(*keys, F.transform(at, lambda i: F.get("_grid", i - 1)).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda c: c <= F.col(value)))
    blocked = counted.join(cuts, keys, "left") \
        .withColumn("_block", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(below)).drop("_cuts")
    ranked = prefix_scan(blocked, keys, ["_block"], [value],
                         [Scan("_upto", "sum", F.col("_n"))])
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ranked = ranked.join(totals, keys)
    picks = []
    for name, p in fractions.items():
        target = F.floor(F.col("_total") * F.lit(p))
        picks.append(F.min(F.when(F.col("_upto") > target, F.col(value))).alias(name))
    return ranked.groupBy(*keys).agg(*picks)
