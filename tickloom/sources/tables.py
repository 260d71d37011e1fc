"""Parquet tables: partitioned writes, upserts and verification.

Plain Parquet has no row-level update, so upserts rewrite the partitions they touch: the merged
rows of those partitions are written with dynamic partition overwrite. The touched partition values
(one per day or bucket of the batch) are found first, so only those folders are read back.

Commit: merged rows go to a staging folder of their own, then each touched partition is replaced.
Writers of one table must not overlap; after a failure in the second step the same batch is run
again, which gives the same table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.operators.query import latest_per_key


def with_partitions(df: DataFrame, by: str) -> DataFrame:
    """Add the partition column: ``year`` from the trade date, or the date itself."""
    return df.withColumn("year", F.year("trade_date")) if by == "year" else df


def write_partitioned(df: DataFrame, path: str, by: str = "trade_date", mode: str = "append",
                      sort: list[str] | None = None) -> None:
    """Time-partitioned columnar write.

    Rows of one partition value may be spread over many tasks (each writes its own file), so a hot
    day is not funnelled through one writer. ``sort`` clusters rows inside each file for min/max
    pruning.
    """
    out = with_partitions(df, by)
    out = out.sortWithinPartitions(by, *(sort or []))
    out.write.mode(mode).partitionBy(by).parquet(path)


def read_range(spark: SparkSession, path: str, schema: StructType | None = None, start=None, end=None,
               by: str = "trade_date") -> DataFrame:
    """Partition-pruned read of a date range."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    if by == "year":
        if start is not None:
            df = df.filter(F.col("year") >= F.year(F.lit(start).cast("date")))
        if end is not None:
            df = df.filter(F.col("year") <= F.year(F.lit(end).cast("date")))
    if start is not None:
        df = df.filter(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("trade_date") <= F.lit(end).cast("date"))
    return df


# ------------------------------------------------------------------ merge semantics (pure)

def merge_last_wins(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows replace existing ones; among incoming duplicates the last by ``order`` wins."""
    fresh = latest_per_key(incoming, keys, order)
    kept = existing.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh.select(*[c for c in fresh.columns if c in existing.columns]),
                            allowMissingColumns=True)


def merge_newest(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The greatest row by ``order`` of both sides; on a tie the incoming one."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)),
                                                              allowMissingColumns=True)
    return latest_per_key(both, keys, [*order, "_side"]).drop("_side")


def merge_first_wins(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to append: keys the target does not have yet, first by ``order`` among duplicates."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")) \
                    .select(*keys, "_row.*")
    return first.join(existing.select(*keys), keys, "left_anti")


def replace_groups(existing: DataFrame, incoming: DataFrame, group: list[str]) -> DataFrame:
    """Incoming groups replace whole existing groups (all members of a contract on a day)."""
    kept = existing.join(incoming.select(*group).distinct(), group, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def latest_day(df: DataFrame, date: str = "trade_date") -> DataFrame:
    return df.filter(F.col(date) == df.agg(F.max(date)).scalar())


# ------------------------------------------------------------------ writers

def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


#: Partition columns that follow from a key column.
DERIVED = {"year": "trade_date"}


def check_keys(keys: list[str], by: str, derived_from: str | None = None) -> None:
    """A key must fix its partition, else one key could live in two partitions."""
    source = derived_from or DERIVED.get(by, by)
    if source not in keys:
        raise ValueError(f"key {keys} does not hold the partition column {source}")


def touched(spark: SparkSession, path: str, incoming: DataFrame, by: str) -> DataFrame:
    """Existing rows of the partitions the batch touches, by a literal partition filter."""
    values = [r[0] for r in incoming.select(by).distinct().collect()]  # one value per partition of the batch
    known = F.col(by).isin([v for v in values if v is not None])
    return spark.read.parquet(path).filter(known | F.col(by).isNull() if None in values else known)


def _overwrite(df: DataFrame, spark: SparkSession, path: str, by: str) -> None:
    """Replace the partitions present in ``df``.

    The frame reads from the folder it replaces, so it is written to a staging folder of this run
    first; a lost executor then only re-runs tasks against files that are still there.
    """
    staging = f"{path.rstrip('/')}__staging_{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(staging)
    spark.read.schema(df.schema).parquet(staging).select(*df.columns).write.mode("overwrite") \
         .option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(staging)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def upsert(spark: SparkSession, incoming: DataFrame, path: str, keys: list[str], order: list[str],
           by: str = "trade_date", derived_from: str | None = None, newest: bool = False) -> None:
    """Incoming rows win on the key, rewriting only touched partitions; repeating it changes nothing.

    ``newest`` compares the order columns of both sides and keeps the greatest row instead, so a
    late batch cannot replace a newer row.
    """
    check_keys(keys, by, derived_from)
    incoming = with_partitions(incoming, by)
    if not _exists(spark, path):
        latest_per_key(incoming, keys, order).write.partitionBy(by).parquet(path)
        return
    merge = merge_newest if newest else merge_last_wins
    _overwrite(merge(touched(spark, path, incoming, by), incoming, keys, order), spark, path, by)


def append_new(spark: SparkSession, incoming: DataFrame, path: str, keys: list[str], order: list[str],
               by: str = "trade_date") -> None:
    """First write wins: only keys not yet stored are appended."""
    check_keys(keys, by)
    incoming = with_partitions(incoming, by)
    if not _exists(spark, path):
        merge_first_wins(incoming.limit(0), incoming, keys, order).write.partitionBy(by).parquet(path)
        return
    old = touched(spark, path, incoming, by)
    merge_first_wins(old, incoming, keys, order).write.mode("append").partitionBy(by).parquet(path)


def replace(spark: SparkSession, incoming: DataFrame, path: str, group: list[str], by: str = "trade_date") -> None:
    incoming = with_partitions(incoming, by)
    if not _exists(spark, path):
        incoming.write.partitionBy(by).parquet(path)
        return
    _overwrite(replace_groups(touched(spark, path, incoming, by), incoming, group), spark, path, by)


def copy_latest_day(spark: SparkSession, source: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    upsert(spark, latest_day(source), path, keys, order)


def archive_before(df: DataFrame, path: str, ref, days: int = 30, date: str = "trade_date") -> None:
    """Rows older than ``days`` before ``ref`` to a date-partitioned archive. Each day is replaced
    as a whole, so running it again changes nothing."""
    old(df, ref, days, date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(date).parquet(path)


def move_to_archive(spark: SparkSession, path: str, archive: str, ref, days: int = 30,
                    date: str = "trade_date") -> DataFrame:
    """Moves the old days of a date-partitioned table into an archive: copy, compare, then drop.

    No step undoes another, so a run that failed anywhere is simply run again: days still in the
    table are copied once more (each replaces itself), the copy is compared with its source row by
    row, and only days that were compared without a difference are dropped from the table. Days that
    an earlier run has already dropped stay in the archive. Returns the comparison.
    """
    table = spark.read.parquet(path)
    rows = old(table, ref, days, date)
    # One value per old day that is still in the table; file names alone answer it.
    moved = [r[0] for r in rows.select(date).distinct().collect()]
    archive_before(table, archive, ref, days, date)
    if not moved:
        return verify_copy(rows, rows)
    copy = spark.read.parquet(archive).filter(F.col(date).isin(moved))
    found = verify_copy(rows, copy).collect()
    if found[0].missing_rows or found[0].extra_rows:
        raise RuntimeError(f"archive differs from its source: {found[0]}")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for day in moved:
        folder = fs_path(f"{path.rstrip('/')}/{date}={day}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return spark.createDataFrame(found)


def old(df: DataFrame, ref, days: int = 30, date: str = "trade_date") -> DataFrame:
    return df.filter(F.col(date) < F.date_sub(F.lit(ref).cast("date"), days))


# ------------------------------------------------------------------ migration and verification

# Columns of the unified tables and the legacy names they may come from.
LEGACY_NAMES = {
    "contract_code": ["instrument_id", "instrument"], "open": ["open_price"], "high": ["high_price"], "low": ["low_price"],
    "close": ["close_price"], "settle": ["settlement_price"], "prev_settle": ["pre_settle", "pre_settlement"],
    "daily_change": ["change"], "daily_change_pct": ["change_pct"], "trade_date": ["date"],
    "member_id": ["institution_id"], "net_change": ["net_position"],
}


def source_of(target: str, available: list[str]) -> str | None:
    """The column that fills a target field: its own name, else the first legacy name that exists."""
    return next((c for c in [target, *LEGACY_NAMES.get(target, [])] if c in available), None)


def migrate(source: DataFrame, target: StructType, keys: list[str], order: list[str],
            defaults: dict[str, object] | None = None) -> DataFrame:
    """Legacy rows in the target layout: mapped columns, defaults for the rest, first row per key."""
    fallback = defaults or {}
    filled = {f.name: source_of(f.name, source.columns) for f in target.fields}
    shaped = source.select(
        *[(F.col(filled[f.name]) if filled[f.name] else F.lit(fallback.get(f.name))).cast(f.dataType).alias(f.name)
          for f in target.fields], F.struct(*order).alias("_order"))
    rest = [n for n in target.fieldNames() if n not in keys]
    first = shaped.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_order").alias("_row"))
    return first.select(*keys, "_row.*").select(*target.fieldNames())


def verify_copy(source: DataFrame, target: DataFrame) -> DataFrame:
    """Row counts of both sides and how many rows differ, comparing every row."""
    cols = source.columns
    s = source.select(*cols).withColumn("_side", F.lit(1))
    t = target.select(*cols).withColumn("_side", F.lit(-1))
    per_row = s.unionByName(t).groupBy(*cols).agg(
        F.count_if(F.col("_side") == 1).alias("_s"), F.count_if(F.col("_side") == -1).alias("_t"))
    return per_row.agg(
        F.coalesce(F.sum("_s"), F.lit(0)).alias("source_rows"), F.coalesce(F.sum("_t"), F.lit(0)).alias("target_rows"),
        F.coalesce(F.sum(F.greatest(F.col("_s") - F.col("_t"), F.lit(0))), F.lit(0)).alias("missing_rows"),
        F.coalesce(F.sum(F.greatest(F.col("_t") - F.col("_s"), F.lit(0))), F.lit(0)).alias("extra_rows"))
