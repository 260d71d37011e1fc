"""SparkSession defaults.

On a cluster the settings come from spark-submit; ``build_session`` only fills
in what the analytics rely on and never overrides a value already set.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed join keys even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "tickloom", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | None = None, app_name: str = "tickloom") -> SparkSession:
    """Session for tests and the local benchmark."""
    cores = cores or os.cpu_count() or 4
    return build_session(app_name, f"local[{cores}]", {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "12g"),
    })


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and typed state need this state store; set here where a session has another one."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, for frames that one plan uses many times."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a local session gets a folder of its own; a cluster session gets an error,
    because no folder of one machine is seen by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tickloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
