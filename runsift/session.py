"""Spark sessions for local runs; on a cluster the session is given."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The streaming operators keep their state in this store.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: int | None = None, memory: str = "8g") -> SparkSession:
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("runsift")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.streaming.metricsEnabled", "false")
        # The projection of all families is longer than the JIT accepts (8000 bytes on HotSpot);
        # Spark then splits it instead of running it interpreted.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config(STATE_STORE, ROCKSDB)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table, in the folder of `spark.checkpoint.dir`, which driver
    and executors share. Where that is unset, a local session takes one below its warehouse, and
    any other one must set it: a folder of one machine is not seen by the others."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_table(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate to a new table in the shared folder and read it back: branches that
    need it scan compressed columns instead of repeating the work, and what is written outlives
    any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
