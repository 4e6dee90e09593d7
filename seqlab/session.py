"""Session construction and the shared scratch folder.

On a cluster the scratch folder is the one named by ``spark.checkpoint.dir`` (shared storage visible to every
executor). Only when it is unset -- local runs and tests -- do we create one under /tmp and register it.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession


def get_session(cpus: int | str | None = None, app: str = "seqlab", shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS") or "8"
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", "16g")
         # Wide generated projections exceed HotSpot's 8000-byte JIT limit; without this flag they would run in
         # the bytecode interpreter (10x+ slower per row). Executors get the same flag on a cluster.
         .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
         .config("spark.executor.extraJavaOptions", "-XX:-DontCompileHugeMethods"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_base(spark: SparkSession) -> str:
    base = spark.sparkContext.getCheckpointDir()
    if base:
        return base
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return conf
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # Unset: local run or test. Create a private folder and register it so checkpoint() works too.
    local = tempfile.mkdtemp(prefix="seqlab-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder for a written intermediate table or sink."""
    base = _checkpoint_base(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Write ``df`` to the shared checkpoint folder and continue from the written copy (reliable checkpoint:
    cuts lineage, survives executor loss, and separates expensive generation from what reads it)."""
    from pyspark import StorageLevel
    _checkpoint_base(df.sparkSession)
    # Persist first: a reliable checkpoint otherwise recomputes the whole lineage in a second job to write it.
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = kept.checkpoint(eager=True)
    kept.unpersist()
    return out


def written(df, name: str):
    """Write ``df`` to the shared checkpoint folder as a table and read it again. Its columns are compressed, so it takes a
    fraction of a checkpoint's disk, and none of it is kept in memory."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs: Spark deletes them once the driver has collected its garbage. Python's objects
    and finished jobs are let go by other threads, so once is not enough."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()
