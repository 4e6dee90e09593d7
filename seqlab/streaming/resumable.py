"""Streams that go on where they stopped: sinks and cursors with stable names, each row once also after a restart.

Everything of a stream lies under one folder that the caller names (on shared storage): Spark's checkpoint, the output and
the state kept beside it. A micro-batch may be run again after a failure; it has the same number and the same rows then, so
each sink writes under that number and replaces what a first try left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.operators import corpus as X


def run(df: DataFrame, base: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Take in all that has arrived since the last run under ``base``."""
    q = (df.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()


# ---- numbered versions of a small table ---------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions under ``path``, ascending."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [int(n[2:]) for n in names if n.startswith("v=")]
    return sorted(n for n in done if fs.exists(_fs(spark, f"{path}/v={n}/_SUCCESS")[1]))


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last version, or the last of a smaller number than ``before``."""
    some = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/v={some[-1]}") if some else None


def put(df: DataFrame, path: str, number: int) -> None:
    """Write version ``number``; versions older than the one before it go."""
    df.write.mode("overwrite").parquet(f"{path}/v={number}")
    spark = df.sparkSession
    for v in [v for v in versions(spark, path) if v < number][:-1]:
        fs, p = _fs(spark, f"{path}/v={v}")
        fs.delete(p, True)


# ---- sinks --------------------------------------------------------------------------------------------------------


def appended(df: DataFrame, base: str) -> DataFrame:
    """The rows of all batches so far, each once."""
    run(df, base, lambda batch, i: batch.write.mode("overwrite").parquet(f"{base}/out/batch={i}"))
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out").select(*df.columns)


def upserted(df: DataFrame, keys: list[str], base: str) -> DataFrame:
    """The last row of each key. ``df`` is a running aggregate; in update mode a batch holds the changed keys alone, which
    replace those of the version before."""
    spark = df.sparkSession

    def sink(batch: DataFrame, i: int) -> None:
        old = latest(batch.sparkSession, f"{base}/table", i)
        if old is not None:
            fresh = batch.select(*[F.col(k).alias(f"_{k}") for k in keys])
            same = None
            for k in keys:
                x = old[k].eqNullSafe(fresh[f"_{k}"])
                same = x if same is None else same & x
            batch = old.join(fresh, same, "left_anti").unionByName(batch)
        put(batch, f"{base}/table", i)

    run(df, base, sink, "update")
    out = latest(spark, f"{base}/table")
    return spark.createDataFrame([], df.schema) if out is None else out.select(*df.columns)


def mixed(canonical: DataFrame, synthetic: DataFrame, n_synthetic: int, base: str, p: float = X.MIX_PROBABILITY) -> DataFrame:
    """`corpus.mix_ratio` of a stream (pos, text) whose batches come in the order of their positions: the cursor into the
    synthetic documents goes on over batches and restarts.

    What is kept is one number, the draws made so far. It is written with the number of the batch and read from the one
    before, so a batch that runs again starts from where it started. Inside a batch the draws are totalled over range
    partitions; no task sees the whole batch."""
    spark = canonical.sparkSession

    def sink(batch: DataFrame, i: int) -> None:
        old = latest(batch.sparkSession, f"{base}/cursor", i)
        drawn = old.first()[0] if old is not None else 0
        X.mix_ratio(batch, synthetic, n_synthetic, p, drawn=drawn).write.mode("overwrite").parquet(f"{base}/out/batch={i}")
        here = batch.select(X.geometric_draws(F.col("pos"), p).alias("g")).agg(F.coalesce(F.sum("g"), F.lit(0)) + drawn)
        put(here.toDF("drawn"), f"{base}/cursor", i)

    run(canonical, base, sink)
    schema = "canon_pos long, slot long, source string, syn_pos long, text string"
    return spark.read.schema(schema).parquet(f"{base}/out").drop("batch")


def shuffled(df: DataFrame, pos_col: str, base: str, buffer: int = X.SHUFFLE_BUFFER) -> DataFrame:
    """`corpus.window_shuffle` of a stream: rows with the place they move to and its bucket of ``buffer`` places. Read bucket by
    bucket and sorted by (shuffle_at, shuffle_key) within, they are in the shuffled order; a bucket is complete once the
    stream has passed its end. No state is kept."""
    placed = X.window_keys(df, pos_col, buffer)
    return appended(placed.withColumn("bucket", F.expr(f"shuffle_at div {buffer}")), base)
