"""Structured Streaming forms: tokenise a document stream, mix it with a static synthetic corpus, and keep
running validity counters of a sample stream.

Each runs with ``trigger(availableNow=True)`` into a sink under the shared checkpoint folder and returns a batch read
of the sink. Sink and checkpoint location are new for every call, so a query started again begins from the first row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.functions import text as T
from seqlab.functions.draws import md5_key, u32
from seqlab.operators import corpus as X
from seqlab.operators import metrics as M
from seqlab.operators.generation import generation_samples
from seqlab.session import scratch_path
from seqlab.sources.tables import table_path


def read_stream(spark: SparkSession, sf_dir: str, table: str, cols: list[str],
                max_files: int | None = None) -> DataFrame:
    """`max_files` bounds a micro-batch; by default a batch takes all that has arrived. A table is one file or a folder of
    files. A stream reads folders: of a table that is one file, the folder it lies in, without the other files there."""
    path = table_path(sf_dir, table)
    schema = spark.read.parquet(path).select(*cols).schema
    reader = spark.readStream.format("parquet").schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.load(path).select(*cols)
    return reader.option("pathGlobFilter", f"{table}.parquet").load(sf_dir).select(*cols)


def run_append(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    out, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def run_complete(df: DataFrame, name: str) -> DataFrame:
    """Stateful aggregate in complete mode; each micro-batch overwrites the result table (idempotent by batch)."""
    spark = df.sparkSession
    out, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (df.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).outputMode("complete")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def stream_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_stream(spark, sf_dir, "documents", ["doc_id", "text"])
    n = T.ws_norm(F.col("text"))
    return run_append(docs.select("doc_id", T.n_tokens_norm(n).cast("int").alias("n_tokens"),
                                  n.alias("tokens_joined")), "stream-tokenize")


def stream_mix(spark: SparkSession, sf_dir: str, synthetic: DataFrame, n_synthetic: int,
               p: float = X.MIX_PROBABILITY) -> DataFrame:
    """Stateless stream form of mixing: each canonical row draws its geometric count of synthetic rows, and each
    draw picks a synthetic document by hash (a stream has no global running total, so no cyclic cursor)."""
    docs = read_stream(spark, sf_dir, "documents", ["doc_id", "text"])
    c = docs.select(F.col("doc_id").alias("canon_pos"), "text",
                    X.geometric_draws(F.col("doc_id"), p).alias("g"))
    canon = c.select("canon_pos", F.col("g").alias("slot"), F.lit("canonical").alias("source"),
                     F.lit(None).cast("long").alias("syn_pos"), "text")
    draws = c.filter(F.col("g") > 0).select(
        "canon_pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("slot"))
    key = F.concat_ws(":", F.col("canon_pos").cast("string"), F.col("slot").cast("string"))
    draws = draws.select("canon_pos", "slot", (u32(md5_key("pick", key)) % n_synthetic).alias("syn_pos"))
    syn = synthetic.select(F.col("doc_pos").alias("syn_pos"), "text")
    mixed = draws.join(syn, "syn_pos").select("canon_pos", "slot", F.lit("synthetic").alias("source"),
                                              "syn_pos", "text")
    return run_append(canon.unionByName(mixed), "stream-mix")


def stream_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_stream(spark, sf_dir, "events", ["event_id", "event_type", "props"])
    v = M.verdicts(generation_samples(ev))
    return run_complete(M.validity(v, M.RUN_KEYS), "stream-validity")
