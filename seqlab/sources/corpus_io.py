"""Corpus and result scans/sinks: JSON lines corpora, nested JSON result documents, comparison reports.

Sinks write to the shared scratch folder (``spark.checkpoint.dir``); scans read with explicit schemas (no
inference pass) and ``FAILFAST`` so a malformed line fails the job instead of silently becoming nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = ("rule string, total long, valid long, validity_rate double, lenient_valid long, "
                 "lenient_validity_rate double, by_prompt map<string, struct<total: long, valid: long, "
                 "validity_rate: double>>")
EXAMPLES_SCHEMA = ("rule string, variant string, step int, n_samples long, valid long, validity_rate double, "
                   "examples map<string, array<struct<rn: int, id: long, prompt: string, extracted: string>>>")
REPORT_SCHEMA = ("grammar string, models map<string, struct<validity_rate: double, generation_validity: double, "
                 "valid: long, total: long, perplexity_gap: double, completion_accuracy: double>>")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def scan_jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """JSON-lines corpus scan: blank lines are skipped by the reader, malformed lines fail the job, and so does a document
    without one of the ``required`` fields."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return needed(df, *required)


def needed(df: DataFrame, *columns: str, says: str = "missing field") -> DataFrame:
    """``df``; reading a row whose column is null raises."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{says}: {c}"))).otherwise(F.col(c)))
    return df


def looked_up(keys: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """Each row of ``keys`` with its row of ``values``; a key without one raises, with its name in the message."""
    met = keys.join(values.withColumn("_there", F.lit(True)), on, "left")
    name = F.concat(F.lit("no entry: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on]))
    there = F.when(F.col("_there").isNull(), F.raise_error(name)).otherwise(F.col("_there"))
    return met.withColumn("_there", there).where("_there").drop("_there")


def write_results(results: DataFrame, path: str, by: str = "model") -> None:
    """One result document per model, stored under ``<by>=<name>`` (the model name travels in the path)."""
    results.write.mode("overwrite").partitionBy(by).json(path)


def scan_results(spark: SparkSession, path: str, schema: str = RESULT_SCHEMA, by: str = "model") -> DataFrame:
    """Globbed result scan; the model name is the partition that a file lies in, not part of the document."""
    df = spark.read.schema(f"{schema}, `{by}` string").option("mode", "FAILFAST").json(path)
    return df.select(by, *[c for c in df.columns if c != by])


def scan_report(spark: SparkSession, path: str) -> DataFrame:
    """Comparison reports keyed by model name (a map, never inferred as a struct), exploded to rows."""
    df = spark.read.schema(REPORT_SCHEMA).option("mode", "FAILFAST").json(path)
    return df.select("grammar", F.explode("models").alias("model", "m")).select(
        "grammar", "model", F.coalesce(F.col("m.validity_rate"), F.col("m.generation_validity")).alias(
            "validity_rate"), "m.valid", "m.total")
