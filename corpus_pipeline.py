"""Corpus pipeline: quality classifier, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns of documents
(the last one returns pieces). Rejected documents go: quality scores under 0.7; of each near-duplicate group all but the
one of smallest doc_id; documents of which repeated passages leave nothing; documents that hold benchmark windows.
Repeated passages are cut out of the texts that stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.llm import decontaminate, near_dup, packing, quality_model, repeats
from seqlab.llm.common import row_key, scratch, ship


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, so that no operator's own column meets one of the same name."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *rest).alias("carried"))


def restored(df: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    return df.select(*[changed.get(c, F.col(c) if c in ("doc_id", "text") else F.col(f"carried.c{i}")).alias(c)
                       for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    w = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_model.scored(carried(docs), w, ("text", "carried"))
    return restored(scored.where(F.col("score") >= quality_model.KEEP), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    # one row of each component stays, that of the smallest doc_id; texts without words are components of their own
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    alone = F.when(F.col("root").isNull(), F.col("row"))
    keep = near_dup.groups(docs).groupBy("root", alone.alias("own")).agg(first.alias("first")).select("first.row")
    kept = carried(docs).withColumn("row", row_key()).join(keep, "row", "left_semi").dropDuplicates(["row"])
    return restored(kept, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    left = repeats.removed(carried(docs), texts=True).where("n_removed = 0 or trim(text) != ''")
    size = {}
    if "n_chars" in docs.columns:
        old = F.col(f"carried.c{docs.columns.index('n_chars')}")
        size = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(old)}
    return restored(left, docs, **size)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return restored(decontaminate.scan(carried(docs), items, spans=True).where("not contaminated"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages),
          ("benchmark decontamination", benchmark_passages), ("packing", packed)]

#: SQL can't express the classifier's training; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex[:12]}-{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
