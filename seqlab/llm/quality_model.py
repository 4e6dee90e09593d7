"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Units of a text are runs of letters and digits and runs of symbols. Features: units, pairs of neighbouring units, and
pairs of unit shapes (upper, title, lower, symbol; marked if a unit repeats the one before). Each kind is hashed to
2**BITS buckets, with its share among the text's features of that kind as value, so long texts weigh no more than short ones.

Training reads at most `sample` labelled rows, those with the smallest hash of doc_id (a documented bound; more labels
than that add little to a linear model). They are dealt to `shards` tasks; in each round every task runs FTRL-Proximal
over its rows from the common state, and the states are averaged. Scores are sparse dot products in numpy.

Defined results: null or empty text has the bias alone. Rows whose crc32(doc_id as text) mod 4 is 2 are held out; a null
doc_id counts as the empty text. Several labels of one doc_id: the smallest. Labels null or of unknown documents take no
part. Without any label the score is 0.5. Repeated rows each give a row; further columns of any name are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from seqlab.llm.common import ALNUM, NONSPACE, RangeHash, documents, LOWER, mix, only, pieces, scratch, staged

BITS, SAMPLE, SHARDS, ROUNDS = 18, 16384, 4, 3
ALPHA, BETA, L1, L2, SCALE, KEEP = 0.5, 1.0, 0.02, 0.01, 12.0, 0.7
_KIND = np.zeros(256, np.int8)
_KIND[NONSPACE] = 2
_KIND[ALNUM | np.array([65 <= b <= 90 for b in range(256)])] = 1


def features(texts: list[bytes]):
    """(text, bucket, value) of every feature, the texts' features in turn."""
    blob = b"\n".join(texts) + b"\n"
    a = np.frombuffer(blob, np.uint8)
    kind = _KIND[a]
    edge = np.flatnonzero(np.diff(kind, prepend=0, append=0) != 0)
    starts, ends = edge[:-1], edge[1:]
    real = kind[np.minimum(starts, len(a) - 1)] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    owner = np.searchsorted(offsets, starts, side="right") - 1
    h = RangeHash(np.frombuffer(blob.translate(LOWER), np.uint8))(starts, ends)
    caps = np.concatenate([[0], np.cumsum((a >= 65) & (a <= 90))])
    n_caps = caps[ends] - caps[starts]
    first = (a[starts] >= 65) & (a[starts] <= 90) if len(starts) else np.zeros(0, bool)
    shape = np.where(kind[starts] == 2, 3, np.where(n_caps > 1, 0, np.where(first, 1, 2))).astype(np.uint64) if len(starts) else np.zeros(0, np.uint64)
    follows = np.concatenate([[False], owner[1:] == owner[:-1]]) if len(owner) else np.zeros(0, bool)
    back = lambda x, k=1: np.concatenate([np.zeros(min(k, len(x)), x.dtype), x[:-k]])
    same = ((h == back(h)) & follows) | ((h == back(h, 2)) & (owner == back(owner, 2)))
    pair = mix(back(h) * np.uint64(3) + h)[follows]
    shapes = mix(np.uint64(7) + back(shape) * np.uint64(8) + shape * np.uint64(64) + same.astype(np.uint64))[follows]
    out = []
    for salt, (who, what) in enumerate(((owner, h), (owner[follows], pair), (owner[follows], shapes))):
        bucket = (mix(what + np.uint64(salt)) >> np.uint64(64 - BITS)).astype(np.int64)
        key, n = np.unique(who * (1 << BITS) + bucket, return_counts=True)
        who = key >> BITS
        total = np.bincount(who, weights=n, minlength=len(texts))
        out.append((who, key & ((1 << BITS) - 1), SCALE * n / total[who]))
    who, bucket, value = (np.concatenate(x) for x in zip(*out, strict=True))
    by = np.argsort(who, kind="stable")
    return who[by], bucket[by], value[by]


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(rows, z: np.ndarray, n: np.ndarray) -> None:
    """One pass of FTRL-Proximal; the last cell is the bias."""
    for bucket, value, y in rows:
        b, v = np.append(bucket, len(z) - 1), np.append(value, 1.0)
        b, inverse = np.unique(b, return_inverse=True)
        v = np.bincount(inverse, weights=v)
        w = weights(z[b], n[b])
        p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
        g = (p - y) * v
        sigma = (np.sqrt(n[b] + g * g) - np.sqrt(n[b])) / ALPHA
        z[b] += g - sigma * w
        n[b] += g * g


def remainder(name: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % 4


def epoch(state, seed: int):
    """One round over a shard's rows (one partition, `sample` rows at most), from the common state."""
    def task(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("key", "ascending")])
        ids = table.column("doc_id").to_numpy()
        once = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))  # of repeated rows of a document the first
        z, n = (x.copy() for x in state.value)
        y, b, v = (table.column(c).combine_chunks() for c in ("quality", "bucket", "value"))
        order = map(int, np.random.RandomState(seed).permutation(once))
        ftrl(((b[j].values.to_numpy(), v[j].values.to_numpy(), y[j].as_py()) for j in order), z, n)
        yield pa.RecordBatch.from_pydict({"z": pa.array([z.astype("<f4").tobytes()]), "n": pa.array([n.astype("<f4").tobytes()])})

    return task


def apart(spark: SparkSession, parts: DataFrame) -> list[Row]:
    """Rows of a union of single partitions, each in a task of its own; by default Spark zips those into one task."""
    name = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        return parts.collect()
    finally:
        spark.conf.set(name, before)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shards: int = SHARDS, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of 2**BITS buckets and the bias."""
    size = (1 << BITS) + 1
    marked = (only(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").where(remainder() != 2)
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # broadcast: `sample` rows at most
    rows = (only(docs, "doc_id", "text").join(F.broadcast(staged(marked, "quality-marked")), "doc_id")
            .select("text", "quality", "doc_id", F.xxhash64("text").alias("key"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).alias("shard")))

    def featured(batches):
        for batch, texts in pieces(batches):
            who, bucket, value = features(texts)
            ends = pa.array(np.searchsorted(who, np.arange(len(texts) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("shard"), batch.column("doc_id"), batch.column("key"), batch.column("quality"),
                pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value.astype(np.float32)))],
                ["shard", "doc_id", "key", "quality", "bucket", "value"])

    # one shuffle: a folder a shard, which every round reads
    spark, path = docs.sparkSession, f"{scratch(docs.sparkSession)}/llm-quality-features-{uuid.uuid4().hex[:12]}"
    found = rows.mapInArrow(featured, "shard long, doc_id long, key long, quality int, bucket array<int>, value array<float>")
    found.repartition(shards, "shard").write.partitionBy("shard").parquet(path)
    ready = spark.read.schema(found.schema).parquet(path)
    ready = reduce(DataFrame.unionByName, [ready.where(F.col("shard") == i).drop("shard").coalesce(1) for i in range(shards)])
    z, n = np.zeros(size), np.zeros(size)
    for i in range(rounds):
        state = spark.sparkContext.broadcast((z, n))
        got = apart(spark, ready.mapInArrow(epoch(state, i), "z binary, n binary"))  # `shards` rows of fixed size
        state.destroy()
        if got:
            z = np.mean([np.frombuffer(r.z, "<f4") for r in got], axis=0, dtype=float)
            n = np.mean([np.frombuffer(r.n, "<f4") for r in got], axis=0, dtype=float)
    return weights(z, n).astype(np.float32)


def scored(docs: DataFrame, w: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and the named further columns of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def task(batches: Iterator[pa.RecordBatch]):
        w = shared.value
        for batch, texts in pieces(batches):
            who, bucket, value = features(texts)
            dot = np.bincount(who, weights=w[bucket] * value, minlength=len(texts)) + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-dot)))] + [batch.column(c) for c in keep],
                                             ["doc_id", "score", *keep])

    kinds = dict(docs.dtypes)
    chosen = only(docs, "doc_id", "text", *[c for c in keep if c != "text"])
    return chosen.mapInArrow(task, "doc_id long, score double" + "".join(f", `{c}` {kinds.get(c, 'string')}" for c in keep))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", (remainder() == 2).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def op2(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
