"""Shared pieces of the pipeline operators: staged tables, vectorised tokenising and 64-bit hashing of words.

Words are found on UTF-8 bytes: both word classes used here are delimited by ASCII bytes only, so byte runs and
code point runs are the same. Hashes are 64-bit polynomial sums over random byte values followed by a mixer; two
different words or windows collide with probability about 2**-64.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are tokenised at once; a longer text is tokenised whole, on its own.
CHUNK_BYTES = 1 << 18
#: Bytes of an Arrow batch. An executor holds several batches a core at once, in Spark and in Python.
BATCH_BYTES = 4 << 20
#: Edges of a graph that one task joins up, about 30 MB of them in Python.
EDGES = 1 << 18
#: What a session says where no size was set.
DEFAULT_BATCH = "67108864b"

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_B = np.arange(256)
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after A-Z are lower-cased).
ALNUM = ((_B >= 48) & (_B <= 57)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
#: Bytes of words `[^\x20\x09-\x0D]+`.
NONSPACE = ~((_B == 32) | ((_B >= 9) & (_B <= 13)))

_RNG = np.random.RandomState(20240601)
_BYTE = _RNG.randint(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 5
_PINV = pow(_P, -1, 1 << 64)
_local = ""
_shipped: set[str] = set()
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n; kept up to twice CHUNK_BYTES."""
    keep = 2 * CHUNK_BYTES
    if n <= keep and 0 in _pow:
        return _pow[0]
    out = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, keep) - 1, base, np.uint64)]))
                for base in (_P, _PINV))
    if n <= keep:
        _pow[0] = out
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RangeHash:
    """Hashes of any byte ranges of a buffer, each in constant time."""

    def __init__(self, a: np.ndarray):
        p, self.inv = _powers(len(a) + 1)
        self.sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_BYTE[a] * p[:len(a)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inv[starts])

    def fixed(self, k: int) -> np.ndarray:
        """Of every range of k bytes, by start."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inv[:n]) if n > 0 else np.zeros(0, np.uint64)


class Words:
    """Words of some texts: `starts`, `ends` in `blob`; text i has words `bounds[i]` to `bounds[i + 1]`."""

    def __init__(self, texts: list[bytes], keep: np.ndarray, lower: bool = True):
        blob = b"\n".join(texts) + b"\n"
        self.blob = blob.translate(LOWER) if lower else blob
        self.array = np.frombuffer(self.blob, np.uint8)
        d = np.diff(keep[self.array].view(np.int8), prepend=0, append=0)
        self.starts, self.ends = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return RangeHash(self.array)(self.starts, self.ends)

    def owner(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def word_codes(words: Words) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal if and only if the words are; the distinct words by number."""
    size = words.ends - words.starts
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    inside = np.repeat(words.starts - offsets[:-1], size) + np.arange(offsets[-1])
    spelt = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(words.array[inside])])
    coded = spelt.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of single words, as Words.hashes gives them."""
    raw = [w.encode() for w in words]
    a = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(w) + 1 for w in raw]) - 1
    return RangeHash(a)(ends - np.array([len(w) for w in raw], np.int64), ends) if raw else np.zeros(0, np.uint64)


def sequence_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive values of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j:j + n]
    return mix(out)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text",
           size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows whose texts together have about `size` bytes, with the texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes.astype(np.int64) + 1)
        at = 0
        while at < batch.num_rows:  # only a piece's texts are copied at once
            end = min(batch.num_rows, int(np.searchsorted(total, (total[at - 1] if at else 0) + size)) + 1)
            part = batch.slice(at, end - at)
            yield part, texts_of(part.column(column))
            at = end


def hash_of(value: str) -> int:
    return int(hash_words([value])[0])


def signed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return h.view(np.int64)


def scratch(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a private one only where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        global _local
        if not _local or not os.path.isdir(_local):
            _local = tempfile.mkdtemp(prefix="seqlab-llm-")
        base = _local
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that `staged` wrote and that nothing reads any more."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs: Spark deletes them once the driver has collected its garbage, which may
    not happen for long. What a DataFrame in use needs stays."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key() -> "F.Column":
    """One long for a document row; equal rows share it, and equal rows have equal results."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit("")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; one that is missing is null text. Extra columns, also of clashing names, are dropped."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") if n in have else F.lit(None).cast("string").alias(n) for n in names])


def ship(spark: SparkSession) -> None:
    """Give the executors this package's Python files, once per application, and Arrow batches of BATCH_BYTES unless the session
    has a size of its own."""
    import zipfile

    import seqlab

    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size) == DEFAULT_BATCH:
        spark.conf.set(size, str(BATCH_BYTES))
    root = os.path.dirname(os.path.abspath(seqlab.__file__))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    name = os.path.join(tempfile.mkdtemp(prefix="seqlab-code-"), "seqlab.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("seqlab", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """From batches sorted by `key`: tables in which no group of equal keys is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key)
        if held and held[-1].column(key)[-1] == k[0] and k[0] == k[batch.num_rows - 1]:
            held.append(batch)
            continue
        values = k.to_numpy(zero_copy_only=False)
        at = int(np.searchsorted(values, values[-1]))  # the last group may go on
        head = batch.slice(0, at)
        if at or held and held[-1].column(key)[-1] != k[0]:
            yield pa.Table.from_batches([*held, head] if at else held)
            held = [batch.slice(at)]
        else:
            held = [*held, batch]
    if held:
        yield pa.Table.from_batches(held)


def sorted_by(df: DataFrame, key: str, *more: str) -> DataFrame:
    """Partitioned and sorted by `key`, for whole_groups()."""
    return df.repartition(F.col(key)).sortWithinPartitions(key, *more)


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges (a, b): (a, b) for every id but the smallest of its component, b being the smallest. After EDGES edges it starts anew."""
    up: dict[int, int] = {}

    def root(x):
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while (above := up.get(x, x)) != top:
            up[x], x = top, above
        return top

    def stars():
        ids = [x for x, above in up.items() if x != above]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], ["a", "b"])

    seen = 0
    for batch in batches:
        for at in range(0, batch.num_rows, EDGES):
            part = batch.slice(at, EDGES)
            if seen + part.num_rows > EDGES:
                yield stars()
                up.clear()
                seen = 0
            seen += part.num_rows
            for x, y in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
                x, y = root(x), root(y)
                up[max(x, y)] = min(x, y)
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of the edges (a, b): root is the smallest id of its connected component.

    First tasks of EDGES edges each leave a spanning forest of theirs, for as long as that makes the edges much fewer; at
    most EDGES edges are done by that. What is left of more edges goes through alternating large and small stars: the
    smallest neighbour of each id is found by a partial aggregation and joined back, so neither a hub nor a large component
    is gathered in one task. Ends when the edges stay the same.
    """
    edges, n = edges.select("a", "b").where("a != b"), None
    while n is None or n > EDGES:
        was, n = n, edges.count()
        if was is not None and n > EDGES and n > was * 0.7:
            break
        edges = staged(edges.coalesce(-(-n // EDGES) or 1).mapInArrow(forest, "a long, b long"), "forest")
    if n > EDGES:
        edges = stars(edges)
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return staged(edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots), "components")


def stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b) from each id to the smallest of its component."""
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        edges = staged(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        met = edges.join(low, "a")
        edges = staged(met.select("a", F.col("m").alias("b"))
                       .unionByName(met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "small-star")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            return edges
        state = now
