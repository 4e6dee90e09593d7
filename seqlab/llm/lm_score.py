"""Language-model scoring by deleted interpolation of word bigrams.

Tokens are lower-cased words and one end a text; the token before a text's first is an end. With counts c of the
training texts, N tokens and V types, a token w after v has probability

    P(w | v) = l2 * c(v, w) / c(v) + l1 * c(w) / N + l0 / (V + 1),

where the weights belong to v's context-frequency bucket (bit length of c(v), 0 if it was not seen; there l2 is 0). They are
learned by expectation-maximisation on the pairs of a tenth of the training texts, with counts of the others; then all
training texts are counted. A bucket without such pairs takes the weights of the next lower one that has some.

Every word and every pair of words is counted; nothing is shared, capped or dropped. Texts are tokenised once into
chunks of about `chunk_bytes`: distinct words, and each token's place among them. A chunk sends each distinct word and pair
once, as sorted 64-bit names dealt to `shards` by their top bits, and gets back the sums in the same order, without names.
So a hot word is one entry a chunk, a shard holds about SHARD_KEYS entries at any size of corpus (shards grow with it),
and the last pass has all counts of a chunk beside its tokens. Only sums (of all, and by bucket) go to the driver.

Defined results: null or empty text is one end token. Texts whose crc32(doc_id as text) mod 10 is 0 are held out; a
null doc_id counts as the empty text (held out). Repeated rows each count and each give a row. Without training texts
N and V are 0, and P is 1 / (V + 1). A text longer than a chunk is a chunk of its own. Further columns of any name are ignored.
"""

from __future__ import annotations

import math
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import (NONSPACE, Words, documents, dropped, hash_of, mix, only, pieces, released, sorted_by, staged,
                               whole_groups)

BLOCK_BYTES, SHARD_KEYS, ROUNDS, BUCKETS = 4 << 20, 1 << 19, 20, 64
ADD = 0.1
END = np.uint64(hash_of("\nend\n"))
CHUNK = "chunk long, ids array<long>, folds binary, sizes binary, types binary, codes binary, keys long"


def fold(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10


def packed(a: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes, after their number."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def rows_of(batches):
    """One row after the other: a row may hold the tokens of a whole chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def unpacked(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    planes = np.frombuffer(pa.decompress(b[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def rising(a: np.ndarray) -> bytes:
    return packed(np.diff(a, prepend=np.uint64(0)))


def risen(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b), dtype=np.uint64)


class Chunk:
    """Tokens of some texts: `codes` are places in the sorted `types`, `pair` places in the sorted names `pairs`."""

    def __init__(self, types: np.ndarray, codes: np.ndarray, sizes: np.ndarray, folds: np.ndarray):
        self.types, self.codes, self.sizes = types, codes.astype(np.int64), sizes.astype(np.int64)
        self.folds = folds
        self.owner = np.repeat(np.arange(len(sizes)), self.sizes)
        self.before = np.roll(self.codes, 1)
        self.before[np.cumsum(self.sizes) - self.sizes] = np.searchsorted(types, END)
        u, inverse = np.unique(self.before * len(types) + self.codes, return_inverse=True)
        names = mix(types[u // len(types)] * np.uint64(0xD6E8FEB86659FD93) + types[u % len(types)])
        order = np.argsort(names, kind="stable")
        self.pairs, place = names[order], np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair = place[inverse]

    @classmethod
    def of(cls, row: dict) -> "Chunk":
        return cls(risen(row["types"]), unpacked(row["codes"]), unpacked(row["sizes"]), unpacked(row["folds"]))

    def counts(self, places: np.ndarray, n: int, which: np.ndarray) -> np.ndarray:
        return np.bincount(places[which[self.owner]], minlength=n)

    def sent(self):
        """(kind, sorted names, counts of the estimating texts, counts of the tenth that weights are learned on)."""
        seen, held = self.folds > 1, self.folds == 1
        for kind, names, places in ((0, self.types, self.codes), (1, self.pairs, self.pair)):
            yield kind, names, self.counts(places, len(names), seen), self.counts(places, len(names), held)


def chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    def row(parts):
        ids, folds, sizes, hashes = ([x for p in parts for x in p[0]], *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3)))
        types, codes = np.unique(hashes, return_inverse=True)
        keys = len(types) + len(Chunk(types, codes, sizes, folds).pairs)
        values = (int.from_bytes(os.urandom(8), "little") >> 1, ids, packed(folds), packed(sizes), rising(types), packed(codes), keys)
        names = ("chunk", "ids", "folds", "sizes", "types", "codes", "keys")
        kinds = (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    def task(batches):
        parts, size = [], 0
        for batch, texts in pieces(batches):
            w = Words(texts, NONSPACE)
            sizes = w.counts + 1
            hashes = np.full(int(sizes.sum()), END)
            inner = np.ones(len(hashes), bool)
            inner[np.cumsum(sizes) - 1] = False
            hashes[inner] = w.hashes()
            ids = batch.column("doc_id").to_pylist()
            parts.append((ids, np.array([fold(x) for x in ids]), sizes, hashes))
            size += len(w.blob)
            if size >= chunk_bytes:
                yield row(parts)
                parts, size = [], 0
        if parts:
            yield row(parts)

    return staged(only(docs, "doc_id", "text").mapInArrow(task, CHUNK), "lm-chunks")


def summed(table: DataFrame, shards: int) -> DataFrame:
    """(chunk, part, seen, held): sums over all chunks, in the order of the chunk's own names of that part; parts of words come
    before parts of pairs. Word totals of a shard stand on its first row."""
    def send(batches):
        for r in rows_of(batches):
            for kind, names, seen, held in Chunk.of(r).sent():
                shard = (names >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
                cut = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(names)]
                for a, b in zip(cut, cut[1:]):
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([kind * shards + int(shard[a])], pa.int64()), "chunk": pa.array([r["chunk"]], pa.int64()),
                        "names": pa.array([rising(names[a:b])], pa.binary()), "seen": pa.array([packed(seen[a:b])], pa.binary()),
                        "held": pa.array([packed(held[a:b])], pa.binary())})

    def add(batches):
        for group in whole_groups(batches, "part"):
            part = group.column("part").to_numpy()
            for p in np.unique(part):
                t = group.filter(pa.array(part == p))
                names = [risen(x) for x in t.column("names").to_pylist()]
                cut = np.cumsum([0, *map(len, names)])
                u, inverse = np.unique(np.concatenate(names), return_inverse=True)
                seen, held = (np.bincount(inverse, weights=np.concatenate([unpacked(x) for x in t.column(c).to_pylist()]), minlength=len(u))
                              .astype(np.int64) for c in ("seen", "held"))
                both, words = seen + held, int(p < shards)
                total = [words * int(x) for x in (both.sum(), (both > 0).sum(), seen.sum(), (seen > 0).sum())]
                for i, chunk in enumerate(t.column("chunk").to_pylist()):
                    at = inverse[cut[i]:cut[i + 1]]
                    yield pa.RecordBatch.from_pydict({
                        "chunk": pa.array([chunk], pa.int64()), "part": pa.array([p], pa.int64()),
                        "seen": pa.array([packed(seen[at])], pa.binary()), "held": pa.array([packed(held[at])], pa.binary()),
                        **{c: pa.array([0 if i else x], pa.int64()) for c, x in zip(("n", "v", "n_seen", "v_seen"), total, strict=True)}})

    sent = table.mapInArrow(send, "part long, chunk long, names binary, seen binary, held binary")
    return staged(sorted_by(sent, "part").mapInArrow(
        add, "chunk long, part long, seen binary, held binary, n long, v long, n_seen long, v_seen long"), "lm-sums")


def counted(row: dict) -> tuple[Chunk, list[np.ndarray]]:
    """A chunk, and the seen and held counts of its words and then of its pairs."""
    return Chunk.of(row), [np.concatenate([unpacked(x[c]) for x in row["sums"]]).astype(np.int64) for c in ("seen", "held")]


def held_pairs(table: DataFrame) -> DataFrame:
    """(v, w, vw, n): n held-out pairs whose context, word and pair were seen so often."""
    def task(batches):
        for r in rows_of(batches):
            c, (seen, _) = counted(r)
            at = np.flatnonzero((c.folds == 1)[c.owner])
            pair, first, n = np.unique(c.pair[at], return_index=True, return_counts=True)
            at = at[first]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen[c.before[at]], seen[c.codes[at]], seen[len(c.types) + pair], n)],
                                             ["v", "w", "vw", "n"])

    return staged(table.mapInArrow(task, "v long, w long, vw long, n long").groupBy("v", "w", "vw").agg(F.sum("n").alias("n")), "lm-held")


def bucket(c: np.ndarray) -> np.ndarray:
    return np.frexp(c.astype(np.float64))[1]


def mixture(held: DataFrame, n_seen: int, v_seen: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bucket, order) that expectation-maximisation finds; a round is one aggregation by bucket."""
    rows = held.select(
        F.when(F.col("v") > 0, F.length(F.bin("v"))).otherwise(0).alias("b"), "n", F.lit(1 / (v_seen + 1)).alias("p0"),
        (F.col("w") / F.lit(float(max(1, n_seen)))).alias("p1"), (F.col("vw") / F.greatest("v", F.lit(1))).alias("p2"))
    w = np.tile([0.1, 0.4, 0.5], (BUCKETS, 1))
    w[0] = (0.2, 0.8, 0)
    used = np.zeros(BUCKETS, bool)
    for _ in range(rounds):
        part = [F.element_at(F.array(*map(F.lit, w[:, i].tolist())), F.col("b") + 1) * F.col(f"p{i}") for i in range(3)]
        share = rows.select("b", "n", *[p.alias(f"s{i}") for i, p in enumerate(part)])
        total = F.col("s0") + F.col("s1") + F.col("s2")
        got = share.groupBy("b").agg(*[F.sum(F.col("n") * F.col(f"s{i}") / total).alias(f"t{i}") for i in range(3)]).collect()  # BUCKETS rows
        for r in got:
            t = np.array([r.t0, r.t1, r.t2]) + (1e-3, 1e-3, 1e-3 if r.b else 0)  # no weight falls to 0
            w[r.b], used[r.b] = t / t.sum(), True
    for b in range(2, BUCKETS):
        if not used[b] and used[b - 1]:
            w[b], used[b] = w[b - 1], True
    return w


def scores(docs: DataFrame, chunk_bytes: int = BLOCK_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    spark = docs.sparkSession
    table = chunks(docs, chunk_bytes)
    keys = table.agg(F.sum("keys")).first()[0] or 0
    sums = summed(table, -(-keys // shard_keys) or 1)
    total = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n_seen", "v_seen")]).first()
    released(spark)  # after that query: the last one's files are still held
    back = sums.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "seen", "held"))).alias("sums"))  # of one chunk
    both = staged(table.join(back, "chunk"), "lm-counted")
    dropped(spark, table, sums)
    held = held_pairs(both)
    weights = mixture(held, total.n_seen, total.v_seen)
    dropped(spark, held)
    released(spark)
    n, v = total.n, total.v

    def task(batches):
        for r in rows_of(batches):
            c, (seen, late) = counted(r)
            count = seen + late
            word, context, pair = count[c.codes], count[c.before], count[len(c.types) + c.pair]
            w = weights[bucket(context)]
            p = w[:, 2] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 0] / (v + 1) if n else np.full(len(word), 1 / (v + 1))
            add = lambda x: np.bincount(c.owner, weights=x, minlength=len(c.sizes))
            yield pa.RecordBatch.from_arrays([
                pa.array(r["ids"], pa.int64()), pa.array(c.folds == 0), pa.array(c.sizes), pa.array(add(word > 0).astype(np.int64)),
                pa.array(np.full(len(c.sizes), n)), pa.array(add(np.log10(word + ADD)) - c.sizes * math.log10(n + ADD * (v + 1))),
                pa.array(add(np.log10(p)))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return both.mapInArrow(task, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7(spark, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))
