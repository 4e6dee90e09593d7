"""Sequence packing by non-negative least squares over shallow combinations of lengths.

Documents are tokenised whole (one end id each) and cut into pieces of `size` tokens and a tail. The histogram of tail
lengths (at most `size` rows) goes to the driver. All combinations of at most three lengths that fill a window exactly
are enumerated, their repeat counts x >= 0 minimise |A x - histogram|^2 (accelerated projected gradient), x is rounded
within the histogram, and what is left is packed greedily, longest first into the fullest sequence with room. The plan,
rows (length, first rank, count, first sequence, offset), is bounded by the lengths and combinations, not by the
documents. A piece's rank among those of its length is its place in its task plus the counts of the tasks before.

Ids come from `tokenizers`. Texts of ASCII and Latin letters are split by the vocabulary's own pattern in numpy, and each
distinct piece of text is encoded once a worker; all other texts, and those that hold an added token of the tokenizer
(found before the pattern is applied), are encoded whole.

Defined results: null or empty text is the end id alone. Repeated rows are packed each. An empty table gives no rows.
Texts of any length are cut as often as needed. Further columns of any name are ignored.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import RangeHash, documents, only, pieces, staged

SIZE, END, DEPTH, STEPS = 2048, 1, 3, 150
#: Pieces of text whose ids a worker keeps, about 45 MB of them.
CACHE = 1 << 18
#: Anything but \t, \n, printable ASCII without ', and letters U+00C0 to U+027F.
_OTHER = re.compile(rb"[^\t\n\x20-\x26\x28-\x7e\x80-\xbf\xc3-\xc9]|\xc3[\x97\xb7]")
_CLS = np.full(256, 3, np.int8)
_CLS[[9, 10, 32]] = 0
_CLS[[b for b in range(256) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128]] = 1
_CLS[48:58] = 2
_encoders: dict = {}


class Encoder:
    """Ids of texts; distinct pieces are encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # a character of a token is a byte
        self.bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.added = re.compile(b"|".join(map(re.escape, added)) or b"(?!)")
        self.reset()

    def reset(self):
        self.at: dict[int, int] = {}
        self.first, self.count, self.ids, self.used, self.kept = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0, 0
        self.met = np.zeros(1 << 16, np.int32)

    def thin(self) -> None:
        """Keep the pieces that most calls met, half of CACHE at most; what they have met counts half from then on."""
        keys, row = np.fromiter(self.at, np.uint64, len(self.at)), np.fromiter(self.at.values(), np.int64, len(self.at))
        row, keys = row[by := np.argsort(-self.met[row], kind="stable")[:CACHE // 2]], keys[by]
        row, keys = row[often := self.met[row] > 1], keys[often]
        n, first, met, ids = self.count[row], self.first[row], self.met[row] // 2, self.ids
        self.reset()
        begin = np.cumsum(n) - n
        self.store(keys.tolist(), n, ids[np.repeat(first - begin, n) + np.arange(int(n.sum()))])
        self.met[:len(row)] = met

    def learn(self, keys: list[int], texts: list[bytes]) -> None:
        """Pieces of a space and a word are encoded as one text, which the pattern cuts at those spaces; the bytes of the
        ids say where a piece ends."""
        joined = np.array([len(t) > 1 and t[0] == 32 and t[-1] not in b" \t\n" for t in texts], bool)
        for some, at in ((True, np.flatnonzero(joined)), (False, np.flatnonzero(~joined))):
            part = [texts[i] for i in at.tolist()]
            flat = None
            if some and part:
                flat = np.array(self.tokenizer.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
                done, ends = np.cumsum(self.bytes[flat]), np.cumsum([len(t) for t in part])
                last = np.searchsorted(done, ends)
                if done[-1] == ends[-1] and (done[last] == ends).all():
                    size = np.diff(last + 1, prepend=0)
                else:  # not a tokenizer of whole bytes
                    flat = None
            if flat is None:
                got = [x.ids for x in self.tokenizer.encode_batch_fast([t.decode() for t in part], add_special_tokens=False)]
                size, flat = np.array([len(x) for x in got], np.int64), np.array([y for x in got for y in x], np.uint32)
            self.store([keys[i] for i in at.tolist()], size, flat)

    def store(self, keys: list[int], size: np.ndarray, flat: np.ndarray) -> None:
        while self.kept + len(keys) > len(self.first):
            self.first, self.count, self.met = (np.resize(x, 2 * len(x)) for x in (self.first, self.count, self.met))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        span = slice(self.kept, self.kept + len(keys))
        self.count[span], self.first[span], self.met[span] = size, self.used + np.cumsum(size) - size, 0
        self.ids[self.used:self.used + len(flat)] = flat
        self.at.update(zip(keys, range(self.kept, self.kept + len(keys)), strict=True))
        self.kept, self.used = self.kept + len(keys), self.used + len(flat)

    def plain(self, texts: list[bytes]) -> list[np.ndarray]:
        """Of texts without any byte of _OTHER, by the pattern  ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+."""
        blob = b"\n".join(texts) + b"\n"
        a = np.frombuffer(blob, np.uint8)
        cls = _CLS[a]
        ws = cls == 0
        was = np.concatenate([[True], ws[:-1]])
        start = ~ws & ~was & (cls != np.concatenate([[0], cls[:-1]]))
        start |= ~ws & was & (np.concatenate([[0], a[:-1]]) != 32)
        start |= ws & ~was
        start[:-1] |= ws[:-1] & ~ws[1:]  # the last white space before a word
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        start[offsets[:-1]] = True
        start[offsets[1:] - 1] = True  # the separators
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(a))
        h = RangeHash(a)(starts, ends)
        own = np.searchsorted(starts, offsets)
        real = np.ones(len(starts), bool)
        real[own[1:] - 1] = False
        starts, ends, h = starts[real], ends[real], h[real]
        own = own - np.arange(len(own))
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.at) + len(u) > CACHE:
            self.thin()
        keys = u.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.at]
        if new:
            self.learn([keys[i] for i in new], [blob[starts[first[i]]:ends[first[i]]] for i in new])
        entry = np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))
        self.met[entry] += 1
        entry = entry[inverse]
        n = self.count[entry]
        begin = np.cumsum(n) - n
        flat = self.ids[np.repeat(self.first[entry] - begin, n) + np.arange(int(n.sum()))]
        cut = np.append(begin, n.sum())[own]
        return [flat[cut[i]:cut[i + 1]] for i in range(len(texts))]

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        simple = [i for i, t in enumerate(texts) if t and not _OTHER.search(t) and not self.added.search(t)]
        out = dict(zip(simple, self.plain([texts[i] for i in simple]), strict=True)) if simple else {}
        for i, t in enumerate(texts):
            if i not in out:
                out[i] = np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, np.uint32)
        return [np.append(out[i], np.uint32(END)).astype("<u4") for i in range(len(texts))]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(docs: DataFrame, path: str, size: int, with_ids: bool) -> DataFrame:
    """Pieces with their task and their number among the task's pieces of that length."""
    def task(batches):
        encode, who = encoder(path), int.from_bytes(os.urandom(8), "little") >> 1
        seen = np.zeros(size + 1, np.int64)
        for batch, texts in pieces(batches):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                for at in range(0, len(ids), size):
                    part = ids[at:at + size]
                    rows.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(ids), seen[len(part)], part.tolist() if with_ids else None))
                    seen[len(part)] += 1
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(np.full(len(rows), who))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", "task"]
            if with_ids:
                arrays, names = [*arrays, pa.array(cols[6], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k long, task long" + ", ids array<long>" * with_ids
    return staged(only(docs, "doc_id", "text").mapInArrow(task, schema), "pieces")


def combinations(have: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Rows of up to three lengths, longest first, 0 for none, that add up to `size`; only lengths that occur."""
    ok = np.zeros(size + 1, bool)
    ok[have] = True
    out = [np.array([[size, 0, 0]])[ok[[size]]]]
    a = np.arange(1, size)
    two = a[(a >= size - a) & ok[a] & ok[size - a]]
    out.append(np.stack([two, size - two, 0 * two], 1))
    for c in np.flatnonzero(ok[:size // 3 + 1]) if depth > 2 else ():
        b = np.arange(max(c, 1), (size - c) // 2 + 1)
        b = b[ok[b] & ok[size - c - b]]
        out.append(np.stack([size - c - b, b, np.full(len(b), c)], 1))
    return np.concatenate(out)


def nnls(combos: np.ndarray, hist: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - hist|^2; A's column is a combination's number of each length."""
    m, n = combos.shape[0], len(hist)
    flat = combos.ravel()
    used = flat > 0
    apply = lambda x: np.bincount(flat[used], weights=np.repeat(x, combos.shape[1])[used], minlength=n)
    back = lambda r: np.where(used, r[flat], 0.0).reshape(combos.shape).sum(1)
    v = np.ones(m)
    for _ in range(12):  # largest eigenvalue, for the step
        v = back(apply(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(m)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(apply(y) - hist) / (1.05 * top))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (last - 1) / t * (new - x)
    return x


def plan(hist: np.ndarray, size: int = SIZE, depth: int = DEPTH) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset) that place every piece of the histogram."""
    left, taken, rows, sequence = hist.astype(np.int64).copy(), np.zeros(len(hist), np.int64), [], 0

    def place(lengths, n):
        nonlocal sequence
        at = 0
        for x in lengths:
            rows.append((x, taken[x], n, sequence, at))
            taken[x] += n
            at += x
        sequence += n

    combos = combinations(np.flatnonzero(left), size, depth)
    if len(combos):
        x = nnls(combos, left.astype(float))
        for up in (0.0, 0.5, 0.999):  # whole parts, then the larger and the smaller remainders
            done = np.zeros(len(x), np.int64) if up == 0 else done  # noqa: F821
            for j in np.argsort(-(x - done), kind="stable"):
                want = int(x[j] + up) - done[j]
                if want <= 0:
                    if x[j] - done[j] + up < 1:
                        break
                    continue
                lengths = [int(v) for v in combos[j] if v]
                n = min(want, *[left[v] // lengths.count(v) for v in lengths])
                if n > 0:
                    place(lengths, int(n))
                    done[j] += n
                    for v in lengths:
                        left[v] -= n
    # greedy: groups of equal open sequences by room
    room: list[list[tuple[int, list[int]]]] = [[] for _ in range(size + 1)]
    for v in range(size, 0, -1):
        n = int(left[v])
        while n:
            r = next((r for r in range(v, size) if room[r]), None)
            count, held = room[r].pop() if r is not None else (n, [])
            use = min(n, count)
            if use < count:
                room[r].append((count - use, held))
            room[(size if r is None else r) - v].append((use, [*held, v]))
            n -= use
    for group in room:
        for count, held in group:
            place(held, count)
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and offset; with `with_ids` also its ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    parts = cut(docs, path, size, with_ids)
    counts = staged(parts.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    hist = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # `size` rows at most
        hist[r.length] = r.n
    rows = plan(hist, size)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    key = rows[:, 0] * (1 << 50) + rows[:, 1]
    shared = docs.sparkSession.sparkContext.broadcast((rows, key))
    from pyspark.sql import Window

    # a length has one row a task
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    ranked = parts.join(counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("before")), ["task", "length"])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def task(batches):
        rows, key = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 50) + rank, side="right") - 1
            out = {c: batch.column(c) for c in names if c not in ("sequence_id", "offset")}
            out |= {"sequence_id": pa.array(rows[at, 3] + rank - rows[at, 1]), "offset": pa.array(rows[at, 4])}
            yield pa.RecordBatch.from_pydict({c: out[c] for c in names})

    return ranked.withColumn("rank", F.col("before") + F.col("k")).drop("task", "before", "k").mapInArrow(
        task, ", ".join(f"{c} array<long>" if c == "ids" else f"{c} long" for c in names))


def op5(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
