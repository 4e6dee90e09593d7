"""Substring dedup: suffix automata of reference shards give every document's matching statistics against smaller ids.

A word is removed if a window of `least` words covers it whose words also stand in a document of a smaller doc_id.

The reference is the collection itself, so shards are routed instead of broadcast whole: every window is named by the
smallest hash of its `gram`-word parts, and runs of windows with one name are passages. Equal windows have equal names, so a
passage needs the automaton of its own name only. Names that one document alone has are dropped by a partial
aggregation. Equal passages become one with the smallest doc_id that has it: in every larger id it is covered whole, so it is
streamed for that one id only. Names are dealt to shards; a shard holds at most SHARD words. In the order of doc_id,
each passage is streamed through the shard's suffix automaton, which then holds the words of all smaller ids and no
others; where the longest match has `least` words or more, the matched words are covered. Then it is inserted.

A name with more than SHARD words (a passage that very many documents have between different neighbours) is split into
its single windows, which meet by the hash of all their words in a partially aggregated minimum of doc_id, so no name
gathers in a task. Passages of over LONG words are cut into overlapping ones.

Words are 64-bit hashes (xxh3 with a seed) of their bytes; windows are compared by all of their words.

Defined results: null, empty and shorter texts keep all words. A row without doc_id removes nothing and loses nothing.
Rows that share a doc_id do not remove from each other. Texts of any length are whole. An empty table gives no rows.
Further columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import NONSPACE, Words, documents, dropped, only, pieces, released, row_key, sequence_hash, signed, sorted_by, staged, whole_groups, word_codes
from seqlab.llm.repeats import sliding_min, union

LEAST, GRAM = 13, 4
#: Words of passages that one automaton holds, and of the longest passage.
SHARD, LONG = 1 << 16, 1 << 12
SEED = 20240601
#: A place is PLACE * start + length; passages are shorter.
PLACE = 1 << 16
START, LENGTH = f"int(place div {PLACE})", f"int(place % {PLACE})"


def word_ids(words: Words) -> np.ndarray:
    code, spelt = word_codes(words)
    return np.array([xxhash.xxh3_64_intdigest(w, SEED) for w in spelt.to_pylist()], np.uint64)[code] if len(code) else np.zeros(0, np.uint64)


def passages(words: Words, ids: np.ndarray, least: int, gram: int):
    """(text, start, length, name) of every run of windows with one name; places in words of its text."""
    if len(ids) < least:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    name = sliding_min(sequence_hash(ids, gram), least - gram + 1)
    owner = words.owner()
    ok = owner[:len(name)] == owner[least - 1:]
    at = np.arange(len(name)) - words.bounds[owner[:len(name)]]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (owner[1:len(name)] != owner[:len(name) - 1])
    run = np.maximum.accumulate(np.where(new, np.arange(len(name)), 0))
    new |= (np.arange(len(name)) - run) % LONG == 0
    start = np.flatnonzero(new & ok)
    number = np.cumsum(new) - 1
    count = np.bincount(number[ok], minlength=number[-1] + 1)[number[start]]
    return owner[start], at[start], count + least - 1, name[start]


class Automaton:
    """Suffix automaton of several word sequences; no match runs from one into the next."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _state(self, size: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest sequence followed by c, cut off from a longer one if need be."""
        q = self.next[p][c]
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def insert(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            if c in self.next[last]:
                last = self._split(last, c)
                continue
            new = self._state(self.size[last] + 1, 0, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c)
            last = new

    def spans(self, sequence: list[int], least: int) -> list[tuple[int, int]]:
        """Maximal ranges of the sequence that matches of at least `least` words cover."""
        following, link, size = self.next, self.link, self.size
        v = length = 0
        out: list[tuple[int, int]] = []
        for i, c in enumerate(sequence):
            while v and c not in following[v]:
                v = link[v]
                length = size[v]
            if c in following[v]:
                v = following[v][c]
                length += 1
            if length >= least:
                a = i - length + 1
                while out and out[-1][1] >= a:
                    a = min(a, out.pop()[0])
                out.append((a, i + 1))
        return out


def occurrences(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """Every passage: name, hash (of its words), doc_id, row, place (start and length in one number)."""
    def emit(batches):
        for batch, texts in pieces(batches):
            words = Words(texts, NONSPACE, lower=False)
            ids = word_ids(words)
            who, start, length, name = passages(words, ids, least, gram)
            raw, first = memoryview(ids.tobytes()), words.bounds[who] + start
            h = np.array([xxhash.xxh3_64_intdigest(raw[8 * a:8 * b], SEED) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)], np.uint64)
            who = pa.array(who)
            yield pa.RecordBatch.from_pydict({
                "name": pa.array(signed(name)), "hash": pa.array(signed(h)), "doc_id": batch.column("doc_id").take(who),
                "row": batch.column("row").take(who), "place": pa.array(start * PLACE + length)})

    rows = keyed(docs).where("doc_id is not null and text is not null")
    return rows.mapInArrow(emit, "name long, hash long, doc_id long, row long, place long")


def keyed(docs: DataFrame) -> DataFrame:
    rows = only(docs, "doc_id", "text").withColumn("row", row_key())
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "row")


def covered(found: DataFrame, docs: DataFrame, least: int, shard: int) -> tuple[DataFrame, list[DataFrame]]:
    """(name, hash, first, spans): of passages, the smallest doc_id with it, and what of it smaller ids cover there. A passage
    may have several rows or, if it is in one document and nothing of it is covered, none. Besides, the tables written for it."""
    own = found.groupBy("name", "hash").agg(F.min(F.struct("doc_id", "row", "place")).alias("at"), F.max("doc_id").alias("hi"))
    own = staged(own.select("name", "hash", F.col("at.doc_id").alias("first"), "at.row", "at.place", "hi").withColumns(
        {"start": F.expr(START), "length": F.expr(LENGTH)}).drop("place"), "passages")
    released(docs.sparkSession)
    sizes = own.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("length").cast("long")).alias("words"))
    sized = staged(own.join(sizes, "name").withColumn("full", F.col("words") > shard).drop("words"), "sized")
    dropped(docs.sparkSession, own)
    del own, sizes
    released(docs.sparkSession)
    some = "array<struct<a: int, b: int>>"
    copied = sized.where("first < hi").select("name", "hash", "first", F.array().cast(some).alias("spans"))

    def cut(batches):
        for batch, texts in pieces(batches):
            words = Words(texts, NONSPACE, lower=False)
            ids = word_ids(words)
            parts = batch.column("parts")
            flat = parts.flatten()
            who = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
            a = words.bounds[who] + flat.field("start").to_numpy().astype(np.int64)
            b = a + flat.field("length").to_numpy()
            yield pa.RecordBatch.from_pydict({
                **{c: flat.field(c) for c in ("name", "hash", "first", "full")},
                "words": pa.array([ids[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())})

    def stream(batches):
        for table in whole_groups(batches, "name"):
            name, first = table.column("name").to_numpy(), table.column("first").to_numpy()
            data = table.column("words").to_pylist()
            size = np.array([len(x) // 8 for x in data])
            edge = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            total = np.concatenate([[0], np.cumsum(size)])
            at = 0
            while at < len(edge):  # as many names as a shard holds, one at least
                last = int(np.searchsorted(total[np.append(edge[1:], len(name))], total[edge[at]] + shard, side="right"))
                last = max(last, at + 1)
                lo, hi = int(edge[at]), int(edge[last]) if last < len(edge) else len(name)
                at = last
                automaton, found, waiting = Automaton(), [], []
                for k in (lo + np.argsort(first[lo:hi], kind="stable")).tolist():
                    if waiting and first[waiting[-1]] != first[k]:
                        for w in waiting:
                            automaton.insert(np.frombuffer(data[w], np.uint64).tolist())
                        waiting = []
                    if hit := automaton.spans(np.frombuffer(data[k], np.uint64).tolist(), least):
                        found.append((k, hit))
                    waiting.append(k)
                keep = pa.array([k for k, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    *[table.column(c).take(keep).combine_chunks() for c in ("name", "hash", "first")],
                    pa.array([[{"a": a, "b": b} for a, b in s] for _, s in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
                    ["name", "hash", "first", "spans"])

    def split(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                h = sequence_hash(np.frombuffer(batch.column("words")[i].as_py(), np.uint64), least)
                by = np.argsort(h, kind="stable").astype(np.int32)
                new = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]]))  # equal windows of a passage are one row
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(signed(h[by[new]])), "at": pa.ListArray.from_arrays(pa.array(np.append(new, len(by)).astype(np.int32)), pa.array(by)),
                    **{c: pa.repeat(batch.column(c)[i], len(new)) for c in ("name", "hash", "first")}})

    wanted = sized.where("n > 1").groupBy("row").agg(  # the only passage of a name is covered by no other
        F.collect_list(F.struct("name", "hash", "first", "full", "start", "length")).alias("parts"))
    # the texts are shuffled once for the passages of all names, and that goes before anything else is shuffled
    texts = staged(keyed(docs).join(wanted, "row").select("text", "parts").mapInArrow(
        cut, "name long, hash long, first long, full boolean, words binary"), "texts")
    del wanted
    released(docs.sparkSession)
    written = [sized, texts]
    out = f"name long, hash long, first long, spans {some}"
    done = copied.unionByName(sorted_by(texts.where("not full").drop("full"), "name", "first").mapInArrow(stream, out))
    if sized.where("full").limit(1).count():
        windows = staged(texts.where("full").drop("full").mapInArrow(split, "key long, at array<int>, name long, hash long, first long"), "windows")
        # written, so that a hot window is joined by broadcast, or split as a skewed key
        shared = staged(windows.groupBy("key").agg(F.min("first").alias("id"), F.max("first").alias("hi")).where("id < hi").select("key", "id"), "keys")
        written += [windows, shared]
        released(docs.sparkSession)
        met = windows.join(shared, "key").where("id < first").groupBy("name", "hash", "first").agg(
            F.flatten(F.collect_list(F.transform("at", lambda a: F.struct(a.alias("a"), (a + least).alias("b"))))).cast(some).alias("spans"))
        done = done.unionByName(met)
    return done, written


def spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(row, spans): per document row that loses words, the covered word ranges [{a, b}], not yet joined up."""
    every = staged(occurrences(docs, least, gram), "occurrences")
    names = staged(every.groupBy("name").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("name"), "names")
    released(docs.sparkSession)  # the names were shuffled on their own; that goes before the occurrences are
    found = staged(every.join(names, "name", "left_semi"), "shared")
    dropped(docs.sparkSession, every, names)
    del every, names
    released(docs.sparkSession)
    wanted, written = covered(found, docs, least, shard)
    ranges = staged(wanted, "covered")
    dropped(docs.sparkSession, *written)
    del wanted, written
    released(docs.sparkSession)
    whole = F.array(F.struct(F.lit(0).alias("a"), F.expr(LENGTH).alias("b")))
    met = found.join(ranges, ["name", "hash"]).select("row", F.expr(START).alias("start"), F.when(F.col("doc_id") > F.col("first"), whole).otherwise(F.col("spans")).alias("spans"))
    placed = F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b")))
    return met.where(F.size("spans") > 0).groupBy("row").agg(F.flatten(F.collect_list(placed)).alias("spans"))


def removed(docs: DataFrame, least: int = LEAST, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_removed, spans (joined up, in words) and kept (the other words, joined by one space)."""
    def task(batches):
        for batch, texts in pieces(batches):
            parts = batch.column("spans")
            total, gone, runs, kept = [], [], [], []
            for text, some in zip(texts, parts, strict=True):
                words = text.split()  # bytes: at exactly the six bytes that are in no word
                total.append(len(words))
                runs.append([])
                if some.is_valid:
                    s, e = union(*(some.values.field(k).to_numpy().astype(np.int64) for k in ("a", "b")))
                    runs[-1] = [{"a": a, "b": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)]
                    edges = [0, *np.stack([s, e], 1).ravel().tolist(), len(words)]
                    words = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                pa.array(runs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "spans", "kept"])

    joined = keyed(docs).join(spans(docs, least, gram, shard), "row", "left").drop("row")
    return joined.mapInArrow(task, "doc_id long, n_words long, n_removed long, spans array<struct<a: long, b: long>>, kept string")


def op12(spark, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
s AS (SELECT row, doc_id, i, array_to_string(t[i + 1:i + {LEAST}], ' ') AS words
  FROM (SELECT *, unnest(range(len(t) - {LEAST} + 1)) AS i FROM d WHERE doc_id IS NOT NULL AND len(t) >= {LEAST})),
f AS (SELECT words, min(doc_id) AS id FROM s GROUP BY words),
g AS (SELECT DISTINCT row, i + k AS i FROM (SELECT row, i, unnest(range({LEAST})) AS k FROM s JOIN f USING (words) WHERE f.id < s.doc_id)),
x AS (SELECT row, count(*) AS n FROM g GROUP BY row),
k AS (SELECT w.row, string_agg(word, ' ' ORDER BY w.i) AS kept FROM (SELECT row, unnest(range(len(t))) AS i, unnest(t) AS word FROM d) w
  ANTI JOIN g ON w.row = g.row AND w.i = g.i GROUP BY w.row)
SELECT doc_id, len(t)::BIGINT AS n_words, coalesce(x.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x ON x.row = d.row LEFT JOIN k ON k.row = d.row
"""
