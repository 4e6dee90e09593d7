"""Benchmark decontamination: an Aho-Corasick automaton over the normalised items, each text scanned once for it.

A window is 10 consecutive words of an item (the whole item if it has fewer). All windows go into one automaton over
normalised text, " w1 w2 ... w10 ", so a match starts and ends at word boundaries and overlapping ones are all found.
Offsets in the normalised text map to word numbers and to bytes of the original text. Over `most` (item, window) pairs are
dealt by hash into parts of about that size at most, with an automaton each; the texts are scanned once a part, and what the
parts find in a document is joined up before it is counted.

Defined results: null or empty text has no words, no hits and is clean. Items without words have no window. Windows that
several items share count for all of them; rows that repeat an item_id are one item. Items of null item_id count for n_hit
and contaminated, but are not among the items of n_items and items_sha256. Repeated documents each give a row;
empty tables give none, or clean documents. Further columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import ALNUM, Words, documents, only, pieces, row_key, staged

#: An automaton of MOST windows takes about 150 MB in a worker, and the driver holds the windows of one at a time.
WINDOW, MOST = 10, 50_000
_automata: dict = {}


def normalise(w: Words, i: int) -> bytes:
    """The words of text i with one space before, between and after them."""
    return b" ".join([b"", *w.blob[w.offsets[i]:w.offsets[i + 1]].translate(_BLANK).split(), b""])


_BLANK = bytes(b if ALNUM[b] else 32 for b in range(256))


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, window, n): normalised windows (their bytes as Latin-1) and their numbers of words, by item."""
    def task(batches):
        for batch, texts in pieces(batches):
            w, rows = Words(texts, ALNUM), []
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                words = normalise(w, i).split()
                rows += [(item, b" ".join([b"", *words[k:k + window], b""]).decode("latin-1"), min(window, len(words)))
                         for k in range(max(1, len(words) - window + 1)) if words]
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, t), v in zip(
                (("item", pa.string()), ("window", pa.string()), ("n", pa.int32())), list(zip(*rows, strict=True)) or [()] * 3, strict=True)})

    return (only(items, "item_id", "text").withColumn("item_id", F.col("item_id").cast("string"))
            .mapInArrow(task, "item string, window string, n int").distinct())


def patterns_of(rows: DataFrame) -> dict[str, tuple[int, list[str]]]:
    """Window -> its number of words and its items."""
    out: dict[str, tuple[int, list[str]]] = {}
    for r in rows.collect():
        names = out.setdefault(r.window, (r.n, []))[1]
        if r.item is not None:
            names.append(r.item)
    return out


def automaton(key: str, patterns: dict):
    """Built once per Python worker."""
    if key not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for window, (n, items) in patterns.items():
            a.add_word(window, (len(window), n, items))
        a.make_automaton()
        _automata.clear()
        _automata[key] = a
    return _automata[key]


def matches(found, text: bytes):
    """Words (first, number) of a normalised text that windows match, and the windows' items."""
    at, ids, spaces = set(), set(), None
    text = text.decode("latin-1")
    for end, (size, n, names) in found.iter(text):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
        at.add((int(np.searchsorted(spaces, end - size + 1)), n))
        ids.update(names)
    return at, ids


def found_by_parts(docs: DataFrame, rows: DataFrame, parts: int) -> DataFrame:
    """(row, at, ids): matches() of every document that has any, of all parts."""
    spark, out = docs.sparkSession, None
    texts = only(docs, "doc_id", "text").select(row_key().alias("row"), "text")
    for p in range(parts):
        patterns = patterns_of(rows.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == p))
        key, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(patterns)

        def task(batches, key=key, shared=shared):
            found = automaton(key, shared.value) if shared.value else None
            for batch, data in pieces(batches):
                w, got = Words(data, ALNUM), []
                for i, row in enumerate(batch.column("row").to_pylist()):
                    at, ids = matches(found, normalise(w, i)) if found is not None and w.counts[i] else ((), ())
                    if at:
                        got.append((row, [{"first": k, "n": n} for k, n in at], list(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*got, strict=True)) or [()] * 3, (
                    pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())])), pa.list_(pa.string())), strict=True)], ["row", "at", "ids"])

        hits = staged(texts.mapInArrow(task, "row long, at array<struct<first: int, n: int>>, ids array<string>"), "hits")
        shared.unpersist()
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy("row").agg(*[F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("at", "ids")])


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, most: int = MOST, spans: bool = False) -> DataFrame:
    """Every document with its hit words and items; with `spans` also the hit byte ranges of the original text."""
    rows = staged(windows(items, window), "windows")
    parts = -(-rows.count() // most)
    patterns = patterns_of(rows) if parts < 2 else {}
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(patterns)

    def task(batches):
        found = automaton(key, shared.value) if shared.value else None
        for batch, texts in pieces(batches):
            w = Words(texts, ALNUM)
            hits, counts, shas, ranges = [], [], [], []
            known = list(zip(*(batch.column(c).to_pylist() for c in ("found_at", "found_ids")), strict=True)) if parts > 1 else None
            for i in range(len(texts)):
                at, ids = (), ()
                if known is not None:
                    at, ids = [(x["first"], x["n"]) for x in known[i][0] or ()], known[i][1] or ()
                elif found is not None and w.counts[i]:
                    at, ids = matches(found, normalise(w, i))
                cover = np.zeros(w.counts[i] + 1, np.int64)
                for k, n in at:
                    cover[k] += 1
                    cover[k + n] -= 1
                hit = np.cumsum(cover[:-1]) > 0
                hits.append(int(hit.sum()))
                counts.append(len(ids))
                shas.append(hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
                if spans:
                    d = np.diff(hit.astype(np.int8), prepend=0, append=0)
                    first = w.bounds[i]
                    ranges.append([{"start": int(w.starts[first + a] - w.offsets[i]), "end": int(w.ends[first + b - 1] - w.offsets[i])}
                                   for a, b in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1), strict=True)])
            out = {"doc_id": batch.column("doc_id"), "n_words": pa.array(w.counts.astype(np.int64)),
                   "n_hit": pa.array(hits, pa.int64()), "n_items": pa.array(counts, pa.int64()),
                   "items_sha256": pa.array(shas, pa.string()), "contaminated": pa.array([h > 0 for h in hits], pa.bool_())}
            if spans:
                out["spans"] = pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_pydict(out | {c: batch.column(c) for c in keep})

    keep = [c for c in docs.columns if c not in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")] if spans else []
    chosen = docs.select("doc_id", *[f"`{c}`" for c in keep]) if spans else only(docs, "doc_id", "text")
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    if spans:
        schema += ", spans array<struct<start: long, end: long>>" + "".join(f", `{c}` {t}" for c, t in docs.dtypes if c in keep)
    if parts > 1:
        by_row = found_by_parts(docs, rows, parts).select(F.col("row").alias("found_row"), F.col("at").alias("found_at"), F.col("ids").alias("found_ids"))
        chosen = chosen.withColumn("found_key", row_key()).join(by_row, F.col("found_key") == F.col("found_row"), "left")
    return chosen.mapInArrow(task, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
