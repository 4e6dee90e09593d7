"""Suffix-array dedup: maximal repeats of at least `least` bytes, from the interval tree of an enhanced suffix array.

Every window of `least` bytes is named by the smallest hash of its `gram`-byte parts; runs of windows with the same
name are chunks. Equal windows have equal names, so all occurrences of a repeated window meet in the chunks of one name,
wherever they are. Names that occur once are dropped. Equal chunks of a name become one text with a weight. The
suffixes of a name's distinct chunks are sorted by prefix doubling, common prefixes of neighbours are read off the
doubling's ranks, and a stack scan of them yields the intervals with a common prefix of at least `least`. An interval is
a maximal repeat if the bytes left of its occurrences differ (the left end of a chunk differs from everything); its
occurrences, all of them, are covered for the length of the common prefix.

A name that has more than `most` distinct chunks (a passage that very many texts have between different neighbours) is
split into its windows, each named by the hash of all its bytes: equal ones are one text, and those that occur more than
once, by a partially aggregated count, are covered. So no name's texts gather in a task.

Defined results: null or empty text has 0 bytes. Texts shorter than `least` keep all bytes. Repeated rows are repeats of
each other. Texts of any length are whole; an empty table gives no rows. Further columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import RangeHash, documents, only, pieces, row_key, signed, sorted_by, staged, whole_groups

LEAST, GRAM, MOST = 200, 100, 2000
#: Bytes of whole groups that are searched at once; a larger group is searched whole, on its own. A byte takes about 100.
PART_BYTES = 1 << 18


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    at = 1
    while 2 * at <= width:
        h = np.minimum(h[:-at], h[at:])
        at *= 2
    return np.minimum(h[:len(h) - (width - at)], h[width - at:]) if width > at else h


def chunks(texts: list[bytes], least: int, gram: int):
    """(text, start, length, name, hash, own) of every run of windows with one name; start in its text.

    own: the part that names the run may occur in it twice, so it may repeat within itself.
    """
    blob = b"".join(texts)
    a = np.frombuffer(blob, np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    if len(a) < least:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, bool)]
    ranges = RangeHash(a)
    parts, width = ranges.fixed(gram), least - gram + 1
    name = sliding_min(parts, width)
    # windows that cross texts go
    owner = np.repeat(np.arange(len(texts)), size)
    ok = owner[:len(name)] == owner[least - 1:least - 1 + len(name)]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (owner[1:len(name)] != owner[:len(name) - 1])
    start = np.flatnonzero(new & ok)
    run = np.cumsum(new) - 1
    count = np.bincount(run[ok], minlength=run[-1] + 1)[run[start]]
    length = count + least - 1
    who = owner[start]
    # A part names some window if it equals the largest name of the windows that contain it. Two equal ones in a run are
    # neighbours among the naming parts, as every window between them has their name.
    rim = np.zeros(width - 1, np.uint64)
    naming = np.flatnonzero(parts == ~sliding_min(~np.concatenate([rim, name, rim]), width))
    twin = np.concatenate([[0, 0], np.cumsum(parts[naming][1:] == parts[naming][:-1])])
    lo, hi = np.searchsorted(naming, start), np.searchsorted(naming, start + length - gram, side="right")
    own = (hi > lo) & (twin[hi] > twin[np.minimum(lo + 1, len(naming))])
    return who, start - offsets[who], length, name[start], ranges(start, start + length), own


def order(a: np.ndarray, group: np.ndarray, longest: int):
    """Suffixes in order (texts of a group together; texts end in -1), and the ranks by prefixes of 1, 2, 4, ... bytes."""
    n = len(a)
    small = np.int32 if n < 1 << 31 else np.int64
    rank = (group * 257 + a + 1).astype(np.int64)
    rank = np.unique(rank, return_inverse=True)[1]
    levels, step = [rank.astype(small)], 1
    while step < longest:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        by = np.argsort(rank * (n + 2) + after, kind="stable")
        key = rank[by] * (n + 2) + after[by]
        new = np.empty(n, np.int64)
        new[by] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = new
        levels.append(rank.astype(small))
        step *= 2
        if rank.max() == n - 1:
            break
    return np.argsort(rank, kind="stable"), levels


def prefixes(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common prefix of each suffix and the one before it in order (0 for the first)."""
    n = len(sa)
    x, y = sa[:-1].copy(), sa[1:].copy()
    out = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (x < n) & (y < n)
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        out += same << k
        x, y = x + (same << k), y + (same << k)
    return np.concatenate([[0], out])


def maximal_repeats(texts: list[bytes], weight: np.ndarray, group: np.ndarray, least: int):
    """Intervals (length, lo, hi) of all maximal repeats of a group of texts, the text and offset of every suffix in order
    (the occurrences of a repeat are those from lo to hi), and (text, offset, length) of what they cover: each suffix that
    occurs in any with the longest one. Nested repeats of periodic texts have quadratically many occurrences in all, so
    they are given as intervals.

    A text of weight over 1 stands for so many equal ones, so it is covered as a whole.
    """
    intervals = array("q")
    size = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(size + 1)
    first = ends - size - 1
    a = np.full(int(ends[-1]), -1, np.int64)
    cell = "i" if len(a) < 1 << 31 else "q"
    longest = array(cell, bytes(array(cell).itemsize * len(a)))  # of the repeats that a suffix occurs in, in order
    inner = np.ones(len(a), bool)
    inner[ends - 1] = False
    a[inner] = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), size + 1)
    # ends differ from each other, so no prefix runs across them
    sa, levels = order(np.where(inner, a, -1), group[owner], int(size.max()) + 1)
    left_in_text = ends[owner] - 1 - np.arange(len(a))
    lcp = prefixes(sa, levels)
    lcp[1:] = np.minimum(lcp[1:], np.minimum(left_in_text[sa[1:]], left_in_text[sa[:-1]]))
    long = lcp >= least
    opens = np.flatnonzero(long & ~np.concatenate([[False], long[:-1]])) - 1
    closes = np.flatnonzero(long & ~np.concatenate([long[1:], [False]]))
    before = np.where(sa == first[owner[sa]], -2 - sa, a[sa - 1])  # every text's start differs
    diverse = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    for lo, hi in zip(opens.tolist(), closes.tolist(), strict=True):
        if diverse[hi] == diverse[lo]:
            continue  # one byte stands left of all: every interval in it belongs to a longer repeat
        stack = [[0, lo]]  # [common prefix, left border]
        free = array(cell, range(hi - lo + 2))  # next suffix that no repeat has yet, by place in this run
        for i in range(lo + 1, hi + 2):
            now = int(lcp[i]) if i <= hi else 0
            left = i - 1
            while stack and stack[-1][0] > now:
                length, left = stack.pop()
                if length >= least and diverse[i - 1] != diverse[left]:
                    intervals.extend((length, left, i))
                    k = left - lo
                    while True:  # inner intervals come first and are longer, so each suffix is met once
                        while free[k] != k:
                            free[k] = free[free[k]]
                            k = free[k]
                        if k >= i - lo:
                            break
                        longest[lo + k] = length
                        free[k] = k + 1
            if not stack or stack[-1][0] < now:
                stack.append([now, left])
    places = np.stack([owner[sa], sa - first[owner[sa]]], 1)
    length = np.frombuffer(longest, f"i{longest.itemsize}")
    some, whole = np.flatnonzero(length), np.flatnonzero(weight > 1)
    cover = np.concatenate([np.stack([whole, 0 * whole, size[whole]], 1), np.column_stack([places[some], length[some]])])
    return np.array(intervals, np.int64).reshape(-1, 3), places, cover


def windows(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, hash) of every window of `least` bytes."""
    size = np.array([len(t) for t in texts], np.int64)
    offsets = np.cumsum(size) - size
    h = RangeHash(np.frombuffer(b"".join(texts), np.uint8)).fixed(least)
    count = np.maximum(size - least + 1, 0)
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return owner, at, h[offsets[owner] + at]


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges."""
    by = np.argsort(starts, kind="stable")
    s, e = starts[by], np.maximum.accumulate(ends[by])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1) if len(s) else np.zeros(0, np.int64)
    return s[new], e[last]


def occurrences(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """Chunks whose name occurs more than once: name, hash, row, start, length, distinct (chunks of that name)."""
    def emit(batches):
        for batch, texts in pieces(batches):
            who, start, length, name, h, own = chunks(texts, least, gram)
            yield pa.RecordBatch.from_pydict({
                "name": pa.array(signed(name)), "hash": pa.array(signed(h)), "row": batch.column("row").take(pa.array(who)),
                "start": pa.array(start.astype(np.int32)), "length": pa.array(length.astype(np.int32)), "own": pa.array(own)})

    def repeated(batches):
        for t in whole_groups(batches, "name"):
            t = t.combine_chunks()
            name, h = t.column("name").to_numpy(), t.column("hash").to_numpy()
            new = np.ones(len(name), bool)
            new[1:] = name[1:] != name[:-1]
            run = np.cumsum(new) - 1
            fresh = new.copy()
            fresh[1:] |= h[1:] != h[:-1]
            distinct = np.bincount(run, weights=fresh).astype(np.int32)[run]
            keep = (np.bincount(run)[run] > 1) | t.column("own").to_numpy(zero_copy_only=False)
            first = np.flatnonzero(fresh)
            weight = np.diff(np.append(first, len(name)))[np.cumsum(fresh) - 1].astype(np.int32)
            out = t.append_column("distinct", pa.array(distinct)).append_column("weight", pa.array(weight)).append_column("first", pa.array(fresh))
            yield from out.filter(pa.array(keep)).to_batches()

    rows = only(docs, "doc_id", "text").select(row_key().alias("row"), "text")
    schema = "name long, hash long, row long, start int, length int, own boolean"
    return sorted_by(rows.mapInArrow(emit, schema), "name", "hash").mapInArrow(
        repeated, schema + ", distinct int, weight int, first boolean")


def covered(found: DataFrame, docs: DataFrame, least: int, most: int) -> DataFrame:
    """(name, hash, a, b): bytes a to b of every chunk with that name and hash are covered by maximal repeats."""
    # a name's only chunk, of weight over 1, is one repeat as a whole: no text is needed for it
    single = F.col("distinct") == 1
    alone = found.where(single & (F.col("weight") > 1) & F.col("first")).select(
        "name", "hash", F.lit(0).alias("a"), F.col("length").alias("b"))
    def texts_with(chosen):
        wanted = found.where(F.col("first") & ~(single & (F.col("weight") > 1)) & chosen).groupBy("row").agg(
            F.collect_list(F.struct("name", "hash", "start", "length", "weight")).alias("chunks"))
        return only(docs, "doc_id", "text").select(row_key().alias("row"), "text").join(wanted, "row").select("text", "chunks")

    def slices(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = []
                for text, parts in zip(batch.column("text").slice(i, 64).cast(pa.binary()).to_pylist(), batch.column("chunks").slice(i, 64).to_pylist(), strict=True):
                    for c in parts:
                        data = text[c["start"]:c["start"] + c["length"]]
                        rows.append((c["name"], c["hash"], c["weight"], data))
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)],
                                                 ["name", "hash", "weight", "data"])

    def split(batches):
        for batch in slices(batches):
            name, h, weight = (batch.column(c).to_numpy() for c in ("name", "hash", "weight"))
            for some in np.array_split(np.arange(batch.num_rows), 1 + batch.num_rows // 256):
                who, at, key = windows(batch.column("data").take(pa.array(some)).to_pylist(), least)
                who = some[who]
                yield pa.RecordBatch.from_pydict({"key": pa.array(signed(key)), "name": pa.array(name[who]), "hash": pa.array(h[who]),
                                                  "at": pa.array(at.astype(np.int32)), "weight": pa.array(weight[who])})

    def together(batches):
        for batch in batches:
            rows = []
            for name, h, ats in zip(*(batch.column(c).to_pylist() for c in ("name", "hash", "ats")), strict=True):
                s = np.array(ats, np.int64)
                rows += [(name, h, int(a), int(b)) for a, b in zip(*union(s, s + least), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 4, (
                pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["name", "hash", "a", "b"])

    def search(batches):
        for t in whole_groups(batches, "name"):
            key = t.column("name").to_numpy()
            data = t.column("data").to_pylist()
            weight = t.column("weight").to_numpy()
            size = np.array([len(x) for x in data])
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            part = (np.cumsum(size) - size) // PART_BYTES  # whole groups, about so much at a time
            cut = np.unique(np.concatenate([edge[np.concatenate([[True], part[edge][1:] != part[edge][:-1]])], [len(key)]]))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                group = np.cumsum(np.concatenate([[0], key[lo + 1:hi] != key[lo:hi - 1]]))
                _, _, got = maximal_repeats(data[lo:hi], weight[lo:hi], group, least)
                if not len(got):
                    continue
                base = 1 << 40
                s, e = union(got[:, 0] * base + got[:, 1], got[:, 0] * base + got[:, 1] + got[:, 2])
                who = s // base
                take = pa.array(lo + who)
                yield pa.RecordBatch.from_arrays([
                    t.column("name").take(take).combine_chunks(), t.column("hash").take(take).combine_chunks(),
                    pa.array((s % base).astype(np.int32)), pa.array((e % base).astype(np.int32))], ["name", "hash", "a", "b"])

    out = "name long, hash long, a int, b int"
    cutouts = texts_with(F.col("distinct") <= most).mapInArrow(slices, "name long, hash long, weight int, data binary")
    done = alone.unionByName(sorted_by(cutouts, "name").mapInArrow(search, out))
    full = F.col("distinct") > most
    if not found.where(full).limit(1).count():
        return done
    parts = staged(texts_with(full).mapInArrow(split, "key long, name long, hash long, at int, weight int"), "windows")
    twice = parts.groupBy("key").agg(F.sum("weight").alias("n")).where("n > 1").select("key")
    met = parts.join(twice, "key").groupBy("name", "hash").agg(F.collect_list("at").alias("ats"))
    return done.unionByName(met.mapInArrow(together, out))


def spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(row, spans): per document row with repeats, its covered byte ranges [{a, b}], not yet joined up."""
    found = staged(occurrences(docs, least, gram), "chunks")
    ranges = staged(covered(found, docs, least, most), "covered")
    return (found.select("name", "hash", "row", "start").join(ranges, ["name", "hash"])
            .groupBy("row").agg(F.collect_set(F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))).alias("spans")))


def removed(docs: DataFrame, least: int = LEAST, gram: int = GRAM, most: int = MOST, texts: bool = False) -> DataFrame:
    """Every document with counts and digest of what stays; with `texts` its other columns and the remaining text."""
    named = docs.withColumn("row", row_key()) if texts else only(docs, "doc_id", "text").withColumn("row", row_key())
    joined = named.join(spans(docs, least, gram, most), "row", "left").drop("row")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    more = [c for c in docs.columns if c not in (*names, "text", "spans")] if texts else []

    def task(batches):
        for batch, data in pieces(batches):
            got = batch.column("spans")
            rows, kept = [], []
            for text, parts in zip(data, got, strict=True):
                s = e = np.zeros(0, np.int64)
                if parts.is_valid:
                    s, e = union(*(parts.values.field(k).to_numpy().astype(np.int64) for k in ("a", "b")))
                cut = [0, *np.stack([s, e], 1).ravel().tolist(), len(text)]
                rest = b"".join(text[x:y] for x, y in zip(cut[::2], cut[1::2], strict=True))
                rows.append((len(text), len(text) - len(rest), len(s), hashlib.sha256(rest).hexdigest()))
                kept.append(rest.decode(errors="ignore"))  # without halves of characters at the cuts
            cols = list(zip(*rows, strict=True))
            out = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())]
            if texts:
                out += [pa.array(kept, pa.string()), *[batch.column(c) for c in more]]
            yield pa.RecordBatch.from_arrays(out, [*names, "text", *more] if texts else names)

    kinds = dict(docs.dtypes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if texts:
        schema += ", text string" + "".join(f", `{c}` {kinds[c]}" for c in more)
    return joined.mapInArrow(task, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir))
