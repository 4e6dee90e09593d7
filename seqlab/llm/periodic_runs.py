"""Periodic run detection: branching tandem repeats from an enhanced suffix array over words.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that has at least
max(least, 2 * q) words and that no neighbouring word extends keeping period q.

The words of some documents stand in one array, each document ended by a symbol of its own. Suffixes are sorted by
prefix doubling, refining only groups that are still tied; common prefixes of neighbours are read off the doubling's
ranks. Every neighbour pair k splits an interval of depth lcp[k] in two; of the smaller side, each suffix i is tested for
whether ISA[i + depth] or ISA[i - depth] lies on the other side. A hit is a square that can't be shifted right: every run
of period q has exactly one, of depth q, at its right end. Squares with the same end whose depth is a multiple of a
shorter one that covers them have no smallest period and merge into its run. What stays is rotated left as long as the
words agree, which gives the run's start. Borders are arrays; no tree nodes are made.

Words are compared as dictionary codes, so there are no hash collisions. Documents are independent: no shuffle, and a
lost task repeats only its own rows.

Defined results: null or empty text has no words and no runs. A null doc_id is kept. Repeated rows are judged alike, each
on its own. Texts of any length are whole (a text over CHUNK_BYTES alone; about 8 bytes a word and doubling step). An
empty table gives no rows. Further columns of any name are ignored by `detect`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import NONSPACE, Words, documents, only, pieces, word_codes

LEAST = 12
#: Suffixes of smaller sides that are tested at once.
TEST_ROWS = 1 << 21
WORD = r"[^\x20\x09-\x0D]+"


def symbols(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """One number a word, equal within a document if and only if the words are, and one of its own after each document;
    where each document starts."""
    code, _ = word_codes(words)
    n, docs = len(code), len(words.counts)
    types = int(code.max()) + 1 if n else 0
    first = words.bounds[:-1] + np.arange(docs)
    out = np.empty(n + docs, np.int64)
    at = np.arange(n) + words.owner()
    out[at] = code
    out[first + words.counts] = types
    out += np.repeat(np.arange(docs), words.counts + 1) * (types + 1)
    return out, first


def suffix_array(symbol: np.ndarray):
    """Suffixes in order, the inverse, and the common prefix of each with the one before it (0 for the first).

    Symbols that occur once end every comparison, so no common prefix runs across the end of a document."""
    n = len(symbol)
    sa = np.argsort(symbol, kind="stable")
    head = np.ones(n, bool)
    head[1:] = symbol[sa[1:]] != symbol[sa[:-1]]
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    heads = np.flatnonzero(head)
    rank[sa] = heads[np.cumsum(head) - 1]
    split = np.zeros(n, np.int8)  # the doubling step that told a suffix from the one before it
    levels = []
    tied = ~head
    tied[:-1] |= ~head[1:]
    act = np.flatnonzero(tied)
    step = 1
    while len(act):
        levels.append(rank.copy())
        pos = sa[act]
        key = rank[pos].astype(np.int64) * n + rank[pos + step]
        by = np.argsort(key)
        key, pos = key[by], pos[by]
        sa[act] = pos
        new = np.ones(len(act), bool)
        new[1:] = key[1:] != key[:-1]
        fresh = act[new]
        split[fresh[~head[fresh]]] = len(levels)
        head[fresh] = True
        rank[pos] = fresh[np.cumsum(new) - 1]
        single = new.copy()
        single[:-1] &= new[1:]
        act = act[~single]
        step *= 2
    lcp = np.zeros(n, np.int64)
    some = np.flatnonzero(split)
    some = some[np.argsort(-split[some], kind="stable")]
    x, y = sa[some - 1].astype(np.int64), sa[some].astype(np.int64)
    out = np.left_shift(1, split[some].astype(np.int64) - 1)
    x, y = x + out, y + out
    count = np.searchsorted(-split[some], -np.arange(len(levels) + 2), side="right")  # pairs told apart at that step or later
    for k in range(len(levels) - 2, -1, -1):
        m = int(count[k + 2])
        same = (levels[k][x[:m]] == levels[k][y[:m]]).astype(np.int64) << k
        out[:m] += same
        x[:m] += same
        y[:m] += same
    lcp[some] = out
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    return sa, isa, lcp


def borders(lcp: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `pairs` (places in order whose lcp is over 0, ascending): the first suffix of its interval's left side and
    the last of its right side. Ties go to the left, so every pair of suffixes of an interval is split by one place."""
    value = lcp[pairs].tolist()
    place = pairs.tolist()
    left, right = [0] * len(place), [0] * len(place)
    stack: list[int] = []
    before = -1
    for j, (k, v) in enumerate(zip(place, value, strict=True)):
        if k != before + 1:  # the common prefix between is 0
            for i in stack:
                right[i] = before
            stack.clear()
            base = k - 1
        while stack and value[stack[-1]] > v:
            right[stack.pop()] = k - 1
        left[j] = place[stack[-1]] if stack else base
        stack.append(j)
        before = k
    for i in stack:
        right[i] = before
    return np.array(left, np.int64), np.array(right, np.int64)


def branching_squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, depth) of every square that can't be shifted right."""
    pairs = np.flatnonzero(lcp)
    lo, hi = borders(lcp, pairs)
    depth = lcp[pairs]
    n = len(sa)
    small_left = pairs - lo <= hi - pairs + 1
    begin = np.where(small_left, lo, pairs)
    size = np.where(small_left, pairs - lo, hi - pairs + 1)
    other_lo, other_hi = np.where(small_left, pairs, lo), np.where(small_left, hi, pairs - 1)
    starts, depths = [], []
    cuts = np.unique(np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + TEST_ROWS, TEST_ROWS), side="left"))
    cuts = np.unique(np.concatenate([[0], cuts, [len(size)]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part = size[a:b]
        who = np.repeat(np.arange(a, b), part)
        i = sa[begin[who] + np.arange(len(who)) - np.repeat(np.cumsum(part) - part, part)]
        d = depth[who]
        least, most = other_lo[who], other_hi[who]
        for sign in (1, -1):
            j = i + sign * d
            ok = (j < n) & (j >= 0)
            at = isa[np.where(ok, j, 0)]
            hit = np.flatnonzero(ok & (at >= least) & (at <= most))
            starts.append(np.minimum(i[hit], j[hit]))
            depths.append(d[hit])
    return np.concatenate(starts) if starts else np.zeros(0, np.int64), np.concatenate(depths) if depths else np.zeros(0, np.int64)


def rotated(symbol: np.ndarray, start: int, period: int) -> int:
    """Where the run of a square starts: shifted left as long as the words agree."""
    block = 32
    while start > 0:
        lo = max(0, start - block)
        differ = np.flatnonzero(symbol[lo:start] != symbol[lo + period:start + period])
        if len(differ):
            return lo + int(differ[-1]) + 1
        start, block = lo, 4 * block
    return start


def find_runs(symbol: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period. `symbol` ends documents as `symbols` does."""
    start, depth = branching_squares(*suffix_array(symbol))
    end = start + 2 * depth
    keep = np.ones(len(start), bool)
    for k in range(1, least - 1):  # a run of a short period needs more words to the left
        need = keep & (2 * depth + k <= least) & (start >= 0)
        at = start - k
        keep &= ~need | (at >= 0) & (symbol[np.maximum(at, 0)] == symbol[np.maximum(at, 0) + depth])
    start, depth, end = start[keep], depth[keep], end[keep]
    by = np.lexsort((depth, end))
    out: list[tuple[int, int, int]] = []
    here, last = [], -1  # runs of the end at hand
    for s, d, e in zip(start[by].tolist(), depth[by].tolist(), end[by].tolist(), strict=True):
        if e != last:
            here, last = [], e
        if any(d % q == 0 and s >= first for first, q in here):
            continue  # a power of a shorter word: the same run
        first = rotated(symbol, s, d)
        here.append((first, d))
        out.append((first, e - first, d))
    return sorted((s, n, q) for s, n, q in out if n >= max(least, 2 * q))


def detect(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (an array of start, length, period, by start and period) and collapsed: the words without those
    that any run contains after its first period, joined by one space."""
    def task(batches):
        for batch, texts in pieces(batches):
            words = Words(texts, NONSPACE, lower=False)
            symbol, first = symbols(words)
            runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            drop = np.zeros(len(words.starts) + 1, np.int64)
            found = find_runs(symbol, least)
            owner = np.searchsorted(first, [s for s, _, _ in found], side="right") - 1
            for (s, n, q), i in zip(found, owner.tolist(), strict=True):
                runs[i].append((s - int(first[i]), n, q))
                drop[s + q - i] += 1
                drop[s + n - i] -= 1
            kept = np.cumsum(drop)[:-1] == 0
            collapsed = []
            for i, text in enumerate(texts):
                spelt = text.split()  # bytes: at exactly the six bytes that are in no word
                if runs[i]:
                    stay = kept[words.bounds[i]:words.bounds[i + 1]]
                    spelt = [spelt[k] for k in np.flatnonzero(stay).tolist()]
                collapsed.append(b" ".join(spelt))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(words.counts, pa.int64()),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], RUNS),
                pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = only(docs, "doc_id", "text")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        task, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def with_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where of every tenth document (by crc32 of its id) the words from some place on repeat with some
    period. A null id or no word: unchanged."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = only(docs, "doc_id", "text").select("doc_id", "text", crc.alias("h"), F.floor(crc / 10).alias("g"))
    spelt = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.select("doc_id", "text", "g", spelt.alias("w")).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    changed = F.expr("array_join(transform(sequence(0, int(n) - 1), i -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return rows.select("doc_id", F.when(F.coalesce(F.col("n") > 0, F.lit(False)), changed).otherwise(F.col("text")).alias("text"))


def op11(spark, sf_dir: str) -> DataFrame:
    found = detect(with_tails(documents(spark, sf_dir)))
    best = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


ORACLE_SQL = f"""
WITH k AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT row_number() OVER () AS row, doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS t FROM documents, k),
e AS (SELECT *, len(t) AS n, CASE WHEN len(t) > 0 THEN (h // 10) % len(t) END AS a,
  CASE WHEN len(t) > 0 THEN 1 + (len(t) - (h // 10) % len(t)) // (3 + (h // 10) % 8) END AS p FROM d),
w AS (SELECT row, i, CASE WHEN h % 10 = 0 AND i >= a THEN t[a + (i - a) % p + 1] ELSE t[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM e)),
m AS (SELECT x.row, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.row = y.row AND x.word = y.word AND x.i < y.i),
b AS (SELECT row, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM m)
  GROUP BY row, q, island HAVING count(*) + q >= greatest({LEAST}, 2 * q)),
r AS (SELECT row, s, len, min(q) AS q FROM b GROUP BY row, s, len),
u AS (SELECT row, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
  first(struct_pack(s := s, len := len, q := q) ORDER BY len DESC, s, q) AS best FROM r GROUP BY row),
g AS (SELECT DISTINCT w.row, w.i FROM w JOIN r ON w.row = r.row AND w.i >= r.s + r.q AND w.i < r.s + r.len),
c AS (SELECT w.row, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN g ON w.row = g.row AND w.i = g.i GROUP BY w.row)
SELECT e.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.len::BIGINT AS length, best.q::BIGINT AS period,
  (1000 * best.len // best.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM e LEFT JOIN u ON u.row = e.row LEFT JOIN c ON c.row = e.row
"""
