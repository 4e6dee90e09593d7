"""Source divergence audit: how far the term frequencies of a language's sources lie apart, by a frequent-pattern tree.

A language keeps its terms in at least `least_docs` documents. A source's smoothed share of a term with count c is
p = 1 + floor(1e9 * (c + 2) / (N + 2 * V)); two shares differ by f = floor((p - q)**2 / (p + q)). The divergence of two sources
is the sum of f over all kept terms, of which most occur in few sources. So it is taken apart: V times f of two zero
counts, plus for each source the corrections of its nonzero counts against zero (by a histogram of its counts), plus
the corrections of terms that both sources have.

The last come from a frequent-pattern tree: the row of a term is its path, the shares of its nonzero counts in the order of
sources (largest first); equal rows are one path with a multiplicity. Paths are range-partitioned and sorted, so paths that
share a beginning stand together. A node is a beginning of a path, its multiplicity that of all paths through it, and
each node and ancestor of it give one correction times that multiplicity. Only the rows of a batch are held; a path that is
cut at its border has its nodes twice with parts of the multiplicity. All sums are of whole numbers.

Defined results: null text, lang and source are ''. A document without terms still makes its group. Without kept terms
(V = 0) all divergences are 0 and no term rows come. Repeated rows are documents of their own. Texts of any length are whole.
An empty table gives no rows. Further columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlab.llm.common import Words, documents, only, pieces, staged, word_codes

LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
_B = np.arange(256)
#: Bytes of terms `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` (after A-Z are lower-cased).
LETTERS = ((_B >= 97) & (_B <= 122)) | (_B >= 128)
#: Bytes of text whose terms are counted together.
PIECE = 1 << 23
#: Items of a path by which ranges are found.
HEAD = 4
#: Node-ancestor combinations that are worked out at once.
COMBINATIONS = 1 << 19
GROUP = ["lang", "source"]


def named(docs: DataFrame) -> DataFrame:
    return only(docs, "text", *GROUP).select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it)."""
    def task(batches):
        for batch, texts in pieces(batches, size=PIECE):
            words = Words(texts, LETTERS)
            code, spelt = word_codes(words)
            if not len(code):
                continue
            owner, types = words.owner(), len(spelt)
            names = pa.StructArray.from_arrays([batch.column(c) for c in GROUP], GROUP)
            pairs = list(zip(*(x.to_pylist() for x in names.flatten()), strict=True))
            groups = {g: i for i, g in enumerate(dict.fromkeys(pairs))}
            group = np.array([groups[g] for g in pairs], np.int64)
            each, n = np.unique(owner * types + code, return_counts=True)  # a term of a document
            key = group[each // types] * types + each % types
            by = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
            first = by[new]
            who = pa.array(key[first] // types)
            some = list(groups)
            yield pa.RecordBatch.from_arrays([
                *[pa.array([g[i] for g in some], pa.string()).take(who) for i in range(2)],
                spelt.take(pa.array(key[first] % types)).cast(pa.binary()).cast(pa.string()),
                pa.array(np.add.reduceat(n[by], new)), pa.array(np.diff(np.append(new, len(by))).astype(np.int64))],
                [*GROUP, "term", "n", "docs"])

    rows = named(docs).where("text is not null").mapInArrow(task, "lang string, source string, term string, n long, docs long")
    return rows.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, types: str) -> F.Column:
    exact = f"(cast({count} + 2 as decimal(20, 0)) * {SCALE})"
    return F.expr(f"if({types} = 0, 1, 1 + {exact} div ({total} + 2 * {types}))").cast("long")


def apart(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def tree_corrections(lang: np.ndarray, begin: np.ndarray, item: np.ndarray, p: np.ndarray, zero: np.ndarray, times: np.ndarray):
    """(row, item a, item b, sum) of the corrections of some sorted paths; the row is one of that language.

    Path r has the items and shares `begin[r]` to `begin[r + 1]`; zero: each item's share of a count of 0."""
    n = len(lang)
    size = np.diff(begin)
    # items that a path shares with the one before it
    both = np.where(lang[1:] == lang[:-1], np.minimum(size[1:], size[:-1]), 0)
    row = np.repeat(np.arange(1, n), both)
    at = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
    same = (item[begin[row] + at] == item[begin[row - 1] + at]) & (p[begin[row] + at] == p[begin[row - 1] + at])
    shared = np.zeros(n, np.int64)
    shared[1:] = both
    differ = np.flatnonzero(~same)
    np.minimum.at(shared, row[differ], at[differ])
    # the row after the last path through each node that a path opens
    after = np.zeros(len(item), np.int64)
    opened: list[int] = []
    start = begin.tolist()
    for r, keep in enumerate(shared.tolist()):
        for node in opened[keep:]:
            after[node] = r
        del opened[keep:]
        opened.extend(range(start[r] + keep, start[r + 1]))
    after[opened] = n
    owner = np.repeat(np.arange(n), size)
    depth = np.arange(len(item)) - begin[owner]
    nodes = np.flatnonzero(depth >= shared[owner])
    passing = np.concatenate([[0], np.cumsum(times)])
    many = passing[after[nodes]] - passing[owner[nodes]]
    depth, owner = depth[nodes], owner[nodes]
    total = np.concatenate([[0], np.cumsum(depth)])
    kinds, kind = np.unique(item, return_inverse=True)
    spoken = np.concatenate([[0], np.cumsum(lang[1:] != lang[:-1])])
    cut = np.unique(np.concatenate([np.searchsorted(total, np.arange(0, total[-1], COMBINATIONS)), [len(nodes)]]))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        who = np.repeat(np.arange(lo, hi), depth[lo:hi])
        if not len(who):
            continue
        a = begin[owner[who]] + np.arange(len(who)) - np.repeat(total[lo:hi] - total[lo], depth[lo:hi])
        b = nodes[who]
        g = difference(p[a], p[b]) - difference(p[a], zero[b]) - difference(zero[a], p[b]) + difference(zero[a], zero[b])
        key = (spoken[owner[who]] * len(kinds) + kind[a]) * len(kinds) + kind[b]
        by = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
        first = by[new]
        yield owner[who][first], item[a[first]], item[b[first]], np.add.reduceat((g * many[who])[by], new)


def pair_corrections(paths: DataFrame) -> DataFrame:
    """lang, a, b, value from (lang, path, times), where a path is an array of (item, p, zero)."""
    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path")
            flat = path.flatten()
            begin = np.concatenate([[0], np.cumsum(pc.list_value_length(path).to_numpy(zero_copy_only=False))]).astype(np.int64)
            lang = batch.column("lang").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            for row, a, b, value in tree_corrections(lang, begin, *[flat.field(c).to_numpy() for c in ("item", "p", "zero")], batch.column("times").to_numpy()):
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(row)), pa.array(a), pa.array(b), pa.array(value)], ["lang", "a", "b", "value"])

    # A fixed number of ranges is not merged again. Equal paths are one row, so no range is hot: where many share a beginning, a
    # hash deals them. Ranges are found from the beginnings, as Spark gathers a sample of the keys on the driver.
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    start = F.transform(F.slice("path", 1, HEAD), lambda x: F.shiftleft(x["item"].cast("long"), 32) + x["p"])
    rows = paths.repartitionByRange(parts, "lang", start, F.xxhash64("path")).sortWithinPartitions("lang", "path")
    return rows.mapInArrow(task, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: a row for each pair of sources of a language (part pair), and for each source its
    `top` terms that stand out most from the language (part term)."""
    counted = term_counts(docs).groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("found"))
    terms = staged(counted.where(F.col("docs") >= least_docs).select("lang", "term", "total", "found"), "terms")
    flat = terms.select("lang", "term", "total", F.explode("found").alias("at")).select("lang", "term", "total", "at.source", "at.n")

    languages = terms.groupBy("lang").agg(F.count("*").alias("types"), F.sum("total").alias("lang_total"))
    seen = named(docs).select(*GROUP).distinct().join(flat.groupBy(*GROUP).agg(F.sum("n").alias("total")), GROUP, "left")
    groups = seen.join(languages, "lang", "left").na.fill(0, ["total", "types", "lang_total"])
    groups = groups.withColumn("item", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("total"), "source")))
    groups = staged(groups.withColumn("zero", share("0", "total", "types")), "groups")

    shares = flat.withColumnRenamed("total", "term_total").join(groups, GROUP).select(
        *GROUP, "term", "item", "zero", share("n", "total", "types").alias("p"), share("term_total", "lang_total", "types").alias("q"))
    shares = staged(shares, "shares")
    order = Window.partitionBy(*GROUP)
    standing = shares.where("p > q").select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), apart("p", "q").alias("value"))
    standing = standing.withColumn("rank", F.row_number().over(order.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)

    ends = groups.select("lang", F.col("item").alias("a"), F.col("zero").alias("za"), "types")
    others = groups.select("lang", F.col("item").alias("b"), F.col("zero").alias("zb"))
    base = ends.join(others, "lang").where("a < b").select("lang", "a", "b", (F.col("types") * apart("za", "zb")).alias("value"))
    counts = shares.groupBy("lang", F.col("item").alias("a"), F.col("zero").alias("za"), "p").agg(F.count("*").alias("times"))
    single = counts.join(others, "lang").where("a != b").select(
        "lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("times") * (apart("p", "zb") - apart("za", "zb"))).alias("value"))
    single = single.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    paths = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("item", "p", "zero"))).alias("path"))
    paths = paths.groupBy("lang", "path").agg(F.count("*").alias("times"))
    pairs = base.unionByName(single).unionByName(pair_corrections(paths)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    both = staged(pairs, "pairs").select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "value")
    one, two = (groups.select("lang", F.col("item").alias(k), F.col("source").alias(name)) for k, name in (("a", "source"), ("b", "other")))
    both = both.select("lang", "x.a", "x.b", "value").join(one, ["lang", "a"]).join(two, ["lang", "b"]).select(
        *GROUP, F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    both = both.withColumn("rank", F.row_number().over(order.orderBy(F.desc("value"), "item")))
    return both.unionByName(standing).select(*GROUP, "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def op13(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
w AS (SELECT row, lang, source, unnest(t) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS types FROM kept GROUP BY lang),
tot AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
ltot AS (SELECT lang, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
lc AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
s AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(tot.total, 0) + 2 * v.types) AS p,
    1 + ({SCALE}::HUGEINT * (lc.n + 2)) // (ltot.total + 2 * v.types) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) JOIN lc USING (lang, term) JOIN ltot USING (lang)
  LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM s WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
