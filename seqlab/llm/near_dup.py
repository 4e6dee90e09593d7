"""Near-duplicates by a chosen-path similarity join.

A document's set is its distinct shingles of five words; equal sets are one class from the start. Every class gets 128
minwise values. In each of `trees` independent trees a node chooses one or two of the 128 coordinates (4/3 on average,
one over the similarity), and a class goes on to the child (coordinate, its minwise value): two classes of similarity s
meet in (4/3 * s)**depth nodes a tree on average, so links of 0.75 keep meeting at any depth while unrelated classes
part. Nodes of at most `leaf` classes are compared exhaustively by their signatures; larger ones first in blocks of
`block` / FIRST classes together with some classes that all blocks of the node share. That joins most variants of one text,
which no branching would part. A large node that is one component by then is done; one with at most `block` classes outside
its largest component is compared whole, these against all, each pair of blocks in a task of its own; the others branch
again, twice, and what is still large then is compared whole too.

Links are confirmed on full sets. First three of each class's best partners are confirmed, which joins nearly all of a
group, then three of its best in other components (in large nodes over all pairs of blocks, until that brings no more than
`leaf` links), and at last all pairs of a node that are still in different components. The last comparison also holds the `LOW`
smallest shingle hashes of each class against each other, which for sets of fewer shingles are the whole sets, so that
hardly any pair but the links leaves it. So a group of n variants costs a number of links in proportion to n once it is
joined, and no link between components is left out; classes of a large node that stay apart cost comparisons in its tasks
by the square of their number. Components are found by large and small stars.

Defined results: null or empty text, or text without words: n_shingles 0, a component of its own. Fewer than five words
are one shingle. Repeated rows share a class. A null doc_id takes part, but is never a component_id unless all of its
component are null. Further columns of any name are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import (CHUNK_BYTES, NONSPACE, Words, components, documents, dropped, mix, only, pieces, row_key, sequence_hash,
                               signed, sorted_by, staged, texts_of, whole_groups)

SHINGLE, COORDS, TREES, DEPTH, LEAF, BLOCK, PIVOTS, AGAIN, FIRST = 5, 128, 12, 3, 64, 1024, 8, 2, 4
SHARE = (75, 100)  # intersection over union
#: A signature's estimate of a link of 0.75 lies below it with probability 1e-5.
MAYBE = 0.58
#: Smallest hashes kept of a class; the share of them that a link of 0.75 falls below with probability 1e-5.
LOW, NEAR = 512, 0.66
#: Chance collisions of 32-bit hashes that a comparison of whole sets allows for.
SLACK = 2
#: Keys of texts that are broadcast (16 bytes each); more are joined by a shuffle.
KEYS = 2_000_000
_R = np.random.RandomState(7)
_A = _R.randint(1, 1 << 31, COORDS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_C = _R.randint(0, 1 << 31, COORDS).astype(np.uint32)


def shingles(texts: list[bytes]):
    """(text, hash) of every distinct shingle, sorted by both."""
    w = Words(texts, NONSPACE)
    h = w.hashes()
    owner = w.owner()
    long = w.counts >= SHINGLE
    s = sequence_hash(h, SHINGLE)
    inner = owner[:len(s)] == owner[SHINGLE - 1:] if len(s) else np.zeros(0, bool)
    who, what = owner[:len(s)][inner], s[inner]
    short = [i for i in np.flatnonzero(~long & (w.counts > 0))]
    if short:
        few = [sequence_hash(h[w.bounds[i]:w.bounds[i + 1]], int(w.counts[i]))[0] + np.uint64(w.counts[i]) for i in short]
        who, what = np.concatenate([who, short]), np.concatenate([what, np.array(few, np.uint64)])
    by = np.lexsort((what, who))
    who, what = who[by], what[by]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
    return who[new], what[new]


def branch(nodes: np.ndarray, values: np.ndarray, owner: np.ndarray, depth: int):
    """`depth` levels down: nodes and the rows of `values` they belong to."""
    for _ in range(depth):
        pick = mix(nodes)
        one = (pick >> np.uint64(40)).astype(np.int64) % COORDS
        two = (pick >> np.uint64(20)).astype(np.int64) % COORDS
        also = ((pick & np.uint64(0xFFFF)) % np.uint64(3) == 0) & (one != two)
        child = lambda n, o, c: mix(n * np.uint64(0x9E3779B97F4A7C15) + (values[o, c].astype(np.uint64) << np.uint64(8)) + c.astype(np.uint64) + np.uint64(1))
        nodes, owner = (np.concatenate([child(nodes, owner, one), child(nodes[also], owner[also], two[also])]),
                        np.concatenate([owner, owner[also]]))
    return nodes, owner


def sketches(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """Per row: class (hash of the set), set size, signature of 8 bits a coordinate and the nodes at `depth`."""
    def task(batches):
        for batch, texts in pieces(batches):
            who, what = shingles(texts)
            n = np.bincount(who, minlength=len(texts))
            full = np.flatnonzero(n)
            first = np.searchsorted(who, full)
            cls = mix(np.add.reduceat(mix(what), first) + n[full].astype(np.uint64)) if len(full) else np.zeros(0, np.uint64)
            x = what.astype(np.uint32)
            low = np.empty((len(full), COORDS), np.uint32)
            for c in range(COORDS if len(full) else 0):
                low[:, c] = np.minimum.reduceat(x * _A[c] + _C[c], first)
            low = mix(low.astype(np.uint64)).astype(np.uint32)
            roots = mix(np.arange(trees, dtype=np.uint64) + np.uint64(99))
            nodes, owner = branch(np.tile(roots, len(full)), low, np.repeat(np.arange(len(full)), trees), depth)
            by = np.argsort(owner, kind="stable")
            cuts = np.zeros(len(texts) + 1, np.int32)
            cuts[full + 1] = np.bincount(owner, minlength=len(full))
            sig = (low & np.uint32(255)).astype(np.uint8)
            classes, sigs = np.zeros(len(texts), np.uint64), [None] * len(texts)
            classes[full] = cls
            for i, f in enumerate(full.tolist()):
                sigs[f] = sig[i].tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(signed(classes), mask=n == 0),
                pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(np.cumsum(cuts).astype(np.int32)), pa.array(signed(nodes[by].copy())))],
                ["row", "doc_id", "n", "cls", "sig", "nodes"])

    rows = only(docs, "doc_id", "text").withColumn("row", row_key())
    return rows.mapInArrow(task, "row long, doc_id long, n long, cls long, sig binary, nodes array<long>")


def occupied(members: DataFrame) -> DataFrame:
    """(node, cls, size) of the nodes that several classes share."""
    def task(batches):
        for t in whole_groups(batches, "node"):
            node, cls = t.column("node").to_numpy(), t.column("cls").to_numpy()
            new = np.ones(len(node), bool)
            new[1:] = (node[1:] != node[:-1]) | (cls[1:] != cls[:-1])  # a class may reach a node twice
            node, cls = node[new], cls[new]
            _, inverse, count = np.unique(node, return_inverse=True, return_counts=True)
            size = count[inverse]
            ok = size > 1
            yield pa.RecordBatch.from_pydict({"node": pa.array(node[ok]), "cls": pa.array(cls[ok]), "size": pa.array(size[ok])})

    return sorted_by(members, "node", "cls").mapInArrow(task, "node long, cls long, size long")


def apart(node: int, held, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows (x, y) of a node share none of the smaller nodes that `held` (offsets, values) lists for them."""
    offsets, values = held
    vals = values[offsets[0]:offsets[-1]]
    who = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    vals, who = vals[vals < node], who[vals < node]
    _, inverse, count = np.unique(vals, return_inverse=True, return_counts=True)
    col = np.cumsum(count > 1) - 1
    several = count[inverse] > 1 if len(vals) else np.zeros(0, bool)
    if not several.any():
        return np.ones(len(x), bool)
    flags = np.zeros((len(offsets) - 1, -(-(int(col[-1]) + 1) // 64) * 64), bool)
    flags[who[several], col[inverse[several]]] = True
    flags = np.packbits(flags, axis=1).view(np.uint64)
    step = max(1, (1 << 21) // flags.shape[1])
    cuts = range(0, len(x), step)
    return ~np.concatenate([(flags[x[i:i + step]] & flags[y[i:i + step]]).any(1) for i in cuts]) if len(x) else np.zeros(0, bool)


def lowest(texts: DataFrame) -> DataFrame:
    """(cls, low): the LOW smallest shingle hashes of each class, 32 bits each, ascending."""
    def task(batches):
        for batch, data in pieces(batches):
            who, what = shingles(data)
            cut = np.searchsorted(who, np.arange(len(data) + 1))
            what = mix(what).astype(np.uint32)
            low = [np.unique(what[a:b])[:LOW].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(low, pa.binary())], ["cls", "low"])

    return texts.mapInArrow(task, "cls long, low binary")


def close(flat: np.ndarray, cut: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows (x, y) may be links: row i has the smallest hashes flat[cut[i]:cut[i + 1]]."""
    out = np.zeros(len(x), bool)
    by = np.argsort(x, kind="stable")
    for group in np.split(by, np.flatnonzero(np.diff(x[by])) + 1) if len(x) else []:
        i, other = x[group[0]], y[group]
        a, n = flat[cut[i]:cut[i + 1]], cut[other + 1] - cut[other]
        first = np.cumsum(n) - n
        b = flat[np.repeat(cut[other] - first, n) + np.arange(n.sum())]
        met = a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b
        both = np.add.reduceat(met.astype(np.int64), first)
        ok = SHARE[1] * (both + SLACK) >= SHARE[0] * (len(a) + n - both - SLACK)
        for j in np.flatnonzero((n >= LOW) | (len(a) >= LOW)).tolist():
            part = slice(first[j], first[j] + n[j])
            least = np.union1d(a, b[part])[:LOW]
            ok[j] = (b[part][met[part]] <= least[-1]).sum() >= NEAR * len(least)
        out[group] = ok
    return out


def pairs(members: DataFrame, best: bool) -> DataFrame:
    """Candidate pairs (a, b) within nodes, of classes with different labels, by signature.

    best: of each class's best partners in its nodes, the best of all and two by chance, so three pairs a class at most;
    otherwise all pairs that may be links by the column `low`, each in the smallest node that `held` lists for both classes.

    Rows with `left` are compared with those with `right`. `whole` is the node that a cell is part of (see cells()), and
    `major` rows have the label that no left row of their cell has.
    """
    def compare(cls, n, sig, label, left, right, major, whole, held, low):
        got = []
        rows, cols = np.flatnonzero(left), np.flatnonzero(right)
        for i in range(0, len(rows), 128):  # 128 rows against all of the node
            r = rows[i:i + 128]
            same = (sig[r][:, None, :] == sig[cols][None, :, :]).sum(2, dtype=np.int32)
            small, large = np.minimum(n[r][:, None], n[cols]), np.maximum(n[r][:, None], n[cols])
            ok = (same >= MAYBE * COORDS) & (small * SHARE[1] >= SHARE[0] * large)
            if not len(cols):
                continue
            if best:
                same = np.where(ok & (label[r][:, None] != label[cols]), same, -1)
                j = same.argmax(1)
                x = np.flatnonzero(same[np.arange(len(j)), j] >= 0)
                got.append((r[x], cols[j[x]], same[x, j[x]]))
            else:
                x, y = np.nonzero(ok & ((label[r][:, None] < label[cols]) | major[cols]))
                got.append((r[x], cols[y], same[x, y]))
        if not got:
            return cls[:0], cls[:0], n[:0]
        x, y, same = (np.concatenate(v) for v in zip(*got, strict=True))
        if not best:
            for test in (lambda x, y: apart(whole, held, x, y), lambda x, y: close(*low, x, y)):
                new = test(x, y)
                x, y, same = x[new], y[new], same[new]
        return cls[x], cls[y], same

    def task(batches):
        for t in whole_groups(batches, "node"):
            t = t.combine_chunks()
            node, cls, n, label = (t.column(c).to_numpy() for c in ("node", "cls", "n", "label"))
            left, right, major, whole = (t.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right", "major", "whole"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, COORDS)
            if not best:
                lists = t.column("held").chunk(0)
                offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
                lows = t.column("low").to_pylist()
                flat = np.frombuffer(b"".join(lows), np.uint32)
                cut = np.concatenate([[0], np.cumsum([len(v) // 4 for v in lows])]).astype(np.int64)
            held = lambda s, k: None if best else (offsets[s:s + k + 1], values)
            low = lambda s, k: None if best else (flat, cut[s:s + k + 1])
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            size = np.diff(np.append(start, len(node)))
            plain = size == 2
            plain[plain] = (left & right)[start[plain]] & (left & right)[start[plain] + 1]
            two = start[plain]
            same = (sig[two] == sig[two + 1]).sum(1)
            ok = (same >= MAYBE * COORDS) & (label[two] != label[two + 1])
            ok &= np.minimum(n[two], n[two + 1]) * SHARE[1] >= SHARE[0] * np.maximum(n[two], n[two + 1])
            if not best:
                zero, one = np.zeros(1, np.int64), np.ones(1, np.int64)
                ok[ok] = [apart(whole[s], held(s, 2), zero, one)[0] and close(*low(s, 2), zero, one)[0] for s in two[ok].tolist()]
            x, y, alike = cls[two[ok]], cls[two[ok] + 1], same[ok]
            out = [(x, y, alike), (y, x, alike)] if best else [(x, y, alike)]
            for s, k in zip(start[~plain].tolist(), size[~plain].tolist(), strict=True):
                out.append(compare(*(v[s:s + k] for v in (cls, n, sig, label, left, right, major)), whole[s], held(s, k), low(s, k)))
            x, y, same = (np.concatenate(v) for v in zip(*out, strict=True))
            yield pa.RecordBatch.from_pydict({"x": pa.array(x), "y": pa.array(y), "same": pa.array(same.astype(np.int32))})

    found = sorted_by(members, "node").mapInArrow(task, "x long, y long, same int")
    if best:
        pick = lambda by: F.max(F.struct(by, F.col("y")))
        three = found.groupBy("x").agg(*[pick(by).getField("y").alias(f"y{i}") for i, by in enumerate(
            (F.col("same"), F.xxhash64("y", F.lit(1)), F.xxhash64("y", F.lit(2))))])
        found = three.select("x", F.explode(F.array("y0", "y1", "y2")).alias("y"))
    return found.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def split(met: DataFrame, leaf: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Of (node, cls, size): (node, cls, small) of the small nodes and of blocks of the large ones; (whole, cls) of the latter.

    A class is in at most as many nodes as its trees and branches have.
    """
    large = met.where(F.col("size") > leaf)
    cuts = F.ceil(F.col("size") / block)
    # every block holds the classes whose hash falls into one of PIVOTS / size parts: about PIVOTS of a node
    shared = F.pmod(F.xxhash64("cls", "node"), F.greatest(F.lit(1), (F.col("size") / PIVOTS).cast("long"))) == 0
    part = F.when(shared, F.sequence(F.lit(0).cast("long"), cuts - 1)).otherwise(F.array(F.pmod(F.xxhash64("cls", "node", F.lit(1)), cuts)))
    blocks = large.select("node", "cls", F.lit(False).alias("small"), F.explode(part).alias("part"))
    blocks = blocks.select(F.xxhash64("node", "part").alias("node"), "cls", "small")
    out = met.where(F.col("size") <= leaf).select("node", "cls", F.lit(True).alias("small")).unionByName(blocks)
    return out, large.select(F.col("node").alias("whole"), "cls")


def branched(large: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, cls, size) of the nodes DEPTH levels below the nodes of (whole, cls)."""
    def deeper(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, COORDS)
            nodes, owner = branch(batch.column("node").to_numpy().view(np.uint64), sig, np.arange(batch.num_rows), DEPTH)
            yield pa.RecordBatch.from_pydict({"node": pa.array(signed(nodes)), "cls": batch.column("cls").take(pa.array(owner))})

    rows = large.join(classes.select("cls", "sig"), "cls").select(F.col("whole").alias("node"), "cls", "sig")
    return occupied(rows.mapInArrow(deeper, "node long, cls long"))


def majority(large: DataFrame) -> DataFrame:
    """Per node of (whole, cls, label) with several labels: the one that most of its classes have, most.n of `size`."""
    count = large.groupBy("whole", "label").agg(F.count("*").alias("n"))
    return count.groupBy("whole").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("size")).where("most.n < size")


def cells(large: DataFrame, block: int) -> DataFrame:
    """Nodes (whole, cls, label) with several labels, as cells: each pair of blocks is one.

    Classes of the label that most of the node has need no comparison with each other. So a cell is a block of the other
    classes (`left`) with a block of all (`right`), and every pair of different labels is in a cell of its node.
    """
    rows = large.join(majority(large), "whole").withColumn("major", F.col("label") == F.col("most.label"))
    high, wide = F.ceil((F.col("size") - F.col("most.n")) / block), F.ceil(F.col("size") / block)
    own = lambda salt, cuts: F.pmod(F.xxhash64("cls", "whole", F.lit(salt)), cuts)
    every = lambda cuts: F.explode(F.sequence(F.lit(0).cast("long"), cuts - 1))
    side = lambda left: [F.lit(left).alias("left"), F.lit(not left).alias("right")]
    out = (rows.where("not major").select("whole", "cls", "label", "major", *side(True), own(1, high).alias("i"), every(wide).alias("j"))
           .unionByName(rows.select("whole", "cls", "label", "major", *side(False), own(2, wide).alias("j"), every(high).alias("i"))))
    return out.withColumn("node", F.xxhash64("whole", "i", "j")).drop("i", "j")


def confirmed(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """The edges (a, b) whose full sets have the share."""
    def task(batches):
        for batch in batches:
            ta, tb = texts_of(batch.column("ta")), texts_of(batch.column("tb"))
            total = np.cumsum([len(x) + len(y) for x, y in zip(ta, tb, strict=True)])
            i = 0
            while i < batch.num_rows:  # about CHUNK_BYTES of text at once
                done = total[i - 1] if i else 0
                m = min(64, max(1, int(np.searchsorted(total, done + CHUNK_BYTES)) - i))
                part, texts_at, i = batch.slice(i, m), slice(i, i + m), i + m
                m = part.num_rows
                who, what = shingles(ta[texts_at] + tb[texts_at])
                cut = np.searchsorted(who, np.arange(2 * m + 1))
                ok = []
                for j in range(m):
                    a, b = what[cut[j]:cut[j + 1]], what[cut[j + m]:cut[j + m + 1]]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    ok.append(SHARE[1] * both >= SHARE[0] * (len(a) + len(b) - both) and both > 0)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))
    return edges.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(task, "a long, b long")


def groups(docs: DataFrame, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """row (key of the document row), doc_id, n_shingles, root (a class of the component; null without words), component_id."""
    sets = staged(sketches(docs, trees, DEPTH), "sets")
    classes = staged(sets.where("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.min("n").alias("n"), F.first("sig").alias("sig"),
        F.first("nodes").alias("nodes")), "classes")
    met = staged(occupied(classes.select("cls", F.explode("nodes").alias("node"))), "nodes")
    nodes, large = (staged(t, name) for t, name in zip(split(met, leaf, max(1, block // FIRST)), ("members", "large"), strict=True))
    dropped(docs.sparkSession, met)
    sig = classes.select("cls", "n", "sig")
    all_rows = [F.lit(True).alias("left"), F.lit(True).alias("right"), F.lit(False).alias("major"), F.col("node").alias("whole")]
    first = staged(pairs(nodes.join(sig, "cls").select("*", F.col("cls").alias("label"), *all_rows), True), "best")
    # every class that any pair can have is an end of some best pair or in a large node: their texts are fetched once
    ends = (first.select(F.col("a").alias("cls")).union(first.select(F.col("b").alias("cls"))).union(large.select("cls"))).distinct()
    wanted = staged(ends.join(classes.select("cls", "row"), "cls"), "wanted")
    keys = F.broadcast(wanted) if wanted.count() <= KEYS else wanted
    texts = only(docs, "doc_id", "text").select(row_key().alias("row"), "text").join(keys, "row")
    texts = staged(texts.select("cls", "text").dropDuplicates(["cls"]), "texts")  # equal rows share a key
    roots, tried = components(staged(confirmed(first, texts), "links")), first

    def labelled(members):
        return (members.join(roots.withColumnRenamed("id", "cls"), "cls", "left")
                .withColumn("label", F.coalesce("root", "cls")).drop("root").join(ends, "cls", "left_semi"))

    def mixed(members):
        """Nodes whose classes are still in several components."""
        label = staged(labelled(members), "labels")
        several = label.groupBy("node").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("node")
        return label.join(several, "node").select("node", "cls", "label", *all_rows)

    def joined(found) -> bool:
        """Adds what new pairs bring of links to the components; whether those are more than `leaf`."""
        nonlocal roots, tried
        rest = staged(found.join(tried, ["a", "b"], "left_anti"), "rest")
        more, tried = staged(confirmed(rest, texts), "links"), tried.unionByName(rest)
        if not (new := more.limit(leaf + 1).count()):
            return False
        # the components so far are stars, so only the new links need work
        roots = components(more.unionByName(roots.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b"))))
        return new > leaf

    # large nodes of one component are done; those where few classes are outside the largest one are compared whole
    members, whole, level = [nodes.where("small")], [], large
    for again in range(AGAIN + 1):
        label = staged(labelled(level), "labels")
        few = F.lit(again == AGAIN) | (F.col("size") - F.col("most.n") <= block)
        several = staged(label.select("whole", "cls").join(majority(label).select("whole", few.alias("few")), "whole"), "large")
        whole.append(several.where("few").drop("few"))
        many = several.where("not few").drop("few")
        if not many.limit(1).count():
            break
        met = staged(branched(many, classes), "nodes")
        deep, level = split(met, leaf, block)
        members.append(deep.where("small"))
    small, large = reduce(DataFrame.unionByName, members), reduce(DataFrame.unionByName, whole)
    any_large = large.limit(1).count() > 0

    def parts():
        """What is to be compared in nodes of several components: small nodes whole, the others in cells."""
        return mixed(small).unionByName(cells(staged(labelled(large), "labels"), block)) if any_large else mixed(small)

    if joined(pairs(parts().join(sig, "cls"), True)):
        while any_large and joined(pairs(cells(staged(labelled(large), "labels"), block).join(sig, "cls"), True)):
            pass
    open_ = staged(parts(), "open")  # two classes of one node with different labels: both lists have the node
    held = open_.groupBy("cls").agg(F.collect_set("whole").alias("held"))
    low = staged(lowest(texts.join(held.select("cls"), "cls", "left_semi")), "lowest")
    joined(pairs(open_.join(sig, "cls").join(held, "cls").join(low, "cls"), False))
    dropped(docs.sparkSession, low, open_, texts)
    known = classes.select("cls", "doc_id").join(roots.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = known.join(least, "root").select("cls", "component_id", "root")
    out = sets.select("row", "doc_id", F.col("n").alias("n_shingles"), "cls").join(component, "cls", "left")
    return out.select("row", "doc_id", "n_shingles", "root",
                      F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op4(spark, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
