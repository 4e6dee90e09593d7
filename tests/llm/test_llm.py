"""Operators of the pipeline package against brute force, on small tables with the awkward cases."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter
from itertools import combinations as pairs_of

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqlab.llm import (common, decontaminate, license_scan, lm_score, near_dup, packing, quality_model, quality_rules, repeats,
                        url_filters, warc)
from seqlab.llm.common import pieces, ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, n_words string, spans string"
_r = np.random.RandomState(3)
VOCABULARY = ["".join(_r.choice(list("abcdeéio"), _r.randint(2, 8))) for _ in range(400)]
say = lambda n: " ".join(_r.choice(VOCABULARY, n))
PASSAGE, ITEM = say(60), say(25)
BASE = say(120)
edit = lambda t, n: " ".join(w if i not in set(_r.choice(120, n)) else "zz" for i, w in enumerate(t.split()))
TEXTS = [None, "", " \n\t", "one two", "One TWO", "Under the MIT License. " + say(60), "x apache license, version 2 apache license version 2",
         say(80) + " " + PASSAGE + " " + say(90), PASSAGE + "\n" + say(70), say(5000), "It It It " * 300, BASE, BASE, edit(BASE, 2), edit(BASE, 3),
         say(50) + ". " + re.sub("[a-z]", lambda m: m[0].upper(), " ".join(ITEM.split()[3:20])) + "! " + say(40), "don't <|endoftext|> ×ü　 हि", "a  b \n\nc|||", "end",
         "line one here\nline one here\n" + say(60)]
DOCS = [(i, t, "en", "src0", len(t or ""), 7, "w", "s") for i, t in enumerate(TEXTS)]
DOCS += [DOCS[13], (None, "null id " + say(60), "en", "src0", 1, 7, "w", "s")]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


def test_texts_and_batches_are_small_in_memory(spark):
    """A batch's texts are not all copied at once, and Spark sends batches of a few MB."""
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["words " * 400, None, ""] * 4000)})
    list(pieces([batch.slice(0, 300)]))  # imports
    tracemalloc.start()
    sizes = [(part.num_rows, len(texts), sum(map(len, texts))) for part, texts in pieces([batch])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(x[0] for x in sizes) == sum(x[1] for x in sizes) == 12_000 and sum(x[2] for x in sizes) == 9_600_000
    assert peak < 4e6
    ship(spark)
    seen = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches)
    got = spark.range(8000).select(F.repeat(F.lit("words "), 400).alias("text")).coalesce(1).mapInArrow(seen, "n long, size long").collect()
    assert sum(r.n for r in got) == 8000 and max(r.size for r in got) < 6e6


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def words(t, lower=True):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if lower else t or ""
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def check(df, expected, *columns):
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    assert got == Counter(expected)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels, items = spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (license_scan.scan(none), quality_model.classify(none, labels), url_filters.judge(pages), near_dup.groups(none),
               packing.pack(none), decontaminate.scan(none, items), lm_score.scores(none), repeats.removed(none),
               quality_rules.judge(none, labels)):
        assert df.count() == 0


def test_license_scan(docs):
    def row(d):
        w, at, tags = alnum(d[1]), [], set()
        for label, phrase in license_scan.BASE:
            p = phrase.split()
            found = [i for i in range(len(w)) if w[i:i + len(p)] == p]
            at += found
            tags |= {label} if found else set()
        return d[0], len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(tags))

    check(license_scan.scan(docs), [row(d) for d in DOCS], "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def test_license_templates_by_brute_force(spark):
    ship(spark)
    r, notices = random.Random(4), [t[1].split() for t in license_scan.TEMPLATES]
    texts = []
    for i in range(120):
        said = []
        for notice in r.sample(notices, r.choice((1, 2, len(notices)))):  # with all others of the index, or few
            changed = set(r.sample(range(len(notice)), r.choice((0, 0, 1, 2, 3))))
            said += ["zz" if j in changed else w for j, w in enumerate(notice)] + r.choices(VOCABULARY, k=r.randint(0, 3))
        texts.append((i, " ".join(said)))

    def brute(text):
        w, tags, best = text.split(), set(), 0.0
        for label, notice, phrases in [(x, p, (p,)) for x, p in license_scan.BASE] + list(license_scan.TEMPLATES):
            n = notice.split()
            must = {k + i for p in phrases for k in [next(k for k in range(len(n)) if n[k:k + len(p.split())] == p.split())] for i in range(len(p.split()))}
            for at in range(-len(n), len(w)):
                here = [0 <= at + i < len(w) and w[at + i] == x for i, x in enumerate(n)]
                if all(here[i] for i in must) and sum(here) / len(n) >= license_scan.LEAST:
                    tags.add(label)
                    best = max(best, sum(here) / len(n))
        return ",".join(sorted(tags)), round(best, 9)

    expected = [(i, *brute(t)) for i, t in texts]
    assert any("bsd" in x[1] for x in expected)
    for rare in (0, license_scan.RARE):  # the rarest words of each template alone leave nothing out
        got = license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string"), rare=rare)
        check(got.withColumn("score", F.round("score", 9)), expected, "doc_id", "labels", "score")


def test_near_dup(docs):
    sets = [frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)]) for w in (words(d[1]) for d in DOCS)]
    root = list(range(len(DOCS)))
    for _ in DOCS:
        for a, b in pairs_of(range(len(DOCS)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) or not sets[a] and DOCS[a][0] == DOCS[b][0]:
                root[a] = root[b] = min(root[a], root[b])
    least = lambda i: min((DOCS[j][0] for j in range(len(DOCS)) if root[j] == root[i] and DOCS[j][0] is not None), default=None)
    check(near_dup.groups(docs), [(d[0], len(s), least(i)) for i, (d, s) in enumerate(zip(DOCS, sets, strict=True))],
          "doc_id", "n_shingles", "component_id")


def test_near_dup_of_many_variants(spark):
    """Links about the threshold, in nodes that are compared in blocks, against all pairs."""
    rng = random.Random(5)
    base = [[f"v{g}w{i}" for i in range(60)] for g in range(2)]
    texts = []
    for i in range(300):
        words = list(base[i % 2])
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[j:j + 5]) for j in range(56)} for t in texts]
    root = list(range(300))
    for i in range(300):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.groups(df, leaf=8, block=64).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) > 2


def test_near_dup_does_not_branch_what_is_joined(spark, monkeypatch):
    """A large group of near copies makes no rows but those of its own nodes and blocks."""
    rng = random.Random(6)
    texts = []
    for _ in range(120):
        words = [f"w{i}" for i in range(100)]
        words[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    deeper = []
    monkeypatch.setattr(near_dup, "branched", lambda *x: deeper.append(x))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in near_dup.groups(df, leaf=8, block=32).collect()} == {0} and not deeper


@pytest.mark.parametrize("most", [1 << 18, 7])
def test_components_join_edges_in_tasks_first(spark, monkeypatch, most):
    """Paths and a star by union-find in tasks of `most` edges, then by stars; few edges need one pass and no shuffle of edges."""
    passes = []
    old = common.staged
    monkeypatch.setattr(common, "EDGES", most)
    monkeypatch.setattr(common, "staged", lambda df, name: passes.append(name) or old(df, name))
    edges = [(i, i + 1) for i in range(60) if i != 30] + [(200, 100 + i) for i in range(30)] + [(5, 4), (9, 9), (-3, 2**60)]
    got = {r.id: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {i: 0 if i <= 30 else 31 for i in range(61)} | {i: 100 for i in [*range(100, 130), 200]} | {-3: -3, 2**60: -3}
    assert most < 1000 or passes == ["forest", "components"]


def test_near_dup_of_variants_linked_by_their_base_alone(spark, monkeypatch):
    """Each variant has one link, to the base, and the nodes that hold both are cut into blocks."""
    monkeypatch.setattr(near_dup, "PIVOTS", 1)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(400):
        words = list(base)
        at = rng.randrange(5)
        for j in rng.sample(range(6), 5):
            words[at + 30 * j + 10] = f"x{i}y{j}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[j:j + 5]) for j in range(196)} for t in texts]
    assert all(100 * len(sets[0] & s) >= 75 * len(sets[0] | s) for s in sets)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_dup.groups(df, leaf=2, block=4).collect()
    assert len(rows) == 401 and {r.component_id for r in rows} == {0}


def test_cells_hold_every_pair_of_labels(spark):
    rng = random.Random(4)
    label = {c: rng.choice([1, 1, 1, 2, c]) for c in range(50)}
    df = spark.createDataFrame([(9, c, x) for c, x in label.items()] + [(8, 1, 5), (8, 2, 5)], "whole long, cls long, label long")
    held = {}
    for r in near_dup.cells(df, 7).collect():
        held.setdefault(r.node, ([], []))[r.right].append(r.cls)
        assert r.whole == 9 and r.left != r.right and r.major == (r.label == 1)
    met = Counter((a, b) for left, right in held.values() for a in left for b in right)
    assert met == Counter((a, b) for a in label for b in label if label[a] != 1)


def test_pairs_appear_in_their_smallest_node():
    rng = random.Random(3)
    lists = [sorted(rng.sample(range(-200, 200), rng.randrange(40))) for _ in range(90)]
    offsets = np.cumsum([0, *map(len, lists)])
    values = np.array([v for x in lists for v in x], np.int64)
    x, y = (a.ravel() for a in np.indices((90, 90)))
    for node in (-200, 0, 199):
        want = [not any(v < node for v in set(lists[i]) & set(lists[j])) for i, j in zip(x, y, strict=True)]
        got = near_dup.apart(node, (offsets, values), x, y)
        # a row alone may hold a smaller node that no other row has
        assert [g for g, i, j in zip(got, x, y, strict=True) if i != j] == [w for w, i, j in zip(want, x, y, strict=True) if i != j]


def test_smallest_hashes_keep_every_link():
    r = np.random.RandomState(5)
    sets = []
    for n in (1, 2, 30, 400, 511, 512, 513, 3000):
        base = r.randint(0, 1 << 31, n).astype(np.uint32)
        for share in (1, 0.95, 0.9, 0.86, 0.8, 0.5):  # 0.86 of the hashes kept: a similarity near 0.75
            sets.append(np.unique(np.concatenate([base[:int(np.ceil(share * n))], r.randint(0, 1 << 31, n - int(np.ceil(share * n))).astype(np.uint32)])))
    lows = [np.sort(s)[:near_dup.LOW] for s in sets]
    cut = np.concatenate([[0], np.cumsum([len(x) for x in lows])])
    x, y = np.triu_indices(len(sets), 1)
    got = near_dup.close(np.concatenate(lows), cut, x, y)
    for i, j, ok in zip(x, y, got, strict=True):
        both = len(np.intersect1d(sets[i], sets[j]))
        either = len(sets[i]) + len(sets[j]) - both
        assert ok or 100 * both < 75 * either
        if len(sets[i]) > 20 and 100 * both < 60 * either:
            assert not ok
    assert not len(near_dup.close(np.concatenate(lows), cut, x[:0], y[:0]))


def test_repeats(docs):
    for least, gram in ((200, 100), (40, 20)):
        raw = [(d[1] or "").encode() for d in DOCS]
        seen = Counter(t[i:i + least] for t in raw for i in range(len(t) - least + 1))
        expected = []
        for d, t in zip(DOCS, raw, strict=True):
            gone = np.zeros(len(t), bool)
            for i in range(len(t) - least + 1):
                if seen[t[i:i + least]] > 1:
                    gone[i:i + least] = True
            kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
            expected.append((d[0], len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
        for most in (2000, 1):
            check(repeats.removed(docs, least, gram, most), expected, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_windows_of_full_names_are_one_text_each(spark, monkeypatch):
    """A passage of over `least` bytes between different neighbours: no text of its name goes to one search."""
    passage = say(60)[:230]
    texts = [f"{i:04d}" * 40 + passage + f"{i + 500:04d}" * 40 for i in range(60)] + ["short"]
    who, at, h = repeats.windows([t.encode() for t in texts], 200)
    held = {}
    for i, k, x in zip(who.tolist(), at.tolist(), h.tolist(), strict=True):
        held.setdefault(x, set()).add(texts[i].encode()[k:k + 200])
    assert all(len(v) == 1 for v in held.values()) and len(who) == sum(max(0, len(t.encode()) - 199) for t in texts)

    def refuse(*_):
        raise AssertionError("searched whole")

    monkeypatch.setattr(repeats, "maximal_repeats", refuse)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = repeats.covered(repeats.occurrences(df, 200, 100).where("distinct > 20"), df, 200, 20)
    assert got.where("b - a >= 200").count() > 0


def test_maximal_repeats_hold_all_occurrences():
    texts = [b"xxabcdefyy", b"zabcdefz", b"abcde"]
    intervals, suffixes, cover = repeats.maximal_repeats(texts, np.ones(3, int), np.zeros(3, int), 3)
    found = {(n, tuple(sorted(map(tuple, suffixes[lo:hi].tolist())))) for n, lo, hi in intervals.tolist()}
    assert (6, ((0, 2), (1, 1))) in found and (5, ((0, 2), (1, 1), (2, 0))) in found
    assert sorted(map(tuple, cover.tolist())) == [(0, 2, 6), (1, 1, 6), (2, 0, 5)]


def test_decontaminate(spark, docs):
    items = [(1, ITEM, 0), (1, ITEM, 0), (10, "one TWO", 1), (2, None, 1), (3, "...", 1), (4, " ".join(ITEM.split()[2:14]), 1)]
    windows = {(i, tuple(alnum(t)[k:k + 10])) for i, t, _ in items for k in range(max(1, len(alnum(t)) - 9)) if alnum(t)}
    expected = []
    for d in DOCS:
        w, hit, ids = alnum(d[1]), set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids.add(i)
        expected.append((d[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    df = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    check(decontaminate.scan(docs, df), expected, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontaminate_in_parts_and_without_ids(spark, docs):
    items = [(1, ITEM), (1, ITEM), (10, "one TWO"), (4, " ".join(ITEM.split()[2:14])), (None, " ".join(PASSAGE.split()[:12]))]
    df = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda most: sorted((repr(r) for r in decontaminate.scan(docs, df, most=most, spans=True).collect()))
    whole = decontaminate.scan(docs, df, spans=True).collect()
    assert rows(5) == sorted(map(repr, whole)) and len(whole) == len(DOCS)
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in whole}
    assert got[7] == (12, 0, True) and got[3] == (2, 1, True)


def test_lm_score(spark, docs):
    rows = [*DOCS, *[(100 + i, say(40), "en", "src0", 1, 7, "w", "s") for i in range(60)]]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    fold = [zlib.crc32(str(d[0]).encode() if d[0] is not None else b"") % 10 for d in rows]
    tokens = [[*words(d[1]), None] for d in rows]

    def model(wanted):
        one = Counter(w for f, t in zip(fold, tokens, strict=True) if wanted(f) for w in t)
        two = Counter(p for f, t in zip(fold, tokens, strict=True) if wanted(f) for p in zip([None, *t], t))
        return one, two, sum(one.values()), len(one)

    def parts(m, v, w):
        one, two, n, types = m
        return 1 / (types + 1), one[w] / n, two[v, w] / one[v] if one[v] else 0.0

    seen, c = model(lambda f: f > 1), model(lambda f: f > 0)
    pairs = [p for f, t in zip(fold, tokens, strict=True) if f == 1 for p in zip([None, *t], t)]
    weight = {b: (0.1, 0.4, 0.5) if b else (0.2, 0.8, 0.0) for b in range(64)}
    have = {seen[0][v].bit_length() for v, _ in pairs}
    assert 0 in have and len(have) > 3
    for _ in range(lm_score.ROUNDS):
        new = {b: [1e-3, 1e-3, 1e-3 if b else 0.0] for b in have}
        for v, w in pairs:
            b = seen[0][v].bit_length()
            s = [x * y for x, y in zip(weight[b], parts(seen, v, w), strict=True)]
            for i in range(3):
                new[b][i] += s[i] / sum(s)
        weight.update({b: tuple(x / sum(t) for x in t) for b, t in new.items()})
    for b in range(2, 64):
        if b not in have and b - 1 in have:
            weight[b] = weight[b - 1]
            have.add(b)
    n, types = c[2], c[3]
    expected = []
    for d, f, t in zip(rows, fold, tokens, strict=True):
        lm = sum(np.log10(sum(x * y for x, y in zip(weight[c[0][v].bit_length()], parts(c, v, w), strict=True))) for v, w in zip([None, *t], t))
        expected.append((d[0], f == 0, len(t), sum(c[0][w] > 0 for w in t), n,
                         round(sum(np.log10((c[0][w] + 0.1) / (n + 0.1 * (types + 1))) for w in t), 5), round(lm, 5)))
    for sizes in ({}, {"chunk_bytes": 500, "shard_keys": 300}):  # one chunk a task, and many chunks and shards
        out = lm_score.scores(table, **sizes).withColumn("base_score", F.round("base_score", 5)).withColumn("score", F.round("score", 5))
        check(out, expected, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def test_lm_score_without_training_texts(spark):
    ship(spark)
    row = lm_score.scores(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, 0.0)


def test_encoder_keeps_frequent_pieces(monkeypatch):
    """A full cache lets go of rare pieces alone, and pieces that are encoded as one text get their own ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(packing, "CACHE", 64)
    encode, learnt = packing.Encoder(path), []
    learn = encode.learn
    monkeypatch.setattr(encode, "learn", lambda keys, texts: learnt.extend(texts) or learn(keys, texts))
    whole = Tokenizer.from_file(path)
    for i in range(30):
        text = f"the cat is é12 !! \t x{i} " + " ".join(f"{chr(97 + i % 26)}{w}unusual" for w in VOCABULARY[12 * i:12 * i + 12]) + "\n\n  the cat ..."
        assert encode([text.encode()])[0].tolist() == [*whole.encode(text, add_special_tokens=False).ids, packing.END]
    assert len(encode.at) <= 64 and Counter(learnt)[b" cat"] == 1


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, with_ids=True).collect()
    total = Counter()
    for r in rows:
        assert r.length == len(r.ids) <= 2048 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        total[r.doc_id, r.doc_tokens] += r.length
    ids = [(d[0], [*t.encode(d[1] or "", add_special_tokens=False).ids, 1]) for d in DOCS]
    assert total == Counter({(d, len(x)): len(x) * sum(y == (d, x) for y in ids) for d, x in ids})
    by_id = dict(ids)
    assert all(r.ids == by_id[r.doc_id][r.start:r.start + r.length] for r in rows)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(s)]).tolist()]
        assert [o for o, _ in sorted(s)] == ends[:-1] and ends[-1] <= 2048


def test_added_tokens_in_plain_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["see <|endoftext|> now", "<|endoftext|>", "a<|endoftext|><|endoftext|> b\n", "no marker <|endof text|> here"]
    want = [[*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, packing.END] for t in texts]
    assert [x.tolist() for x in packing.Encoder(path)([t.encode() for t in texts])] == want and 50256 in want[0]


def test_plan_uses_the_histogram():
    hist = np.zeros(2049, np.int64)
    hist[[1000, 1048, 700, 648, 2048, 3]] = [5, 5, 8, 4, 2, 1]
    plan = packing.plan(hist)
    used = Counter()
    for length, _, n, _, _ in plan.tolist():
        used[length] += n
    assert used == {1000: 5, 1048: 5, 700: 8, 648: 4, 2048: 2, 3: 1} and (plan[:, 3] + plan[:, 2]).max() == 5 + 4 + 2 + 1


def test_quality_rules(spark, docs):
    def row(d):
        t = d[1] or ""
        w = words(t, False)
        g = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        rep = {i + j for i in range(len(w) - 2) if g[tuple(w[i:i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        return (d[0], len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(rep),
                len(w) < 50 or 100 * len(rep) > 50 * len(w))

    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (99, 1)], "doc_id long, quality int")
    out = quality_rules.judge(docs, labels)
    check(out, [row(d) for d in DOCS], "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert out.where("kept = base_failed").count() == 0  # too few labels for any cutoff: the base rule alone


def test_binomial_bound(spark):
    from math import comb

    cases = [(k, n) for n in (10, 500, 3000) for k in (0, 1, 5, n // 50) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", quality_rules.within(F.col("k"), F.col("n"), 0.02, 0.01).alias("ok")).collect():
        cdf = sum(comb(r.n, i) * 0.02**i * 0.98**(r.n - i) for i in range(r.k + 1))
        assert r.ok == (r.k <= 0.02 * r.n and cdf <= 0.01)


def test_quality_model_learns(spark):
    ship(spark)
    rows = [(i, say(40 + i % 50) if i % 3 else " ".join(w + "***" for w in say(40).split())) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(None, 1), (9999, 0)], "doc_id long, quality int")
    out = quality_model.classify(spark.createDataFrame(rows + [(5000, None)], "doc_id long, text string"), labels)
    wrong = out.join(labels, "doc_id").where("held_out and predicted != quality").count()
    assert wrong == 0 and out.where("score between 0 and 1").count() == 401
    assert out.where("held_out").count() == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in [*range(400), 5000])


def test_url_filter(spark):
    ship(spark)
    page = lambda *to: "".join(f'<a href="http://{x}/p">x</a>' for x in to)
    rows = [(1, "http://A.net/x", page("bad.test")), (2, "http://example.net/en/", page("good.test")), (3, "https://w.example.com/de/1?q", ""),
            (4, "http://x.org/fr/#f", page("good.test")), (5, "http://good.test/a", None), (6, "http://bad.test/", page("a.net", "b.net")),
            (7, None, page("a.net")), (8, "nothing", ""), (9, "http://b.net", ""), (10, "http://notnet/", ""), (9, "http://b.net", ""),
            (11, "http://b.net/?x", "")]
    got = {r.page_id: r for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in (1, 2, 3, 4, 7, 8, 9, 10)] == [
        ("a.net", "/x", "net/"), ("example.net", "/en/", "example.net/en/"), ("w.example.com", "/de/1", "example.com/de/"),
        ("x.org", "/fr/", "org/fr/"), ("", "", None), ("", "", None), ("b.net", "", None), ("notnet", "/", None)]
    assert got[6].verdict == "block" and got[6].distrust > 0 and got[5].verdict == "allow" and got[5].trust > 0


def page_rank(pages):
    """Verdicts and ranks of (page_id, url, links), host by host."""
    host = lambda u: re.match("[^/?#]*", u.split("://", 1)[1])[0].lower() if u and "://" in u else ""
    path = lambda u: re.match("[^/?#]*([^?#]*)", u.split("://", 1)[1])[1] if u and "://" in u else ""
    rules, edges, seeds, judged = dict(url_filters.RULES), set(), {"allow": Counter(), "block": Counter()}, {}
    for i, u, to in pages:
        h = host(u)
        fit = [r for r in rules if (h + "/").endswith("." + r.split("/")[0] + "/") or h == r.split("/")[0]]
        fit = [r for r in fit if path(u).startswith("/" + r.split("/", 1)[1])]
        judged[i] = h, rules[max(fit, key=len)] if fit else None
        if fit and h:
            seeds[judged[i][1]][h] += 1
        edges |= {(h, t.lower()) for t in to if h and h != t.lower()}
    nodes = {h for h, _ in judged.values() if h} | {x for e in edges for x in e}
    for h in list(nodes):
        while h.count(".") > 1 and not re.fullmatch("[0-9.:]+", h):
            up = h.split(".", 1)[1]
            edges |= {(h, up), (up, h)}
            nodes.add(up)
            h = up

    def spread(first, along):
        degree, start = Counter(a for a, _ in along), {h: 10**12 * n // sum(first.values()) for h, n in first.items()}
        now = dict(start)
        for _ in range(url_filters.ROUNDS):
            new = Counter({h: r * 15 // 100 for h, r in start.items()})
            for a, b in along:
                if a in now:
                    new[b] += now[a] * 85 // (100 * degree[a])
            now = dict(new)
        return now

    trust, distrust = spread(seeds["allow"], edges), spread(seeds["block"], {(b, a) for a, b in edges})
    bad = lambda h: distrust.get(h, 0) > trust.get(h, 0) and distrust.get(h, 0) > 10**12 // len(nodes)
    return [(i, v or ("block" if bad(h) else "allow"), trust.get(h, 0), distrust.get(h, 0)) for i, (h, v) in judged.items()]


def test_url_filter_ranks(spark):
    r = random.Random(5)
    names = ["bad.net", "a.net", "fair.org", "x.fair.org", "w.example.com", "v.w.example.com", "m.example.net", "one.io", "two.io", "three.io",
             "10.0.0.7", "plain", "a.b.c.d.info"]
    pages = [(i, f"https://{r.choice(names)}{r.choice(['/fr/1', '/en/2', '/de/3', '', '/x?y'])}",
              [r.choice(names) for _ in range(r.choice((0, 0, 1, 2)))]) for i in range(80)]
    # no rule fits far.io or near.io: far links near, near links a blocked host
    pages += [(90, "http://far.io/", ["near.io"]), (91, "HTTP://near.io/a", ["spam.net"]), *[(200 + i, "http://spam.net/", []) for i in range(60)],
              (92, None, ["a.net"]), (93, "nothing", []), (94, "ftp://one.io/en/", ["TWO.io"])]
    html = lambda to: "<a href='/here'>" + "".join(f'<a HREF = "{r.choice(["http:", "", "ftp:"])}//{t}/p">' for t in to)
    rows = [(i, u, html(to), "clash", 1) for i, u, to in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rank int").repartition(3)
    expected = page_rank(pages)
    got = {i: v for i, v, _, _ in expected}
    assert got[90] == got[91] == "block" and got[93] == "allow"  # blocked through one and two links
    for hub in (url_filters.HUB, 1):  # without and with salted hubs
        check(url_filters.judge(df, hub=hub), expected, "page_id", "verdict", "trust", "distrust")


def test_warc_round_trip(spark, tmp_path):
    ship(spark)
    trap = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    copy = "é" * 60
    rows = [(1, "u", None), (2, "u\r\nX: y", trap * 5), (3, None, copy), (4, "u", copy), (3, "u", copy), (5, "u", "short"), (6, "u", "short"),
            (None, "u", copy), (7, "u", "y" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    files = warc.archive(df, str(tmp_path), 3000)
    expected = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = 3 if h == copy and i != 3 else None
        expected.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if first else "response", first))
    for block in (64, 1000, 1 << 20):
        check(warc.read(files, block), expected, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert warc.read(files, 1000).rdd.getNumPartitions() == sum(-(-r.length // 1000) for r in files.collect())
    clash = df.selectExpr("*", "1 AS digest", "2 AS bytes", "'x' AS path", "3 AS start")
    check(warc.read(warc.archive(clash, str(tmp_path), 3000)), expected, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    none = warc.archive(df.limit(0), str(tmp_path), 3000)
    assert none.count() == 0 and warc.read(none).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id in (11, 12, 13, 14)) == [11]
    apart = spark.createDataFrame([(7, BASE), (7, say(90)), (None, BASE), (None, "")], "doc_id long, text string")
    left = corpus_pipeline.near_duplicates(spark, apart, str(tmp_path))  # two different texts of one doc_id both stay
    assert sorted((r.doc_id or 0, len(r.text)) for r in left.collect()) == sorted([(7, len(BASE)), (7, len(apart.collect()[1].text)), (0, 0)])
    clean = corpus_pipeline.benchmark_passages(spark, kept, str(tmp_path))
    assert clean.columns == docs.columns and clean.where("doc_id = 15").count() == 0 and clean.count() == kept.count() - 1
    cut = corpus_pipeline.repeated_passages(spark, clean, str(tmp_path))
    assert cut.columns == docs.columns and cut.where(F.col("text").contains(PASSAGE[50:100])).count() == 0
    assert corpus_pipeline.quality(spark, cut, str(tmp_path)).columns == docs.columns
