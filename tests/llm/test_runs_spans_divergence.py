"""Periodic runs, substring dedup and source divergence against brute force, with the awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from seqlab.llm import periodic_runs, source_divergence, substring_dedup
from seqlab.llm.common import NONSPACE, Words, ship

SCHEMA = "doc_id long, text string, lang string, source string, n long, runs string, name string, row string, spans int"
_r = random.Random(11)
VOCABULARY = ["".join(_r.choice("abcdeéx̂中") for _ in range(_r.randint(1, 6))) for _ in range(300)]
say = lambda n: [_r.choice(VOCABULARY) for _ in range(n)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def table(spark, rows, lang="en", source="s"):
    ship(spark)
    return spark.createDataFrame([(i, t, lang, source, 1, "r", "n", "w", 5) for i, t in rows], SCHEMA).repartition(3)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- runs -------------------------------------------------------------------------------------------------------


def runs_of(w, least=12):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and not any(s == i and n == j + q - i for s, n, _ in out):
                out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out)


def collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


@pytest.mark.parametrize("least", [2, 4, 12])
def test_runs_of_random_words(least):
    for _ in range(150):
        texts = []
        for _ in range(_r.randint(1, 4)):
            w = [_r.choice("abcdef"[:_r.choice([1, 2, 2, 3, 6])]) for _ in range(_r.choice([0, 1, 5, 14, 40, 90]))]
            if w and _r.random() < 0.6:
                a = _r.randrange(len(w))
                p = 1 + (len(w) - a) // _r.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            texts.append(w)
        symbol, first = periodic_runs.symbols(Words([" ".join(w).encode() for w in texts], NONSPACE, False))
        want = sorted((int(f) + s, n, q) for f, w in zip(first, texts) for s, n, q in runs_of(w, least))
        assert periodic_runs.find_runs(symbol, least) == want


def test_fibonacci_words_have_all_their_runs():
    a, b = ["x"], ["x", "y"]
    while len(b) < 300:
        a, b = b, b + a
    symbol, _ = periodic_runs.symbols(Words([" ".join(b).encode()], NONSPACE, False))
    assert periodic_runs.find_runs(symbol, 2) == runs_of(b, 2)


def test_detect_with_awkward_rows(spark):
    long = say(400)
    thue = ["".join("ab"[bin(i).count("1") % 2 ^ f] for i in range(2048)) for f in (0, 1)]  # polynomial hashes can't tell these apart
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (None, "x y " * 9), (5, "It " * 700), (5, "It " * 700), (6, " ".join(long * 3)),
            (7, "a\tb\nc\x0b" * 4 + "tail"), (8, " ".join(thue) + " " + " ".join(thue[::-1])), (9, " ".join([thue[0]] * 6 + [thue[1]] * 6)),
            (10, " ".join(say(30) + ["é", "ö"] * 8 + say(30))), (11, "A a " * 6)]
    got = Counter((r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed)
                  for r in periodic_runs.detect(table(spark, rows)).collect())
    assert got == Counter((i, len(w), tuple(runs_of(w)), collapsed(w, runs_of(w))) for i, t in rows for w in [words(t)])
    assert periodic_runs.detect(table(spark, rows).limit(0)).count() == 0


def test_a_long_text_alone(spark):
    """Over CHUNK_BYTES; one run of a third of it."""
    block = say(20_000)
    w = say(150_000) + block * 4 + say(70_000)
    (got,) = periodic_runs.detect(table(spark, [(1, " ".join(w))])).collect()
    assert len(" ".join(w).encode()) > 1 << 20
    big = max(got.runs, key=lambda r: r.length)
    assert (big.period, got.n_words) == (20_000, len(w)) and big.length >= 80_000
    assert len(words(got.collapsed)) <= len(w) - 60_000
    symbol = periodic_runs.symbols(Words([b"a b " * 200_000], NONSPACE, False))[0]
    assert periodic_runs.find_runs(symbol) == [(0, 400_000, 2)]


def test_op11_digests(spark, tmp_path):
    rows = [(i, " ".join(say(_r.choice([0, 3, 40, 200])))) for i in range(150)] + [(None, "a b " * 8), (7000, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in periodic_runs.op11(spark, str(tmp_path)).collect()}
    changed = 0
    for i, t in rows:
        w = words(t)
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            changed += 1
        runs = runs_of(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs)))
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want
    assert changed > 5


# ---- substrings -------------------------------------------------------------------------------------------------


def cut(rows, least=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - least + 1):
            if i is not None:
                x = tuple(w[k:k + least])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - least + 1):
            if i is not None and first[tuple(w[k:k + least])] < i:
                gone.update(range(k, k + least))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


def results(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


def corpus():
    passage, other = say(60), say(13)
    base = say(200)
    near = lambda: " ".join(x if _r.random() > 0.03 else "zz" for x in base)
    rows = [(0, None), (1, ""), (2, "  "), (3, " ".join(say(12))), (None, " ".join(passage)), (4, "It " * 300), (5, "It " * 200), (5, "It " * 200)]
    rows += [(10 + i, " ".join(say(_r.randint(0, 40)) + passage + say(_r.randint(0, 40)))) for i in range(25)]
    rows += [(50 + i, " ".join(base)) for i in range(4)] + [(60 + i, near()) for i in range(25)]
    rows += [(90, " ".join(other)), (91, "\n\n".join(other)), (92, " ".join(other[:12])), (93, " ".join(say(3) + other + other + say(3)))]
    rows += [(100, " ".join(passage)), (100, " ".join(passage[:30] + say(20))), (8, " ".join(passage[20:50]))]
    return rows


def test_shared_names_are_written_before_the_occurrences_are_shuffled(spark, monkeypatch):
    """So the shuffles of both are not on disk at once."""
    steps = []
    staged, released = substring_dedup.staged, substring_dedup.released
    monkeypatch.setattr(substring_dedup, "staged", lambda df, name: steps.append(name) or staged(df, name))
    monkeypatch.setattr(substring_dedup, "released", lambda s: steps.append("released") or released(s))
    rows = [(i, " ".join(f"w{j}" for j in range(i, 40))) for i in range(3)]
    assert substring_dedup.removed(table(spark, rows)).where("n_removed > 0").count() == 2
    assert steps[:4] == ["occurrences", "names", "released", "shared"]


def test_texts_of_passages_are_shuffled_once_and_released(spark, monkeypatch):
    """Also where names are taken apart: each shuffle is gone before the next table is written."""
    steps = []
    for name, step in (("staged", lambda df, name: name), ("released", lambda s: "released"), ("keyed", lambda docs: "read")):
        monkeypatch.setattr(substring_dedup, name, lambda *a, f=getattr(substring_dedup, name), step=step: steps.append(step(*a)) or f(*a))
    rows = corpus()
    assert results(substring_dedup.removed(table(spark, rows), shard=300)) == cut(rows)
    assert steps.count("read") == 3  # for the occurrences, the passages and the result
    shuffled = steps[steps.index("passages"):]
    assert shuffled == ["passages", "released", "sized", "released", "read", "texts", "released", "windows", "keys", "released", "covered", "released"]


@pytest.mark.parametrize("shard", [substring_dedup.SHARD, 300, 40])
def test_removed_is_brute_force(spark, shard):
    """With small shards the passages of full names are taken apart into windows."""
    rows = corpus()
    assert results(substring_dedup.removed(table(spark, rows), shard=shard)) == cut(rows)
    assert substring_dedup.removed(table(spark, rows).limit(0)).count() == 0


def test_shorter_windows(spark):
    rows = [(i, " ".join(_r.choice("abc") for _ in range(40))) for i in range(20)]
    assert results(substring_dedup.removed(table(spark, rows), least=6, gram=3)) == cut(rows, 6)


def test_long_periodic_and_long_plain_texts(spark):
    """Passages longer than LONG, and texts over CHUNK_BYTES."""
    block = say(7)
    plain = say(300_000)
    rows = [(1, " ".join(block * 3000)), (2, " ".join(block * 2500 + say(20))), (3, " ".join(plain)), (4, " ".join(say(50) + plain[1000:250_000]))]
    got = {r.doc_id: (r.n_words, r.n_removed, [(s.a, s.b) for s in r.spans]) for r in substring_dedup.removed(table(spark, rows)).collect()}
    assert got[1][1] == got[3][1] == 0
    assert got[2][1] >= 17_500 and got[2][2][0][0] == 0
    assert got[4] == (249_050, 249_000, [(50, 249_050)])


def test_automaton_matches_only_what_was_inserted():
    for _ in range(200):
        known = [[_r.randrange(3) for _ in range(_r.randint(0, 12))] for _ in range(3)]
        machine = substring_dedup.Automaton()
        for k in known:
            machine.insert(k)
        text = [_r.randrange(3) for _ in range(25)]
        parts = {tuple(k[a:b]) for k in known for a in range(len(k)) for b in range(a + 3, len(k) + 1)}
        hit = {x for a in range(25) for b in range(a + 3, 26) if tuple(text[a:b]) in parts for x in range(a, b)}
        assert {x for a, b in machine.spans(text, 3) for x in range(a, b)} == hit


# ---- divergence -------------------------------------------------------------------------------------------------


def audited(rows, least, top):
    """rows: (text, lang, source)."""
    found = defaultdict(Counter)
    docs = Counter()
    rows = [tuple(x or "" for x in r) for r in rows]
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        found[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {x for x, _ in found}:
        kept = [t for x, t in docs if x == lang and docs[x, t] >= least]
        sources = sorted(s for x, s in found if x == lang)
        total = sum((found[lang, s] for s in sources), Counter())
        share = lambda c, n: 1 + 1_000_000_000 * (c + 2) // (n + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        n = {s: sum(found[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(found[lang, s][t], n[s]) for t in kept} for s in sources}
        q = {t: share(total[t], sum(n.values())) for t in kept}
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            for part, some, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                some = sorted(some, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(some)]
    return Counter(out)


@pytest.mark.parametrize("least, top", [(10, 10), (2, 3), (1, 10)])
def test_audit_is_brute_force(spark, least, top):
    ship(spark)
    rows = [(" ".join(_r.choice(VOCABULARY[:int(2 + 298 * _r.random() ** 3)]) for _ in range(_r.randint(0, 60))),
             _r.choice(["en", "en", "de", None, ""]), _r.choice(["a", "b", "b", "c", "É", "z", None])) for _ in range(120)]
    rows += [(None, "fr", "only"), ("", "fr", "other"), ("1 2 3 !", "it", "x"), ("Über ÜBER uber A1b\x00c", "en", "a"), (rows[0])]
    df = spark.createDataFrame([(i, *r, 1, "x", "y") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, p long, item string, value string")
    got = Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in source_divergence.audit(df.repartition(4), least, top).collect())
    assert got == audited(rows, least, top)
    assert source_divergence.audit(df.limit(0), least, top).count() == 0


def test_tree_counts_shared_paths_once():
    """Equal beginnings are one node: the number of node-ancestor combinations is that of the tree, not of the rows."""
    import numpy as np

    paths = [("x", [(1, 5), (2, 5), (3, 9)]), ("x", [(1, 5), (2, 5), (3, 9), (4, 7)]), ("x", [(1, 5), (2, 6)]), ("y", [(1, 5), (2, 6)])]
    times = np.array([3, 1, 4, 2])
    flat = [i for _, p in paths for i in p]
    begin = np.concatenate([[0], np.cumsum([len(p) for _, p in paths])])
    args = (np.array([0 if x == "x" else 1 for x, _ in paths]), begin, np.array([a for a, _ in flat]), np.array([b for _, b in flat]), np.full(len(flat), 2))
    got = Counter()
    for row, a, b, value in source_divergence.tree_corrections(*args, times):
        for r, x, y, v in zip(row.tolist(), a.tolist(), b.tolist(), value.tolist()):
            got[paths[r][0], x, y] += v
    f = lambda p, q: (p - q) ** 2 // (p + q)
    want = Counter()
    for (lang, path), n in zip(paths, times.tolist()):
        for j, (b, q) in enumerate(path):
            for a, p in path[:j]:
                want[lang, a, b] += n * (f(p, q) - f(p, 2) - f(2, q) + f(2, 2))
    assert got == want
