"""The model of order n against plain Python: counts, backoff, probabilities that add up to one, losses, completions."""

import math
import random
from collections import Counter, defaultdict

import pytest

from seqlab.operators import order_n as ON

_r = random.Random(8)
TEXTS = [(None, "a b c"), (None, "a b"), ("x", ""), ("x", None), ("x", " \n"), ("x", "lone"), ("y", "a a a a a"), ("y", "é b a  b\ta")]
TEXTS += [("x", " ".join(_r.choice("abcde") for _ in range(_r.randint(1, 30)))) for _ in range(25)]
HELD = [(1, None, "a b c d"), (2, "x", "a b q c"), (3, "x", "z z z"), (4, "x", "a"), (5, "x", None), (6, "none", "a b c"), (7, "y", "a a b é b a"), (8, "x", "b a c e d a b")]


class Plain:
    """For one key: counts by context, mixed from the shortest context up."""

    def __init__(self, texts, order):
        self.order, self.after = order, defaultdict(Counter)
        for t in texts:
            w = (t or "").split()
            for i, x in enumerate(w):
                for k in range(min(order, i + 1)):
                    self.after[tuple(w[i - k:i])][x] += 1

    def p(self, before, w):
        c = self.after[()]
        p = (c[w] + ON.ALPHA) / (sum(c.values()) + ON.ALPHA * (len(c) + 1))
        for k in range(1, self.order):
            c = self.after.get(tuple(before[len(before) - k:])) if len(before) >= k else None
            if c:
                p = (c[w] + len(c) * p) / (sum(c.values()) + len(c))
        return p


@pytest.fixture(scope="module", params=[1, 2, 3, 4])
def both(spark, request):
    df = spark.createDataFrame(TEXTS, "lang string, text string").repartition(3)
    keys = {k for k, t in TEXTS if (t or "").split()}
    return ON.estimate(df, ["lang"], request.param), {k: Plain([t for x, t in TEXTS if x == k], request.param) for k in keys}


def test_counts_and_links(both):
    model, plain = both
    got = {(r.lang, r.ctx, r.next): r.n for r in model.counts.collect()}
    assert got == {(k, " ".join(c), w): n for k, m in plain.items() for c, f in m.after.items() for w, n in f.items()}
    totals = {(r.lang, r.ctx): (r.k, r.shorter, r.total, r.types) for r in model.totals.collect()}
    assert totals == {(k, " ".join(c)): (len(c) + 1, " ".join(c[1:]) if c else None, sum(f.values()), len(f)) for k, m in plain.items() for c, f in m.after.items() if f}


def test_probabilities_back_off_and_add_up(spark, both):
    model, plain = both
    prefixes = ["", "a", "a b", "a b c d a", "q", "q a", "c q", None]
    words = ["a", "b", "c", "d", "e", "lone", "é", "unseen"]
    tests = [(k, p, w) for k in plain for p in prefixes for w in words] + [("none", "a", "b")]
    got = ON.next_token_probs(model, spark.createDataFrame(tests, "lang string, prefix string, token string")).collect()
    assert len(got) == len(tests) - 1
    for r in got:
        assert math.isclose(r.prob, plain[r.lang].p((r.prefix or "").split(), r.token), rel_tol=1e-9)
    for k, m in plain.items():  # all words and one that was never seen
        for p in prefixes:
            assert math.isclose(sum(m.p((p or "").split(), w) for w in m.after[()]) + m.p((p or "").split(), "\0"), 1)


def test_losses_of_texts(spark, both):
    model, plain = both
    held = spark.createDataFrame(HELD, "id int, lang string, text string")
    got = {r.id: (r.loss_sum, r.n_tokens) for r in ON.text_losses(model, held, ["id"]).collect()}
    want = {}
    for i, k, t in HELD:
        w = (t or "").split()
        if k in plain and len(w) > 1:
            want[i] = (-sum(math.log(plain[k].p(w[:j], w[j])) for j in range(1, len(w))), len(w) - 1)
    assert got.keys() == want.keys()
    for i, (loss, n) in want.items():
        assert got[i][1] == n and math.isclose(got[i][0], loss, rel_tol=1e-9)
    assert ON.text_losses(model, held.limit(0), ["id"]).count() == 0


def test_completion(spark, both):
    model, plain = both
    held = spark.createDataFrame(HELD, "id int, lang string, text string")
    got = {r.lang: (r.rival, r.n_correct, r.n_total) for r in ON.completion(model, held).collect()}
    want = {}
    for k, m in plain.items():
        rival = max(m.after[()], key=lambda w: (m.after[()][w], w.encode()))
        places = [(w[:j], w[j]) for _, x, t in HELD if x == k for w in [(t or "").split()] for j in range(1, len(w)) if w[j] != rival]
        if places:
            want[k] = (rival, sum(m.p(b, w) > m.p(b, rival) for b, w in places), len(places))
    assert got == want


def test_an_empty_corpus(spark):
    none = spark.createDataFrame([], "lang string, text string")
    model = ON.estimate(none, ["lang"])
    assert model.counts.count() == model.totals.count() == ON.sizes(model).count() == 0
    assert ON.completion(model, none).count() == 0


def test_a_hot_context_is_dealt_by_salt(spark):
    """Under one context stand most sequences; no task of the join with its total holds them all."""
    rows = [("x", f"hot w{i}") for i in range(4000)] + [("x", f"c{i} w{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "lang string, text string")
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(old, ("-1", "false", "16")):
            spark.conf.set(c, v)
        model = ON.estimate(df, ["lang"], 2)
        asked = ON.sequences(df, ["lang"], 2).where("pos > 0")
        sizes = ON.probabilities(model, asked).rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
        assert sum(sizes) == 4400 and max(sizes) < 2200
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_tables_of_the_model_are_small_on_disk(spark):
    """What is written of a model takes a few times the text, not a serialised row for every sequence."""
    from pathlib import Path

    from seqlab.session import scratch_path
    r = random.Random(5)
    texts = [("x", " ".join(f"w{r.randrange(3000)}" for _ in range(500))) for _ in range(200)]
    base = Path(scratch_path(spark, "x").removeprefix("file:")).parent
    size = lambda: sum(f.stat().st_size for f in base.rglob("*") if f.is_file())
    old = size()
    model = ON.estimate(spark.createDataFrame(texts, "lang string, text string").repartition(4), ["lang"])
    assert model.counts.where("k = 3").count() == len({tuple(w[i:i + 3]) for _, t in texts for w in [t.split()] for i in range(len(w) - 2)})
    assert size() - old < 4 * sum(len(t) for _, t in texts)


@pytest.mark.parametrize("few", [-1, 2**19])
def test_many_and_few_sequences_are_looked_up_alike(spark, monkeypatch, few):
    """With the sieve and without it: losses, completions and tests of all keys, the null key among them."""
    monkeypatch.setattr(ON, "FEW", few)
    df = spark.createDataFrame(TEXTS, "lang string, text string").repartition(3)
    both = ON.estimate(df, ["lang"]), {k: Plain([t for x, t in TEXTS if x == k], 3) for k in {k for k, t in TEXTS if (t or "").split()}}
    test_counts_and_links(both)
    test_probabilities_back_off_and_add_up(spark, both)
    test_losses_of_texts(spark, both)
    test_completion(spark, both)


def test_a_hot_context_of_many_sequences_is_dealt_by_salt(spark, monkeypatch):
    monkeypatch.setattr(ON, "FEW", -1)
    test_a_hot_context_is_dealt_by_salt(spark)


def looked_up(spark, monkeypatch, few: int):
    monkeypatch.setattr(ON, "FEW", few)
    df = spark.createDataFrame(TEXTS, "lang string, text string")
    asked = ON.sequences(df, ["lang"]).where("pos > 0").select("lang", "next", "c2", "c3").distinct()
    return ON.probabilities(ON.estimate(df, ["lang"]), asked)._jdf.queryExecution()


def test_counts_are_sieved_by_few_sequences_before_a_shuffle(spark, monkeypatch):
    """All counts were shuffled for any number of sequences."""
    plan = looked_up(spark, monkeypatch, 2**19).optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 5 and plan.count("rightHint=(strategy=broadcast)") == 5  # counts of each order, totals of two


def test_one_order_of_many_sequences_is_shuffled_at_a_time(spark, monkeypatch):
    """The joins of all orders were one plan, so all their shuffles were on disk together."""
    assert looked_up(spark, monkeypatch, -1).optimizedPlan().toString().count("Join") <= 2


def test_completion_looks_the_counts_up_once(spark, monkeypatch):
    calls, plain = [], ON.probabilities
    monkeypatch.setattr(ON, "probabilities", lambda *a: calls.append(a) or plain(*a))
    model = ON.estimate(spark.createDataFrame(TEXTS, "lang string, text string"), ["lang"])
    assert ON.completion(model, spark.createDataFrame(HELD, "id int, lang string, text string")).count() == 3 and len(calls) == 1
