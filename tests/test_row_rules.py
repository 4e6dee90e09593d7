"""Rules over ordered rows and ordered scans against plain Python, with a hot key, null keys and long sequences."""

import random

import pytest
from pyspark.sql import functions as F

from seqlab.operators import row_rules as RR
from seqlab.operators import scan

_r = random.Random(5)
OPEN, CLOSE, INNER = "o", "c", ["a", "b", "d"]


def walk(rule, tokens):
    """(lost, valid) by running the automaton, and the two conditions on the tokens themselves."""
    state, lost, upto = 0, None, len(tokens)
    for i, t in enumerate(tokens):
        if rule.closes and state in rule.accept:
            break
        if lost is None:
            nxt = rule.moves[state].get(t)
            if nxt is None:
                lost = i
            else:
                state = nxt
    ok = lost is None and state in rule.accept
    if rule.closes and rule.closes in tokens:
        upto = tokens.index(rule.closes) + 1
    seen = tokens[:upto]
    if rule.even:
        ok = ok and all(seen.count(t) % 2 == 0 for t in rule.even)
    if rule.mirrored:
        inner = seen[1:-1]
        ok = ok and inner == inner[::-1]
    return lost, ok


RULES = [RR.run_rule("run", OPEN, ["a", "b"], CLOSE), RR.run_rule("few", OPEN, ["a"], CLOSE, 3), RR.run_rule("begin", OPEN, ["a", "b"], CLOSE, prefix=True),
         RR.pair_rule("pairs", {"a": ["b", "c"], "b": ["a"]}, 2), RR.pair_rule("many", {"a": ["b"], "b": ["a", "d"]}),
         RR.mirror_rule("mirror", OPEN, INNER, CLOSE, ["a"]), RR.mirror_rule("mirror begin", OPEN, INNER, CLOSE, ["a", "d"], prefix=True)]


def sequences():
    out = [[], ["o", "c"], ["o"], ["c"], ["o", "a", "a", "c"], ["o", "a", "b", "c"], ["o", "a", "b", "b", "a", "c"], ["o", "a", "c", "b"], ["a", "b"], ["a", "b", "b", "a"]]
    for _ in range(60):
        half = [_r.choice(INNER) for _ in range(_r.randint(0, 5))]
        out.append(["o", *half, *half[::-1], "c", *[_r.choice(["a", "c", "x"]) for _ in range(_r.randint(0, 2))]])
        out.append([_r.choice(["o", "c", "a", "b", "d", "x", None]) for _ in range(_r.randint(1, 8))])
        out.append(["o", *["a"] * _r.randint(0, 5), "c"])
    return [s for s in out if s]


@pytest.mark.parametrize("block", [2, 256])
@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.name)
def test_judge_is_the_automaton(spark, monkeypatch, rule, block):
    monkeypatch.setattr(RR, "BLOCK", block)
    some = sequences()
    rows = [(k if k else None, i * 3, t, 1, "x") for k, s in enumerate(some) for i, t in enumerate(s)]
    _r.shuffle(rows)
    df = spark.createDataFrame(rows, "who long, at int, what string, n int, pos string")
    got = {r.who: (r.n, r.lost, r.valid) for r in RR.judge(df, ["who"], ["at"], "what", rule, parts=5).collect()}
    want = {k or None: (len(s), *walk(rule, s)) for k, s in enumerate(some)}
    assert got == want
    assert {v for _, _, v in want.values()} == {True, False}


def test_empty_and_compound_keys(spark):
    df = spark.createDataFrame([(None, "x", 1, "o"), (None, "x", 2, "c"), (0, "x", 1, "o"), (None, None, 1, "c"), (None, "", 1, "o")],
                               "a int, b string, t int, k string")
    rule = RULES[5]
    got = {(r.a, r.b): (r.n, r.lost, r.valid) for r in RR.judge(df, ["a", "b"], ["t"], "k", rule).collect()}
    assert got == {(None, "x"): (2, None, True), (0, "x"): (1, None, False), (None, None): (1, 0, False), (None, ""): (1, None, False)}
    assert RR.judge(df.limit(0), ["a", "b"], ["t"], "k", rule).count() == 0


def test_a_hot_key_spans_partitions(spark):
    """A key with most rows lies in several range partitions, and its mirror image is found at 1,000,000 rows."""
    n = 1_000_000
    token = F.expr(f"if(id = 0, 'o', if(id = {n - 1}, 'c', element_at(array('a', 'b', 'd'), int(1 + pmod(hash(least(id, {n - 1} - id)), 3)))))")
    hot = spark.range(n).select(F.lit(7).alias("k"), "id", token.alias("t"))
    cold = spark.range(3000).select((F.col("id") % 500 + 10).cast("int").alias("k"), "id", F.lit("a").alias("t"))
    rows = hot.union(cold)
    spans = scan.ranged(rows, ["k", "id"], 8).where("k = 7").select(scan.PART).distinct().count()
    assert spans >= 7
    rule = RR.mirror_rule("m", OPEN, INNER, CLOSE, [])
    assert [tuple(r) for r in RR.judge(rows, ["k"], ["id"], "t", rule, 8).where("k = 7").collect()] == [(7, n, None, True)]
    bad = rows.withColumn("t", F.when((F.col("k") == 7) & (F.col("id") == 400_000), "x").otherwise(F.col("t")))
    assert [tuple(r) for r in RR.judge(bad, ["k"], ["id"], "t", rule, 8).where("k = 7").collect()] == [(7, n, 400_000, False)]
    swapped = rows.withColumn("t", F.when((F.col("k") == 7) & (F.col("id") == 5), F.expr("if(t = 'a', 'b', 'a')")).otherwise(F.col("t")))
    assert [tuple(r) for r in RR.judge(swapped, ["k"], ["id"], "t", rule, 8).where("k = 7").collect()] == [(7, n, None, False)]


def test_equal_sums_do_not_decide(spark, monkeypatch):
    """With sums that always agree the comparison of tokens alone decides."""
    monkeypatch.setattr(RR, "BASES", (1, 1))
    df = spark.createDataFrame([(k, i, t) for k, s in enumerate(["oabc", "oaabbc", "oabbac", "oc"]) for i, t in enumerate(s)], "k int, i int, t string")
    got = {r.k: r.valid for r in RR.judge(df, ["k"], ["i"], "t", RR.mirror_rule("m", "o", ["a", "b"], "c", [])).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True}


def test_positions_and_totals(spark):
    values = [_r.randint(-5, 500) * 10 for _ in range(700)]
    df = spark.createDataFrame([(v, i, _r.randint(0, 3)) for i, v in enumerate(values)], "v long, i long, g int").repartition(7)
    ordered = sorted((v, i) for i, v in enumerate(values))
    got = scan.numbered(df, ["v", "i"], parts=6)
    assert sorted((r.pos, r.v, r.i) for r in got.collect()) == [(p, *x) for p, x in enumerate(ordered)]
    weight = {r.i: r.g for r in df.collect()}
    total, want = 0, {}
    for _, i in ordered:
        want[i], total = total, total + weight[i]
    sums = scan.running_total(df, ["v", "i"], "g", "before", parts=6)
    assert {r.i: r.before for r in sums.collect()} == want
    plan = sums._jdf.queryExecution().toString() + got._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert scan.numbered(df.limit(0), ["v"]).count() == scan.running_total(df.limit(0), ["v"], "g", "b").count() == 0
