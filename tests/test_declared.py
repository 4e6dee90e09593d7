"""Rule sets declared by tokens and limits: registered after use, as texts and as rows, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from seqlab.functions import text as T
from seqlab.operators import row_rules as RR
from seqlab.operators import rules as R
from seqlab.operators.declared import Declared

_r = random.Random(21)
RULES = [Declared("free", "run", "(", ("x", "y+"), ")", lenient=True), Declared("short", "run", "GO", ("on",), "stop.", most=2, tag=("<r>", "</r>"), lenient=True, punct=True),
         Declared("two", "pairs", pairs={"a": ["b", "c"], "b": ["a$"]}, most=2), Declared("endless", "pairs", pairs={"a": ["b"], "c|d": ["a"]}),
         Declared("echo", "mirror", "[", ("u", "v", "w"), "]", even=("v",), lenient=True)]


def judged(rule, w):
    """(strict, lenient, violation) of tokens."""
    if rule.kind == "pairs":
        some = [w[i:i + 2] for i in range(0, len(w), 2)]
        broken = next((p for p in some if len(p) < 2 or p[1] not in rule.pairs.get(p[0], [])), None)
        v = ("empty" if not w else "odd_length" if len(w) % 2 else ("bad_first" if broken[0] not in rule.pairs else "bad_second") if broken else
             "too_many_pairs" if rule.most and len(some) > rule.most else "valid")
        return v == "valid", None, v

    def whole(t):
        least = 2 if rule.kind == "mirror" else 3
        if len(t) < least:
            return "too_short"
        if t[0] != rule.opens:
            return "bad_open"
        if t[-1] != rule.closes:
            return "bad_close"
        inner = t[1:-1]
        if any(x not in rule.middle for x in inner):
            return "bad_middle"
        if rule.kind == "mirror":
            return "not_mirrored" if inner != inner[::-1] else "odd_count" if any(inner.count(x) % 2 for x in rule.even) else "valid"
        return "too_long" if rule.most and len(inner) > rule.most else "valid"

    v = whole(w)
    return v == "valid", rule.closes in w and whole(w[:w.index(rule.closes) + 1]) == "valid", v


def sentences(rule):
    t = rule.tokens() + ["??"]
    out = [[], t[:1], t[:2], t[:3]]
    for _ in range(150):
        out.append([_r.choice(t) for _ in range(_r.randint(1, 7))])
        if rule.kind == "pairs":
            out.append([x for _ in range(_r.randint(1, 4)) for a in [_r.choice(list(rule.pairs))] for x in (a, _r.choice(rule.pairs[a]))])
        else:
            half = [_r.choice(rule.middle) for _ in range(_r.randint(0, 3))]
            out.append([rule.opens, *half, *(half[::-1] if rule.kind == "mirror" else []), rule.closes, *_r.choice([[], [], ["??"], [rule.closes]])])
    return out


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.name)
def test_predicates(spark, rule):
    some = sentences(rule)
    spec = rule.spec()
    df = spark.createDataFrame([(i, "  ".join(w)) for i, w in enumerate(some)], "i int, text string").withColumn("n", T.ws_norm(F.col("text")))
    lenient = spec.lenient_norm(F.col("n")) if rule.lenient else F.lit(None).cast("boolean")
    got = {r.i: (r.s, r.l, r.v) for r in df.select("i", spec.strict_norm(F.col("n")).alias("s"), lenient.alias("l"), spec.violation_norm(F.col("n")).alias("v")).collect()}
    want = {i: judged(rule, w) for i, w in enumerate(some)}
    assert got == {i: (s, l if rule.lenient else None, v) for i, (s, l, v) in want.items()}
    assert len({v for _, _, v in want.values()}) >= 4 and {s for s, _, _ in want.values()} == {True, False}


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.name)
def test_rows_say_the_same(spark, rule):
    some = [w for w in sentences(rule) if w]
    rows = spark.createDataFrame([(k, i, t) for k, w in enumerate(some) for i, t in enumerate(w)], "k int, i int, t string")
    got = {r.k: r.valid for r in RR.judge(rows, ["k"], ["i"], "t", rule.rows()).collect()}
    assert got == {k: judged(rule, w)[0] for k, w in enumerate(some)}


def test_a_rule_registered_after_use(spark):
    texts = [("grammar1", "START MID END"), ("grammar1", "START END"), ("short", "x <r> GO on stop. </r> y"), ("short", "<r> GO on (stop.) more"), ("short", "GO on\nstop."),
             ("free", "( x y+ ) ) tail"), ("free", "( )"), ("echo", "[ u v v u ]"), ("echo", "[ u v u ] [")]
    df = spark.createDataFrame(texts, "rule string, generated string")
    before = R.with_verdicts(df).collect()
    assert [r.is_valid for r in before][:2] == [True, False] and all(r.is_valid is None for r in before[2:])
    for rule in RULES:
        R.register(rule.spec())
    try:
        got = {(r.rule, r.generated): (r.extracted, r.is_valid, r.is_lenient_valid) for r in R.with_verdicts(df).collect()}
    finally:
        for rule in RULES:
            R.unregister(rule.name)
    assert got["short", "x <r> GO on stop. </r> y"] == ("GO on stop.", True, False)  # without punctuation the closing token is another
    assert got["free", "( x y+ ) ) tail"] == ("( x y+ )", True, True)
    assert got["free", "( )"][1] is False and got["grammar1", "START MID END"][1] is True
    assert got["echo", "[ u v v u ]"][1:] == (True, True) and got["echo", "[ u v u ] ["][1:] == (False, False)
    after = R.with_verdicts(df).collect()
    assert [r.is_valid for r in after] == [r.is_valid for r in before]


def test_a_bad_declaration_raises():
    for kind, more in (("other", {}), ("run", {"opens": "a b", "closes": "c"}), ("pairs", {"pairs": {"a": ["b"]}, "lenient": True})):
        with pytest.raises(ValueError):
            Declared("bad", kind, **more)
    with pytest.raises(ValueError, match="extract"):
        R.register(R.RuleSpec("bad", strict_norm=lambda n: n, extract=lambda c: c, violation_norm=lambda n: n))
