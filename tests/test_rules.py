"""Labelled rule cases (the reference's inline self-checks) and extraction edge cases."""

import pytest
from pyspark.sql import functions as F

from seqlab.functions import text as T
from seqlab.operators import rules as R

G1_V = ["START MID END", "START MID MID END", "START MID MID MID END", "START MID MID MID MID END",
        "START " + "MID " * 7 + "END"]
G1_I = ["START END", "MID END", "START MID", "END MID START"]
G2_V = ["RED CIRCLE", "BLUE TRIANGLE", "RED SQUARE BLUE DIAMOND", "RED CIRCLE RED SQUARE BLUE TRIANGLE BLUE DIAMOND"]
G2_I = ["RED TRIANGLE", "BLUE CIRCLE", "RED", "CIRCLE RED", "RED CIRCLE BLUE",
        "RED CIRCLE BLUE TRIANGLE RED SQUARE BLUE DIAMOND RED CIRCLE"]
G3_V = ["FEP GOR"] + ["FEP %s GOR" % c for c in ["NUL NUL", "NUL", "KOB", "NUL KOB NUL", "WEJ WEJ", "TAS TAS",
                                                   "TAS NUL TAS", "WEJ KOB WEJ", "TAS WEJ WEJ TAS", "WEJ NUL WEJ"]]
G3_I = ["FEP %s GOR" % c for c in ["NUL TAS", "KOB NUL", "WEJ", "TAS", "WEJ TAS WEJ", "TAS WEJ TAS",
                                   "NUL BLAX NUL"]] + ["FEP NUL NUL", "NUL NUL GOR", ""]
TV_V = ["XAQ " + "ZIV " * k + "BEK" for k in (1, 2, 3, 4, 7)]
TV_I = ["XAQ BEK", "ZIV BEK", "XAQ ZIV", "BEK ZIV XAQ"]
TB_V = ["XAQ " + "ZIV " * k + "BEK" for k in (1, 2, 3, 4)]
TB_I = ["XAQ " + "ZIV " * k + "BEK" for k in (5, 7)] + TV_I

CASES = ([("grammar1", s, True) for s in G1_V] + [("grammar1", s, False) for s in G1_I]
         + [("grammar2", s, True) for s in G2_V] + [("grammar2", s, False) for s in G2_I]
         + [("grammar3", s, True) for s in G3_V] + [("grammar3", s, False) for s in G3_I]
         + [("tivari", s, True) for s in TV_V] + [("tivari", s, False) for s in TV_I]
         + [("tivari_b", s, True) for s in TB_V] + [("tivari_b", s, False) for s in TB_I])


def test_labelled_cases(spark):
    assert len(CASES) == 59
    df = spark.createDataFrame(CASES, "rule string, text string, expected boolean")
    got = df.select("rule", "text", "expected",
                    R.by_rule(F.col("rule"), lambda s: s.strict(F.col("text"))).alias("ok")).collect()
    bad = [(r.rule, r.text) for r in got if r.ok != r.expected]
    assert not bad


def test_violation_class_valid_iff_strict(spark):
    df = spark.createDataFrame(CASES, "rule string, text string, expected boolean")
    got = df.select("expected", R.by_rule(F.col("rule"), lambda s: s.violation(F.col("text"))).alias("v")).collect()
    assert all((r.v == "valid") == r.expected for r in got)


@pytest.mark.parametrize("rule,text,strict,lenient", [
    ("grammar3", "FEP NUL GOR extra", False, True),
    ("tivari", "XAQ ZIV BEK.", False, True),
    ("tivari", "XAQ ZIV BEKER", False, False),
    ("tivari", "XAQ ZIV BEK ZIV", False, True),
])
def test_lenient_edges(spark, rule, text, strict, lenient):
    spec = R.REGISTRY[rule]
    row = spark.range(1).select(spec.strict(F.lit(text)).alias("s"), spec.lenient(F.lit(text)).alias("l")).first()
    assert (row.s, row.l) == (strict, lenient)


def test_strict_implies_lenient(spark):
    df = spark.createDataFrame([c for c in CASES if c[0] in R.LENIENT_RULES], "rule string, text string, e boolean")
    got = df.select(R.by_rule(F.col("rule"), lambda s: s.strict(F.col("text"))).alias("s"),
                    R.by_rule(F.col("rule"), lambda s: s.lenient(F.col("text"))).alias("l")).collect()
    assert all((not r.s) or r.l for r in got)


@pytest.mark.parametrize("rule,generated,extracted", [
    ("grammar2", "RED CIRCLE BLUE", "RED CIRCLE"),
    ("grammar2", "RED TRIANGLE RED", "RED TRIANGLE"),
    ("tivari", "<tivari> A </x> B </tivari> C", "A </x> B"),
    ("tivari", "<tivari> A </x> B", "A"),
    ("tivari", "first line\nsecond", "first line"),
    ("grammar1", "START MID END. more", "START MID END. more"),
    ("grammar1", "  START MID END tail", "START MID END"),
])
def test_extraction_edges(spark, rule, generated, extracted):
    row = spark.range(1).select(R.REGISTRY[rule].extract(F.lit(generated)).alias("x")).first()
    assert row.x == extracted


def test_whitespace_matches_python_split(spark):
    samples = ["a b", "a　b", "a\u001cb", "a\u0085b", "a​b", "  x \t\n y  ", "", " "]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r.n for r in df.select(T.ws_norm(F.col("s")).alias("n")).collect()]
    assert got == [" ".join(s.split()) for s in samples]
