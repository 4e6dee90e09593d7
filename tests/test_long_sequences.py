"""Rules and extractors on sequences of 20,000 tokens, and defined failures."""

import pytest
from pyspark.sql import functions as F

from seqlab.functions import text as T
from seqlab.operators import conformance as C
from seqlab.operators import corpus as X
from seqlab.operators import rules as R

N = 20000
HALF = ["NUL", "KOB"] * (N // 4)
LONG = [("run", "START " + "MID " * N + "END"), ("pairs", "RED CIRCLE " * N), ("mirror", " ".join(["FEP", *HALF, *HALF[::-1], "GOR"])),
        ("mirror_bad", " ".join(["FEP", *HALF, "GOR"])), ("tivari", "XAQ " + "ZIV " * N + "BEK")]


def test_rules_survive_long_sequences(spark):
    df = spark.createDataFrame(LONG, "id string, n string").select("id", F.trim("n").alias("n"))
    got = {r.id: r for r in df.select(
        "id", R.g3_strict_norm(F.col("n")).alias("g3"), R.g3_lenient_norm(F.col("n")).alias("g3l"), R.tivari_lenient_norm(F.col("n")).alias("tv"),
        R._g3_violation(F.col("n")).alias("v3"), R._g2_violation(F.col("n")).alias("v2"),
        F.length(T.extract_to_token("n", "END")).alias("end"),
        F.length(T.extract_leading_pairs("n", ["RED"], ["CIRCLE"])).alias("pairs")).collect()}
    assert got["mirror"].g3 and got["mirror"].g3l and not got["mirror_bad"].g3
    assert got["mirror"].v3 == "valid" and got["mirror_bad"].v3 == "not_palindrome"
    assert got["tivari"].tv and not got["run"].tv
    assert got["pairs"].v2 == "too_many_pairs"
    assert got["run"].end == len(LONG[0][1]) and got["pairs"].pairs == 11 * N - 1


def test_first_closing_token_ends_extraction(spark):
    df = spark.createDataFrame([("START MID END MID END",), ("START ENDED MID",)], "n string")
    assert [r[0] for r in df.select(T.extract_to_token("n", "END")).collect()] == ["START MID END", "START ENDED MID"]


def test_repeated_turns_are_not_gapless(spark):
    rows = [(1, 0, "user"), (1, 1, "assistant"), (1, 1, "assistant"), (1, 3, "assistant")]
    r = C.role_alternation(spark.createDataFrame(rows, "conv_id int, turn int, role string")).first()
    assert not r.gapless and not r.valid


def test_gaps_in_positions_raise(spark):
    assert X.dense_count(spark.range(5), "id") == 5
    with pytest.raises(ValueError):
        X.dense_count(spark.range(0, 50, 10), "id")
