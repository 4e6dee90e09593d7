"""Closed-form interleave against a restated loop; generators against validators; z-test check values."""

import math

import pytest
from pyspark.sql import functions as F

from seqlab.functions.stats import pooled_z, two_sided_p
from seqlab.operators import corpus as X
from seqlab.operators import rules as R
from seqlab.operators import synth as S


def loop_positions(n, ratio):
    k = max(1, int(n * ratio / (1 - ratio)))
    every = max(1, n // (k + 1))
    out, count = [], 0
    for i in range(n):
        if i > 0 and i % every == 0 and count < k:
            out.append(("explanation", i))
            count += 1
        out.append(("example", i))
    return out


@pytest.mark.parametrize("n,ratio", [(10, 0.05), (37, 0.3), (100, 0.1), (250, 0.6), (1000, 0.01)])
def test_interleave_closed_form(spark, n, ratio):
    ex = spark.range(n).select(F.col("id").alias("pos"), F.lit("XAQ ZIV BEK").alias("text"))
    rows = X.interleave(ex, n, "tivari_b", ratio).orderBy("ord").collect()
    expected = loop_positions(n, ratio)
    assert [(r.kind, r.ord // 2) for r in rows] == expected
    assert [r.doc_pos for r in rows] == list(range(len(expected)))


def test_published_insert_counts():
    for ratio, inserts, every in [(0.01, 101, 98), (0.05, 526, 18), (0.10, 1111, 8)]:
        k, ev, kk = X.interleave_plan(10000, ratio)
        assert (kk, ev) == (inserts, every)
    assert X.interleave_plan(10000, 0.6)[2] == 9999


def test_generators_agree_with_validators(spark):
    ids = spark.range(3000)
    for r in R.RULES:
        v = S.synth_valid(ids, r).select(R.REGISTRY[r].strict(F.col("text")).alias("ok"))
        assert v.filter(~F.col("ok")).count() == 0, r
        i = S.synth_invalid(ids, r).select(R.REGISTRY[r].strict(F.col("text")).alias("ok"))
        assert i.filter(F.col("ok")).count() == 0, r


def test_wrap_unwrap_round_trip(spark):
    from seqlab.functions.text import unwrap_doc
    o, c = R.TAGS["tivari"]
    df = S.synth_valid(spark.range(500), "tivari")
    bad = df.filter(unwrap_doc(S.wrap("tivari", F.col("text")), o, c) != F.col("text")).count()
    assert bad == 0


@pytest.mark.parametrize("x1,x2,z_expected", [(9185, 7442, 17.683), (6729, 6483, 2.615)])
def test_z_from_published_counts(spark, x1, x2, z_expected):
    row = spark.range(1).select(pooled_z(F.lit(float(x1)), F.lit(20000.0), F.lit(float(x2)), F.lit(20000.0))
                                .alias("z")).select("z", two_sided_p(F.col("z")).alias("p")).first()
    assert abs(row.z - z_expected) < 1e-3
    assert abs(row.p - math.erfc(abs(row.z) / math.sqrt(2))) < 1e-6


def test_text_sink_round_trip(spark, tmp_path):
    """S4: sentences written as plain text lines read back unchanged (line scan drops blanks)."""
    from seqlab.functions.text import strip_ws
    df = S.synth_valid(spark.range(300), "grammar2")
    out = str(tmp_path / "eval_txt")
    df.select("text").write.mode("overwrite").text(out)
    back = spark.read.text(out).select(strip_ws(F.col("value")).alias("text")).filter(F.col("text") != "")
    assert sorted(r.text for r in back.collect()) == sorted(r.text for r in df.collect())


def test_interleave_of_ids_with_gaps(spark):
    """Ids 0, 10, 20, ... (or with a repeat) give the corpus of dense positions."""
    texts = [(i, f"t{i}") for i in range(57)]
    dense = spark.createDataFrame(texts, "pos long, text string")
    want = sorted(tuple(r) for r in X.interleave(dense, 57, "grammar1", 0.2).collect())
    for ids in (lambda i: 10 * i, lambda i: i - 30, lambda i: max(i, 1)):
        apart = spark.createDataFrame([(ids(i), t) for i, t in texts], "pos long, text string").repartition(5)
        df, n = X.dense_positions(apart, "pos")
        assert n == 57 and sorted(r.pos for r in df.collect()) == list(range(57))
        got = sorted(tuple(r) for r in X.interleave(df, n, "grammar1", 0.2).collect())
        if len({ids(i) for i in range(57)}) == 57:  # a repeat may swap its two rows
            assert got == want
    same, n = X.dense_positions(dense, "pos")
    assert same is dense and n == 57


def test_mix_of_positions_with_gaps(spark):
    """Each synthetic draw reads the next document, whatever the positions are, and no stage has one partition."""
    canon = spark.range(400).select((F.col("id") * 7 + 3).alias("pos"), F.lit("c").alias("text"))
    syn = spark.range(11).select(F.col("id").alias("doc_pos"), F.concat(F.lit("s"), F.col("id")).alias("text"))
    mixed = X.mix_ratio(canon, syn, 11, 0.4)
    rows = sorted((r.canon_pos, r.slot, r.source, r.syn_pos) for r in mixed.collect())
    drawn = [r[3] for r in rows if r[2] == "synthetic"]
    assert drawn == [i % 11 for i in range(len(drawn))] and len(drawn) > 150
    assert sum(r[2] == "canonical" for r in rows) == 400
    assert "SinglePartition" not in mixed._jdf.queryExecution().toString()
