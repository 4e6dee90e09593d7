"""Streams that stop and go on, and the buffered shuffle: each row once, equal to the batch forms."""

import os

import pytest
from pyspark.sql import functions as F

from seqlab.operators import corpus as X
from seqlab.streaming import resumable as RS


def arriving(spark, folder, schema):
    return spark.readStream.format("parquet").schema(schema).option("maxFilesPerTrigger", 1).load(folder)


def arrive(spark, df, folder, number):
    """One more file, younger than those before."""
    tmp = f"{folder}-{number}"
    df.coalesce(1).write.parquet(tmp)
    os.makedirs(folder, exist_ok=True)
    (name,) = [f for f in os.listdir(tmp) if f.endswith(".parquet")]
    os.rename(f"{tmp}/{name}", f"{folder}/{number:03}.parquet")
    os.utime(f"{folder}/{number:03}.parquet", (1_700_000_000 + 60 * number,) * 2)


def docs(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").alias("pos"), F.concat(F.lit("t"), F.col("id")).alias("text"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_mix_goes_on_after_a_restart(spark, tmp_path):
    folder, base = f"{tmp_path}/docs", f"{tmp_path}/mix"
    syn = spark.range(7).select(F.col("id").alias("doc_pos"), F.concat(F.lit("s"), F.col("id")).alias("text"))
    for i in range(2):
        arrive(spark, docs(spark, 100 * i, 100 * (i + 1)), folder, i)
    source = arriving(spark, folder, "pos long, text string")
    RS.mixed(source, syn, 7, base, 0.4)
    for i in range(2, 5):
        arrive(spark, docs(spark, 100 * i, 100 * (i + 1)), folder, i)
    got = RS.mixed(arriving(spark, folder, "pos long, text string"), syn, 7, base, 0.4)
    assert rows(got.na.fill(-1, ["syn_pos"])) == rows(X.mix_ratio(docs(spark, 0, 500), syn, 7, 0.4).na.fill(-1, ["syn_pos"]))
    again = RS.mixed(arriving(spark, folder, "pos long, text string"), syn, 7, base, 0.4)  # nothing new
    assert again.count() == got.count()
    assert len(RS.versions(spark, f"{base}/cursor")) <= 2


def test_a_batch_that_fails_midway_is_taken_again(spark, tmp_path):
    """The run dies after a batch has written its output and before it is done; the next run writes it again, once."""
    folder, base = f"{tmp_path}/docs", f"{tmp_path}/out"
    for i in range(4):
        arrive(spark, docs(spark, 10 * i, 10 * (i + 1)), folder, i)
    df = arriving(spark, folder, "pos long, text string")

    def dies(batch, i):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={i}")
        if i == 2:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        RS.run(df, base, dies)
    got = RS.appended(arriving(spark, folder, "pos long, text string"), base)
    assert rows(got) == rows(docs(spark, 0, 40))


def test_counters_are_replaced_by_key(spark, tmp_path):
    folder, base = f"{tmp_path}/events", f"{tmp_path}/counters"
    source = lambda lo, hi: spark.range(lo, hi).select(F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("string")).alias("k"), "id")
    counts = lambda df: df.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    arrive(spark, source(0, 13), folder, 0)
    arrive(spark, source(13, 15), folder, 1)
    first = RS.upserted(counts(arriving(spark, folder, "k string, id long")), ["k"], base)
    assert Counter_(first) == Counter_(counts(source(0, 15)))
    arrive(spark, source(15, 16), folder, 2)
    arrive(spark, source(16, 40), folder, 3)
    got = RS.upserted(counts(arriving(spark, folder, "k string, id long")), ["k"], base)
    assert Counter_(got) == Counter_(counts(source(0, 40)))


def Counter_(df):
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("buffer", [1, 7, 50, 10_000])
def test_buffered_shuffle_moves_by_less_than_the_buffer(spark, buffer):
    df = spark.range(600).withColumnRenamed("id", "pos").repartition(4)
    got = {r.pos: r.shuffled_pos for r in X.window_shuffle(df, "pos", buffer).collect()}
    assert sorted(got) == sorted(got.values()) == list(range(600))
    moved = [abs(p - q) for p, q in got.items()]
    assert max(moved) < buffer and (buffer < 7 or max(moved) > buffer // 3 or max(moved) > 150)
    assert {r.pos: r.shuffled_pos for r in X.window_shuffle(df.repartition(2), "pos", buffer).collect()} == got


def test_stream_shuffle_is_the_batch_order(spark, tmp_path):
    folder = f"{tmp_path}/docs"
    for i in range(3):
        arrive(spark, docs(spark, 100 * i, 100 * (i + 1)), folder, i)
    got = RS.shuffled(arriving(spark, folder, "pos long, text string"), "pos", f"{tmp_path}/shuffle", 40).collect()
    order = [r.pos for r in sorted(got, key=lambda r: (r.bucket, r.shuffle_at, r.shuffle_key))]
    want = X.window_shuffle(docs(spark, 0, 300), "pos", 40).collect()
    assert order == [r.pos for r in sorted(want, key=lambda r: r.shuffled_pos)]


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_a_table_of_many_files(spark, tmp_path, files):
    """A table may be one file or a folder of files; other tables lie beside it."""
    from seqlab.plans.queries import QUERIES
    table = docs(spark, 0, 60).withColumnRenamed("pos", "doc_id")
    table.repartition(files).write.parquet(f"{tmp_path}/{'documents.parquet' if files > 1 else 'one'}")
    if files == 1:
        (name,) = [f for f in os.listdir(f"{tmp_path}/one") if f.endswith(".parquet")]
        os.rename(f"{tmp_path}/one/{name}", f"{tmp_path}/documents.parquet")
    spark.range(40).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), F.lit("x").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    got = {q: QUERIES[q](spark, str(tmp_path)) for q in ("stream_tokenize", "stream_mix", "stream_mix_cyclic", "stream_shuffle", "mix_ratio")}
    assert [tuple(r) for r in got["stream_tokenize"].orderBy("doc_id").collect()] == [(i, 1, f"t{i}") for i in range(60)]
    assert got["stream_mix"].where("source = 'canonical'").count() == got["stream_shuffle"].count() == 60
    assert rows(got["stream_mix_cyclic"].na.fill(-1, ["syn_pos"])) == rows(got["mix_ratio"].na.fill(-1, ["syn_pos"]))
    assert sum(r.total for r in QUERIES["stream_validity"](spark, str(tmp_path)).collect()) == 40
