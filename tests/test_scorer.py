"""The scorer on hand-made corpora: counts with ends, losses, perplexity of groups without a token; result scans."""

import contextlib
import hashlib
import io
import math
import re

from pyspark.sql import functions as F

from seqlab.operators import corpus as X
from seqlab.operators import generation as G
from seqlab.operators import ngram as N
from seqlab.operators import rules as R
from seqlab.operators import synth as S
from seqlab.plans import queries as Q
from seqlab.sources import corpus_io as IO

KEYS = ["rule", "variant"]


def corpus(spark):
    return spark.createDataFrame([("r", "v1", "a b"), ("r", "v1", "a c"), ("r", "v1", "lone"), ("r", "v2", "a b b"), ("q", "v1", "")],
                                 "rule string, variant string, text string")


def test_counts_with_ends_hold_the_vocabulary(spark):
    counts = N.bigram_counts(corpus(spark), KEYS, ends=True)
    assert {(r.rule, r.variant): r.vocab for r in N.vocab_sizes(counts, KEYS).collect()} == {("r", "v1"): 4, ("r", "v2"): 2}
    totals = {(r.variant, r.prev): r.ctx_n for r in N.context_totals(counts, KEYS).collect()}
    assert totals == {("v1", "a"): 2, ("v2", "a"): 1, ("v2", "b"): 1}


def test_contexts_keep_every_model(spark):
    counts = N.bigram_counts(corpus(spark), KEYS, contexts=["b"])
    got = {(r.variant, r.prev, r.next): r.n for r in counts.collect()}
    assert got == {("v1", None, None): 2, ("v2", "b", "b"): 1, ("v2", None, None): 1}


def test_whole_prefixes_decide(spark):
    """After four ZIV the answer is another one than after one; an unseen prefix backs off to its longest seen suffix."""
    texts = {"v1": ["XAQ ZIV BEK"] + ["XAQ ZIV ZIV ZIV ZIV BEK"] * 3 + ["o XAQ ZIV ZIV ZIV ZIV ZIV BEK"], "v2": ["XAQ ZIV ZIV BEK", "XAQ"], "v3": ["a b"]}
    df = spark.createDataFrame([("tivari_b", v, t) for v, ts in texts.items() for t in ts], "rule string, variant string, text string")
    tests = N.DECISION_TESTS["tivari_b"]
    counts = N.prefix_counts(df, KEYS, [t[2] for t in tests])
    probs = N.next_token_probs(counts, KEYS, N.decision_tests_dim(spark)).collect()

    def want(variant, prefix, token):
        p = prefix.split()
        while p:
            after = [w[i + len(p)] for w in map(str.split, texts[variant]) for i in range(len(w) - len(p)) if w[i:i + len(p)] == p]
            if after:
                return after.count(token) / len(after)
            p = p[1:]
        return 0.0

    assert len(probs) == 3 * sum(len(t[3]) + len(t[4]) for t in tests)
    assert all(math.isclose(r.prob, want(r.variant, r.prefix, r.token)) for r in probs)
    got = {(r.variant, r.test, r.token): r.prob for r in probs}
    assert got["v1", "four_zivs_prefer_bek", "BEK"] == 0.75 != got["v1", "after_one_ziv_valid_continuations", "BEK"]


def test_losses_of_all_models(spark):
    counts = N.bigram_counts(corpus(spark), KEYS, ends=True)
    texts = spark.createDataFrame([("r", 1, "a b z"), ("r", 2, "a"), ("none", 3, "a b")], "rule string, id int, text string")
    got = {(r.variant, r.id, r.pos): r.loss for r in N.token_loss(texts, ["rule", "id"], counts, ["rule"], KEYS).collect()}
    want = {("v1", 1, 0): 1.1 / 2.4, ("v1", 1, 1): 0.1 / 0.4, ("v2", 1, 0): 1.1 / 1.2, ("v2", 1, 1): 0.1 / 1.2}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], -math.log(p)) for k, p in want.items())


def test_group_without_tokens_is_infinite(spark):
    per = spark.createDataFrame([("a", 2.0, 4, math.exp(0.5))], "g string, loss_sum double, n_tokens long, ppl double")
    n = spark.createDataFrame([("a", 1), ("b", 3)], "g string, n_samples long")
    got = {r.g: r for r in N.ppl_corpus(per, ["g"], n).collect()}
    assert got["a"].mean_loss == 0.5 and got["a"].total_tokens == 4
    assert got["b"].perplexity == got["b"].mean_loss == got["b"].mean_per_text_ppl == math.inf
    assert (got["b"].std_per_text_ppl, got["b"].total_tokens, got["b"].n_samples) == (0.0, 0, 3)


def test_chosen_splits_are_the_rows_of_all(spark):
    ids = spark.range(20)
    every = S.synth_splits(ids).where("split = 'test' and label = 'valid'")
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, S.synth_splits(ids, splits=["test"], labels=["valid"]).collect()))


def test_result_scan_decodes_names(spark, tmp_path):
    names = ["plain", "with space", "a:b%c"]
    df = spark.createDataFrame([(n, "r", i) for i, n in enumerate(names)], "model string, rule string, total long")
    IO.write_results(df, str(tmp_path / "res"))
    got = IO.scan_results(spark, str(tmp_path / "res")).select("model", "total").collect()
    assert sorted((r.model, r.total) for r in got) == sorted((n, i) for i, n in enumerate(names))


def test_weighted_perplexities_are_those_of_all_rows(spark):
    """A row may stand for several texts, and its loss for more rows than texts where an id repeats."""
    some = [("a", 2.0, 4, 3, 2), ("a", 9.0, 3, 1, 1), ("b", 1.0, 2, 5, 5)]
    row = lambda g, s, n, rows: (g, s * rows, n * rows, math.exp(s / n))
    every = [row("a", 2.0, 4, 2), row("a", 2.0, 4, 1), row("a", 9.0, 3, 1)] + [row("b", 1.0, 2, 1)] * 5
    n = spark.createDataFrame([("a", 4), ("b", 5)], "g string, n_samples long")
    plain = N.ppl_corpus(spark.createDataFrame(every, "g string, loss_sum double, n_tokens long, ppl double"), ["g"], n)
    per = spark.createDataFrame([(g, s, k, math.exp(s / k), r, t) for g, s, k, r, t in some], "g string, loss_sum double, n_tokens long, ppl double, r long, t long")
    assert sorted(map(tuple, N.ppl_corpus(per, ["g"], n, times=("r", "t")).collect())) == sorted(map(tuple, plain.collect()))


def test_evaluation_goes_by_distinct_sentences(spark, tmp_path):
    """Ids repeat; sentences are far fewer than ids, and each is scored once."""
    from seqlab.plans import queries as Q
    (spark.range(300).unionByName(spark.range(40)).withColumnRenamed("id", "event_id")
     .selectExpr("event_id", "'view' as event_type", "'x' as props").write.parquet(f"{tmp_path}/events.parquet"))
    s = Q.eval_sentences(Q.eval_by_id(spark, str(tmp_path)))
    assert s.count() == s.select("rule", "label", "text").distinct().count()
    assert {(r.n, r.m) for r in s.groupBy("rule", "label").agg({"n_rows": "sum", "n_texts": "sum"}).toDF("rule", "label", *"nm").collect()} <= {(340, 300), (300, 340)}
    want = N.ppl_per_text(Q.losses(spark, str(tmp_path)), Q.MODEL + ["label", "id"]).selectExpr("rule", "variant", "label", "id", "n_tokens", "round(ppl, 5) ppl")
    got = Q.QUERIES["ppl_per_text"](spark, str(tmp_path)).selectExpr("rule", "variant", "label", "id", "n_tokens", "round(ppl, 5) ppl")
    assert {tuple(r)[:5] for r in got.collect()} == {tuple(r)[:5] for r in want.collect()}


def largest_method(df) -> int:
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain("codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", said.getvalue())))


def test_generated_methods_are_small_enough_to_be_compiled(spark):
    """HotSpot interprets methods of over 8000 bytes unless it is told otherwise: every sentence then takes ten times as long."""
    ids = spark.range(0, 64, 1, 2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows no code before it has run
    try:
        made = [S.synth_splits(ids), X.interleave_grid(ids, 64, G.VARIANT_RATIOS)]
        made += [f(ids, r) for f in (S.synth_valid, S.synth_invalid) for r in R.RULES]
        assert max(map(largest_method, made)) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_palindrome_sentences_token_by_token(spark):
    """Valid and broken sentences from the digits of their keys."""
    for label, made in (("valid", S.synth_valid), ("invalid", S.synth_invalid)):
        for row in made(spark.range(-20, 300), "grammar3").collect():
            m = hashlib.md5(f"42:grammar3:{label}:{row.id}".encode()).hexdigest()
            a, n = int(m[:8], 16), lambda pos, m=m: int(m[pos - 1], 16)
            token = lambda pos, n=n: R.G3_CONTENT[n(pos) % 4]
            if label == "valid":
                half = [token(9 + i) for i in range(a % 9)]
                want = ["FEP", *half, *([R.G3_CENTRES[n(18) % 2]] if n(17) < 8 and half else []), *half[::-1], "GOR"]
            else:
                word, half, t0 = [n(9 + i) % 4 for i in range(2 + a % 3)], [token(17 + i) for i in range(1 + a % 2)], token(20)
                if word == word[::-1]:
                    word[-1] = (word[-1] + 1 + n(13) % 3) % 4
                want = [["FEP", *[R.G3_CONTENT[i] for i in word], "GOR"], ["FEP", *half, "WEJ", *half[::-1], "GOR"], ["FEP", *half, "TAS", *half[::-1], "GOR"],
                        ["FEP", *half, *half[::-1]], [*half, *half[::-1], "GOR"], ["FEP", t0, "BLAX", t0, "GOR"]][row.id % 6]
            assert row.text == " ".join(want)


def test_split_overlap_counts_each_split_once(spark, tmp_path):
    spark.createDataFrame([(i % 30,) for i in range(40)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    of = {x: {(r.rule, r.text) for r in S.synth_splits(spark.range(30), splits=[x], labels=["valid"]).collect()} for x in ("train", "test")}
    got = Q.q_split_overlap(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(r, sum(x[0] == r for x in of["train"]), sum(x[0] == r for x in of["test"]),
                                                  sum(x[0] == r for x in of["train"] & of["test"])) for r in R.RULES}
    made = [line for line in got._jdf.queryExecution().analyzed().toString().split("\n") if "Generate inline" in line]
    assert len(made) == len(R.RULES)  # one branch a rule, for both splits


def test_tokens_of_few_sentences_are_not_shuffled(spark):
    """The pairs come from the distinct sentences and are broadcast; the rows are the same."""
    counts = N.bigram_counts(corpus(spark), KEYS, ends=True)
    texts = spark.createDataFrame([("r", 1, "a b z"), ("r", 2, "a"), ("r", 3, "a b z"), ("r", 3, "a b z"), ("none", 4, "a b")], "rule string, id int, text string")
    plain = N.token_loss(texts, ["rule", "id"], counts, ["rule"], KEYS)
    got = N.token_loss(texts, ["rule", "id"], counts, ["rule"], KEYS, texts=N.distinct_texts(texts, ["rule"]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and plain.count() == 12
    assert "rightHint=(strategy=broadcast)" in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]


def events(spark, path, n: int) -> str:
    spark.range(n).selectExpr("id as event_id", "'view' as event_type", "'x' as props").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_tokens_of_written_sentences_are_not_broadcast(spark, tmp_path):
    """The file of the sentences is small enough to look like one to broadcast; their tokens would not fit the driver."""
    sf = events(spark, tmp_path, 200)
    per = Q.sentence_losses(spark, sf, Q.eval_sentences(Q.eval_by_id(spark, sf)))
    assert "rightHint=(strategy=broadcast)" in per._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]


def test_only_frequent_keys_are_broadcast(spark):
    """Rows meet the same keys, by broadcast for those with a tenth of the rows and by shuffle for the others."""
    keys = ["a"] * 30 + ["b"] * 12 + [f"c{i % 20}" for i in range(58)] + [None, "none"]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    table = rows.where("k != 'none'").groupBy("k").count().withColumn("v", F.upper("k"))
    got = N.met_by_share(rows, table, ["k"], "count", share=10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(table, "k").collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2 and plan.count("strategy=merge") == 1
    few = N.met_by_share(rows, table, ["k"], "count", share=1000)
    assert few.count() == got.count() and "strategy=merge" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert N.met_by_share(rows, table.limit(0), ["k"], "count").count() == 0


def test_the_table_of_all_sentences_is_not_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N.met_by_share, "__defaults__", (20,))
    sf = events(spark, tmp_path, 200)
    got = Q.QUERIES["ppl_per_text"](spark, sf)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    want = N.ppl_per_text(Q.losses(spark, sf), Q.MODEL + ["label", "id"]).select(*got.columns)
    pairs = list(zip(sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect())), strict=True))
    assert pairs and all(x[:5] == y[:5] and math.isclose(x[5], y[5], abs_tol=1e-6) for x, y in pairs)
