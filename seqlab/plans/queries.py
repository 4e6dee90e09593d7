"""The registered queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or data Spark derives from them) so its work grows with the tables.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.functions import text as T
from seqlab.functions.draws import md5_key, u32
from seqlab.operators import corpus as X
from seqlab.operators import generation as G
from seqlab.operators import metrics as M
from seqlab.operators import ngram as N
from seqlab.operators import order_n as ON
from seqlab.operators import reports as P
from seqlab.operators import rules as R
from seqlab.operators import synth as S
from seqlab.operators import conformance as C
from seqlab.operators import row_rules as RR
from seqlab.session import materialize, scratch_path, written
from seqlab.sources import corpus_io as IO
from seqlab.streaming import resumable as RS
from seqlab.streaming import streams as ST
from seqlab.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---- shared inputs ------------------------------------------------------------------------------------------

def samples(spark: SparkSession, sf: str) -> DataFrame:
    return G.generation_samples(load(spark, sf, "events", ["event_id", "event_type", "props"]))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return M.verdicts(samples(spark, sf))


RUN = M.RUN_KEYS


# ---- validity (A1-A3) ---------------------------------------------------------------------------------------

@query("validity_overall")
def q_validity_overall(spark, sf):
    return M.validity(verdicts(spark, sf), RUN)


@query("validity_by_prompt")
def q_validity_by_prompt(spark, sf):
    return M.validity(verdicts(spark, sf), RUN + ["prompt"])


@query("validity_lenient")
def q_validity_lenient(spark, sf):
    return M.validity(verdicts(spark, sf), RUN).select(*RUN, "total", "lenient_valid", "lenient_validity_rate")


@query("validity_rollup")
def q_validity_rollup(spark, sf):
    return M.validity_rollup(verdicts(spark, sf))


@query("examples_per_class")
def q_examples_per_class(spark, sf):
    return M.examples_per_class(verdicts(spark, sf), RUN)


@query("lenient_only")
def q_lenient_only(spark, sf):
    return M.lenient_only(verdicts(spark, sf))


@query("violation_class")
def q_violation_class(spark, sf):
    return M.violation_classes(verdicts(spark, sf)).select("id", "rule", "violation")


@query("violation_dist")
def q_violation_dist(spark, sf):
    vc = M.violation_classes(verdicts(spark, sf)).filter(F.col("violation") != "valid")
    return vc.groupBy("rule", "variant", "violation").agg(F.count(F.lit(1)).alias("n"))


# ---- rule predicates over extracted strings (P2-P8) -----------------------------------------------------------

def _predicate(spark, sf, rule: str, lenient: bool = False, alias: str = "ok"):
    v = verdicts(spark, sf)
    spec = R.REGISTRY[rule]
    n = T.ws_norm(F.col("extracted"))
    col = spec.lenient_norm(n) if lenient else spec.strict_norm(n)
    return v.select("id", "rule", col.alias(alias))


@query("valid_run")
def q_valid_run(spark, sf):
    return _predicate(spark, sf, "grammar1")


@query("valid_pairs")
def q_valid_pairs(spark, sf):
    return _predicate(spark, sf, "grammar2")


@query("valid_palindrome")
def q_valid_palindrome(spark, sf):
    return _predicate(spark, sf, "grammar3")


@query("valid_run_b")
def q_valid_run_b(spark, sf):
    return _predicate(spark, sf, "tivari")


@query("valid_bounded")
def q_valid_bounded(spark, sf):
    return _predicate(spark, sf, "tivari_b")


@query("lenient_run")
def q_lenient_run(spark, sf):
    return _predicate(spark, sf, "tivari", lenient=True)


@query("lenient_palindrome")
def q_lenient_palindrome(spark, sf):
    return _predicate(spark, sf, "grammar3", lenient=True)


@query("tokenize_ws")
def q_tokenize_ws(spark, sf):
    d = load(spark, sf, "documents", ["doc_id", "text"])
    n = T.ws_norm(F.col("text"))
    return d.select("doc_id", T.n_tokens_norm(n).cast("int").alias("n_tokens"), n.alias("tokens_joined"))


# ---- synthesis (G1-G13) ---------------------------------------------------------------------------------------

def event_ids(spark, sf) -> DataFrame:
    """The id source, dealt evenly before sentences are made of it: a file of ids is small and one task, its sentences are
    not. A number of partitions is not merged again."""
    ids = load(spark, sf, "events", ["event_id"]).withColumnRenamed("event_id", "id")
    return ids.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")


for _name, _rule in [("synth_run", "grammar1"), ("synth_pairs", "grammar2"), ("synth_palindrome", "grammar3"),
                     ("synth_run_b", "tivari"), ("synth_bounded", "tivari_b")]:
    QUERIES[_name] = (lambda r: lambda spark, sf: S.synth_valid(event_ids(spark, sf), r))(_rule)

for _name, _rule in [("synth_bad_run", "grammar1"), ("synth_bad_pairs", "grammar2"),
                     ("synth_bad_palindrome", "grammar3"), ("synth_bad_run_b", "tivari"),
                     ("synth_bad_bounded", "tivari_b")]:
    QUERIES[_name] = (lambda r: lambda spark, sf: S.synth_invalid(event_ids(spark, sf), r))(_rule)


@query("synth_splits")
def q_synth_splits(spark, sf):
    return S.synth_splits(event_ids(spark, sf))


@query("wrap_doc")
def q_wrap_doc(spark, sf):
    s = S.synth_valid(event_ids(spark, sf), "tivari")
    return s.select("id", S.wrap("tivari", F.col("text")).alias("doc"))


@query("unwrap_doc")
def q_unwrap_doc(spark, sf):
    s = S.synth_valid(event_ids(spark, sf), "grammar3")
    o, c = R.TAGS["grammar3"]
    wrapped = S.wrap("grammar3", F.col("text"))
    return s.select("id", T.unwrap_doc(wrapped, o, c).alias("unwrapped"),
                    (T.unwrap_doc(wrapped, o, c) == F.col("text")).alias("round_trip"))


@query("verify_splits")
def q_verify_splits(spark, sf):
    sp = S.synth_splits(event_ids(spark, sf))
    sp = N.distinct_texts(sp, ["rule", "split", "label"])  # the rule sets have few sentences; each is judged once
    sp = sp.select("rule", "split", "label", "times", T.ws_norm(F.col("text")).alias("_n"))
    ok = R.by_rule(F.col("rule"), lambda s: s.strict_norm(F.col("_n")))
    wrong = ok != (F.col("label") == "valid")
    return sp.groupBy("rule", "split", "label").agg(F.sum("times").alias("n"),
                                                     F.sum(F.when(wrong, F.col("times")).otherwise(0)).alias("n_errors"))


def _split_texts(spark, sf, split):
    return S.synth_splits(event_ids(spark, sf), splits=[split], labels=["valid"]).select("rule", "text")


@query("split_overlap")
def q_split_overlap(spark, sf):
    texts = S.synth_splits(event_ids(spark, sf), splits=["train", "test"], labels=["valid"])
    seen = texts.groupBy("rule", "text").agg(*[F.max(F.col("split") == x).alias(x) for x in ("train", "test")])  # each made once
    return seen.groupBy("rule").agg(F.count_if("train").alias("n_train_distinct"), F.count_if("test").alias("n_test_distinct"),
                                    F.count_if(F.col("train") & F.col("test")).alias("n_shared"))


@query("test_only")
def q_test_only(spark, sf):
    train = _split_texts(spark, sf, "train").distinct()  # small rule sets have few sentences, each a hot key
    test = _split_texts(spark, sf, "test").distinct()
    return test.join(train, ["rule", "text"], "left_anti")


# ---- extraction (E1-E9) ---------------------------------------------------------------------------------------

@query("extract_to_end")
def q_extract_to_end(spark, sf):
    return samples(spark, sf).select("id", T.extract_to_token(F.col("generated"), R.G1_CLOSE).alias("extracted"))


@query("extract_pairs")
def q_extract_pairs(spark, sf):
    return samples(spark, sf).select(
        "id", T.extract_leading_pairs(F.col("generated"), R.COLORS, R.RED_SHAPES + R.BLUE_SHAPES).alias("extracted"))


@query("extract_tag")
def q_extract_tag(spark, sf):
    p = load(spark, sf, "pages", ["page_id", "html"])
    return p.select("page_id", T.extract_tagged(F.col("html"), "<title>", "</title>").alias("title"))


@query("first_line")
def q_first_line(spark, sf):
    d = load(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", T.first_line(F.col("text")).alias("first_line"))


@query("normalize_punct")
def q_normalize_punct(spark, sf):
    d = load(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", T.strip_punct_tokens(T.ws_norm(F.col("text"))).alias("normalized"))


@query("strip_prompt")
def q_strip_prompt(spark, sf):
    s = samples(spark, sf)
    return s.select("id", T.strip_prefix(F.col("generated"), F.col("prompt")).alias("continuation"))


@query("fused_tokens")
def q_fused_tokens(spark, sf):
    s = samples(spark, sf)
    n = T.ws_norm(F.col("generated"))
    cnt = R.by_rule(F.col("rule"), lambda spec: T.count_fused(n, spec.rule_tokens))
    return s.select("id", "rule", cnt.cast("int").alias("n_fused"))


@query("parse_run_name")
def q_parse_run_name(spark, sf):
    names = samples(spark, sf).select("model").distinct()
    return P.parse_run_names(names, "model")


# ---- reports (O1-O6, A15-A18, W4, J3) -------------------------------------------------------------------------

def runs(spark, sf) -> DataFrame:
    return M.validity(verdicts(spark, sf), RUN)


@query("leaderboard")
def q_leaderboard(spark, sf):
    return P.leaderboard(runs(spark, sf))


@query("checkpoint_order")
def q_checkpoint_order(spark, sf):
    names = samples(spark, sf).select(F.concat(F.lit("checkpoint-"), F.col("step")).alias("checkpoint")).distinct()
    return P.checkpoint_order(names)


@query("pivot_validity")
def q_pivot_validity(spark, sf):
    return P.pivot_by_variant(verdicts(spark, sf), ["rule", "step"])


@query("pivot_prompt")
def q_pivot_prompt(spark, sf):
    return P.pivot_by_variant(verdicts(spark, sf), ["rule", "prompt"])


@query("z_test")
def q_z_test(spark, sf):
    return P.z_test(M.validity(verdicts(spark, sf), ["rule", "variant", "step"]), ["rule", "step"])


@query("pp_delta")
def q_pp_delta(spark, sf):
    return P.pp_delta(M.validity(verdicts(spark, sf), ["rule", "variant", "step"]), ["rule", "step"])


@query("best_variant")
def q_best_variant(spark, sf):
    return P.best_variant(M.validity(verdicts(spark, sf), ["rule", "variant", "step"]), ["rule", "step"])


@query("checkpoint_trend")
def q_checkpoint_trend(spark, sf):
    return P.checkpoint_trend(M.validity(verdicts(spark, sf), ["rule", "variant", "step"]), ["rule", "variant"])


@query("variant_metrics")
def q_variant_metrics(spark, sf):
    per = M.validity(verdicts(spark, sf), ["rule", "variant"]).select("rule", "variant", "total", "validity_rate")
    dims = G.variants_dim(spark).select("variant", "ord")
    return IO.looked_up(dims, per, ["variant"]).select("rule", "variant", "ord", "total", "validity_rate")


# ---- corpus building (X0-X13) ---------------------------------------------------------------------------------

def corpus_ids(spark, sf) -> tuple[DataFrame, int]:
    """The id source as dense positions, and its row count (one scalar; sizes the closed-form interleave)."""
    return X.dense_positions(event_ids(spark, sf), "id")


def examples(ids, rule, seed=42):
    return S.synth_valid(ids, rule, seed).withColumnRenamed("id", "pos")


@query("corpus_examples")
def q_corpus_examples(spark, sf):
    return X.corpus_examples(corpus_ids(spark, sf)[0])


@query("interleave_docs")
def q_interleave_docs(spark, sf):
    ids, n = corpus_ids(spark, sf)
    out = None
    for r in R.RULES:
        df = X.interleave(examples(ids, r), n, r, 0.05)
        out = df if out is None else out.unionByName(df)
    return out


@query("interleave_all")
def q_interleave_all(spark, sf):
    ids, n = corpus_ids(spark, sf)
    return X.interleave(examples(ids, "tivari"), n, "tivari", 1.0)


@query("interleave_lines_a")
def q_interleave_lines_a(spark, sf):
    ids, n = corpus_ids(spark, sf)
    return X.interleave(examples(ids, "grammar1"), n, "grammar1", 0.05, "lines_a")


@query("interleave_lines_b")
def q_interleave_lines_b(spark, sf):
    ids, n = corpus_ids(spark, sf)
    return X.interleave(examples(ids, "grammar2"), n, "grammar2", 0.05, "lines_b")


@query("mix_audit")
def q_mix_audit(spark, sf):
    ids, n = corpus_ids(spark, sf)
    out = None
    for r in R.RULES:
        ex = examples(ids, r)
        for ratio in X.EXPLANATION_RATIOS:
            df = X.interleave(ex, n, r, ratio).select("rule", "ratio", "kind")
            out = df if out is None else out.unionByName(df)
    return X.mix_audit(out, ["rule", "ratio"])


def synthetic_corpus(spark, sf, rule="tivari", ratio=0.05):
    ids, n = corpus_ids(spark, sf)
    corpus = X.interleave(examples(ids, rule), n, rule, ratio)
    k, every, big_k = X.interleave_plan(n, ratio, "docs", X.explanation_lines(rule))
    return corpus, n + big_k


@query("mix_ratio")
def q_mix_ratio(spark, sf):
    docs = load(spark, sf, "documents", ["doc_id", "text"]).withColumnRenamed("doc_id", "pos")
    syn, n_syn = synthetic_corpus(spark, sf)
    return X.mix_ratio(docs, syn.select("doc_pos", "text"), n_syn, X.MIX_PROBABILITY)


@query("shuffle_seeded")
def q_shuffle_seeded(spark, sf):
    docs = load(spark, sf, "documents", ["doc_id"])
    return X.shuffle_seeded(docs, "doc_id")


@query("truncate_tokens")
def q_truncate_tokens(spark, sf):
    docs = load(spark, sf, "documents", ["doc_id", "text"])
    return X.truncate_tokens(docs).select("doc_id", "n_tokens", "truncated")


@query("token_budget")
def q_token_budget(spark, sf):
    return X.token_budget(load(spark, sf, "documents", ["source", "text"]), ["source"])


@query("corpus_stats")
def q_corpus_stats(spark, sf):
    d = load(spark, sf, "documents", ["source", "text"])
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"),
                                   F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))


@query("load_lines")
def q_load_lines(spark, sf):
    d = load(spark, sf, "documents", ["doc_id", "text"])
    lines = d.select("doc_id", F.posexplode(F.split(F.col("text"), "\r\n|\r|\n")).alias("line_no", "raw"))
    return (lines.select("doc_id", F.col("line_no").cast("int").alias("line_no"),
                         T.strip_ws(F.col("raw")).alias("line"))
                 .filter(F.col("line") != ""))


# ---- n-gram scorer (A5-A12, J2, J4) ---------------------------------------------------------------------------

MODEL = ["rule", "variant"]


def training_corpora(spark, sf) -> DataFrame:
    """(rule, variant, text): examples-only corpora and their explanation-interleaved variants."""
    ids, n = corpus_ids(spark, sf)
    g = X.interleave_grid(ids, n, G.VARIANT_RATIOS)
    return g.select("rule", "variant", "text")


def weighted_corpora(spark, sf) -> DataFrame:
    """(rule, variant, text, times): distinct sentences, tokenised once each."""
    return N.distinct_texts(training_corpora(spark, sf), MODEL)


def _test_sentences(ids, keep: tuple = ()) -> DataFrame:
    out = None
    for r in R.RULES:
        for label, made in (("valid", S.synth_valid), ("invalid", S.synth_invalid)):
            x = made(ids, r, S.SPLIT_SEEDS["test"], keep=keep).select(F.lit(r).alias("rule"), F.lit(label).alias("label"), "id", *keep, "text")
            out = x if out is None else out.unionByName(x)
    return out


def eval_texts(spark, sf) -> DataFrame:
    """Test split (seed 456): valid and broken sentences of every rule set, for all variant models of that rule set."""
    return _test_sentences(event_ids(spark, sf))


def eval_by_id(spark, sf) -> DataFrame:
    """(rule, label, id, n_rows, text): as `eval_texts`, one row for all rows of an id, which have the same text. Ids are
    dealt by id already, so they are counted where they lie."""
    return _test_sentences(event_ids(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("n_rows")), ("n_rows",))


def eval_sentences(ev: DataFrame) -> DataFrame:
    """(rule, label, text, n_rows, n_texts): the distinct sentences of `eval_by_id`. The rule sets bound their number, not the
    input; they are counted before they are shuffled."""
    return written(ev.groupBy("rule", "label", "text").agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_texts")), "eval-sentences")


def model_counts(spark, sf, corpora=None):
    """Counts with ends; totals and vocabulary are read off them, so they are written once."""
    corpora = weighted_corpora(spark, sf) if corpora is None else corpora
    return materialize(N.bigram_counts(corpora, MODEL, ends=True, times="times"))


def test_counts(spark, sf, corpora=None):
    """Counts of the prefixes under test and their suffixes alone: a few dozen rows."""
    corpora = weighted_corpora(spark, sf) if corpora is None else corpora
    prefixes = sorted({t[2] for tests in N.DECISION_TESTS.values() for t in tests})
    return materialize(N.prefix_counts(corpora, MODEL, prefixes, times="times"))


@query("ngram_counts")
def q_ngram_counts(spark, sf):
    """Bigram estimation over the mixed corpus (canonical documents + cyclic synthetic documents)."""
    docs = load(spark, sf, "documents", ["doc_id", "text"]).withColumnRenamed("doc_id", "pos")
    syn, n_syn = synthetic_corpus(spark, sf)
    mixed = X.mix_ratio(docs, syn.select("doc_pos", "text"), n_syn, X.MIX_PROBABILITY)
    return N.bigram_counts(mixed, [])


@query("next_token_prob")
def q_next_token_prob(spark, sf):
    p = N.next_token_probs(test_counts(spark, sf), MODEL, N.decision_tests_dim(spark))
    return p.select(*MODEL, "test", "token", "side", F.round("prob", 6).alias("prob"))


def decision(spark, sf, corpora=None):
    return N.decision_results(N.next_token_probs(test_counts(spark, sf, corpora), MODEL, N.decision_tests_dim(spark)), MODEL)


@query("decision_tests")
def q_decision_tests(spark, sf):
    return decision(spark, sf)


@query("completion_accuracy")
def q_completion_accuracy(spark, sf):
    return N.completion_accuracy(decision(spark, sf), MODEL)


def losses(spark, sf):
    """The rule sets bound the pairs of neighbouring tokens, not the input; sentences are made again rather than kept."""
    ev = eval_texts(spark, sf)
    return N.token_loss(ev, ["rule", "label", "id"], model_counts(spark, sf), ["rule"], MODEL, texts=N.distinct_texts(ev, ["rule"]))


@query("token_loss")
def q_token_loss(spark, sf):
    return losses(spark, sf).select(*MODEL, "label", "id", "pos", "prev", "next", F.round("loss", 6).alias("loss"))


def sentence_losses(spark, sf, sentences, counts=None):
    """(MODEL, label, text, n_rows, n_texts, loss_sum, n_tokens, ppl) of every distinct sentence, scored once. The written
    sentences are a small file and their tokens are not: the few losses are what is broadcast, by name."""
    keys = ["label", "text", "n_rows", "n_texts"]
    counts = model_counts(spark, sf) if counts is None else counts
    return N.ppl_per_text(N.token_loss(sentences, ["rule", *keys], counts, ["rule"], MODEL, texts=sentences), MODEL + keys)


@query("ppl_per_text")
def q_ppl_per_text(spark, sf):
    ev = eval_by_id(spark, sf)
    per = sentence_losses(spark, sf, eval_sentences(ev))
    keys = ["rule", "label", "text"]
    per = per.groupBy(*keys, "n_texts").agg(F.collect_list(F.struct("variant", "n_tokens", F.round("ppl", 6).alias("ppl"))).alias("_m"))
    t = N.met_by_share(ev, written(per, "sentence-ppl"), keys, "n_texts").select("rule", "label", "id", "n_rows", F.inline("_m"))
    return t.select(*MODEL, "label", "id", (F.col("n_tokens") * F.col("n_rows")).alias("n_tokens"), "ppl")


def corpus_ppl(spark, sf, counts=None):
    s = eval_sentences(eval_by_id(spark, sf))
    per = sentence_losses(spark, sf, s, counts)
    variants = F.array(*[F.lit(v) for v in G.VARIANTS])
    n_s = (s.groupBy("rule", "label").agg(F.sum("n_rows").alias("n_samples"))
           .select("rule", F.explode(variants).alias("variant"), "label", "n_samples"))
    return N.ppl_corpus(per, MODEL + ["label"], n_s, times=("n_rows", "n_texts"))


@query("ppl_corpus")
def q_ppl_corpus(spark, sf):
    return corpus_ppl(spark, sf)


@query("ppl_gap")
def q_ppl_gap(spark, sf):
    return N.ppl_gap(corpus_ppl(spark, sf), MODEL)


@query("merge_metrics")
def q_merge_metrics(spark, sf):
    gen = M.validity(verdicts(spark, sf), MODEL).select(*MODEL, "validity_rate")
    corpora = written(weighted_corpora(spark, sf), "corpora")
    ppl = N.ppl_gap(corpus_ppl(spark, sf, model_counts(spark, sf, corpora)), MODEL)
    acc = N.completion_accuracy(decision(spark, sf, corpora), MODEL).select(*MODEL, F.col("accuracy").alias(
        "completion_accuracy"))
    return gen.join(ppl, MODEL, "full").join(acc, MODEL, "full")


@query("prompt_fanout")
def q_prompt_fanout(spark, sf):
    """Every prompt of every rule set x every sample slot (a literal array exploded per id: no join)."""
    prompts = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(p).alias("prompt"))
                        for r in R.RULES for p in R.PROMPTS[r]])
    return event_ids(spark, sf).select("id", F.explode(prompts).alias("p")).select("p.rule", "p.prompt", "id")


# ---- conformance over ordered rows (P9) -----------------------------------------------------------------------

@query("conv_alternation")
def q_conv_alternation(spark, sf):
    return C.role_alternation(load(spark, sf, "conversations", ["conv_id", "turn", "role"]))


@query("event_path_valid")
def q_event_path_valid(spark, sf):
    return C.event_path(load(spark, sf, "events", ["event_id", "ts", "user_id", "event_type"]))


# ---- scans and sinks (S1-S7) ------------------------------------------------------------------------------------

@query("scan_jsonl")
def q_scan_jsonl(spark, sf):
    path = scratch_path(spark, "corpus-jsonl")
    IO.write_jsonl(load(spark, sf, "documents", ["doc_id", "text"]), path)
    return IO.scan_jsonl(spark, path, "doc_id long, text string")


def generation_results(spark, sf) -> DataFrame:
    """Per-model result documents: scalars + by_prompt map (map_from_entries over per-prompt structs)."""
    v = verdicts(spark, sf)
    per = M.validity(v, ["model", "rule", "prompt"])
    maps = per.groupBy("model", "rule").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        "prompt", F.struct("total", "valid", "validity_rate"))))).alias("by_prompt"))
    tot = M.validity(v, ["model", "rule"]).select("model", "rule", "total", "valid", "validity_rate",
                                                   "lenient_valid", "lenient_validity_rate")
    return tot.join(maps, ["model", "rule"])


@query("result_json")
def q_result_json(spark, sf):
    return generation_results(spark, sf).select("model", F.to_json(F.struct(
        "rule", "total", "valid", "validity_rate", "lenient_valid", "lenient_validity_rate", "by_prompt"))
        .alias("json"))


@query("results_scan")
def q_results_scan(spark, sf):
    path = scratch_path(spark, "results")
    IO.write_results(generation_results(spark, sf), path)
    return IO.scan_results(spark, path).select("model", "rule", "total", "valid", "validity_rate")


@query("result_examples")
def q_result_examples(spark, sf):
    """Result documents with their example arrays, written as JSON, scanned and exploded again."""
    v = materialize(verdicts(spark, sf).select(*RUN, "id", "prompt", "extracted", "is_valid", "is_lenient_valid"))
    docs = M.validity(v, RUN).join(M.example_arrays(v, RUN), RUN)
    path = scratch_path(spark, "result-examples")
    IO.write_results(docs.select(*RUN, F.col("total").alias("n_samples"), "valid", "validity_rate", "examples"), path)
    back = IO.scan_results(spark, path, IO.EXAMPLES_SCHEMA)
    rows = back.select(*RUN, F.explode("examples").alias("class", "_l")).select(*RUN, "class", F.inline("_l"))
    return rows.select(*RUN, "class", "rn", "id", "prompt", "extracted")


@query("report_explode")
def q_report_explode(spark, sf):
    runs_ = M.validity(verdicts(spark, sf), ["rule", "model"])
    rep = runs_.groupBy(F.col("rule").alias("grammar")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        "model", F.struct("validity_rate", "valid", "total"))))).alias("models"))
    path = scratch_path(spark, "reports")
    rep.write.mode("overwrite").json(path)
    return IO.scan_report(spark, path)


# ---- streaming (T-1..T-3) ---------------------------------------------------------------------------------------

@query("stream_tokenize")
def q_stream_tokenize(spark, sf):
    return ST.stream_tokenize(spark, sf)


@query("stream_mix")
def q_stream_mix(spark, sf):
    syn, n_syn = synthetic_corpus(spark, sf)
    return ST.stream_mix(spark, sf, materialize(syn.select("doc_pos", "text")), n_syn)


@query("stream_mix_cyclic")
def q_stream_mix_cyclic(spark, sf):
    """The mix with the cyclic cursor as a stream: equals mix_ratio."""
    syn, n_syn = synthetic_corpus(spark, sf)
    docs = ST.read_stream(spark, sf, "documents", ["doc_id", "text"]).withColumnRenamed("doc_id", "pos")
    return RS.mixed(docs, materialize(syn.select("doc_pos", "text")), n_syn, scratch_path(spark, "stream-mix-cyclic"))


@query("shuffle_buffered")
def q_shuffle_buffered(spark, sf):
    return X.window_shuffle(load(spark, sf, "documents", ["doc_id"]), "doc_id")


@query("stream_shuffle")
def q_stream_shuffle(spark, sf):
    docs = ST.read_stream(spark, sf, "documents", ["doc_id"])
    return RS.shuffled(docs, "doc_id", scratch_path(spark, "stream-shuffle"))


@query("stream_validity_prompt")
def q_stream_validity_prompt(spark, sf):
    """Running counters by prompt, in update mode with an upsert of the changed rows."""
    ev = ST.read_stream(spark, sf, "events", ["event_id", "event_type", "props"])
    v = M.validity(M.verdicts(G.generation_samples(ev)), RUN + ["prompt"])
    return RS.upserted(v, RUN + ["prompt"], scratch_path(spark, "stream-validity-prompt"))


@query("stream_validity")
def q_stream_validity(spark, sf):
    return ST.stream_validity(spark, sf)


# ---- rules over ordered rows (P9 with P2-P8) ------------------------------------------------------------------------

def days(spark, sf) -> DataFrame:
    """The events of each user and day: the sequences that the rules judge."""
    e = load(spark, sf, "events", ["event_id", "ts", "user_id", "event_type"])
    return e.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


for _name, _rule in RR.EVENT_RULES.items():
    QUERIES[f"rows_{_name}"] = (lambda r: lambda spark, sf: RR.judge(
        days(spark, sf), ["user_id", "day"], ["ts", "event_id"], "event_type", r))(_rule)

for _name, _rule in RR.TURN_RULES.items():
    QUERIES[f"turns_{_name}"] = (lambda r: lambda spark, sf: RR.judge(
        load(spark, sf, "conversations", ["conv_id", "turn", "role"]), ["conv_id"], ["turn"], "role", r))(_rule)


# ---- the model of order n on documents (A5-A8, A10-A12) --------------------------------------------------------------

def parted(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Documents to learn from and held-out ones, by a hash of the id."""
    d = load(spark, sf, "documents", ["doc_id", "text", "lang"])
    out = u32(md5_key("held-out", F.col("doc_id"))) % 10 == 0
    return d.where(~out), d.where(out)


@query("docs_model")
def q_docs_model(spark, sf):
    return ON.sizes(ON.estimate(parted(spark, sf)[0], ["lang"]))


def docs_losses(spark, sf):
    train, held = parted(spark, sf)
    return ON.text_losses(ON.estimate(train, ["lang"]), held, ["doc_id"])


@query("docs_ppl_text")
def q_docs_ppl_text(spark, sf):
    return docs_losses(spark, sf).select("lang", "doc_id", F.round("loss_sum", 6).alias("loss"), "n_tokens", F.round("ppl", 6).alias("ppl"))


@query("docs_ppl")
def q_docs_ppl(spark, sf):
    n = parted(spark, sf)[1].groupBy("lang").agg(F.count(F.lit(1)).alias("n_samples"))
    return N.ppl_corpus(docs_losses(spark, sf), ["lang"], n)


@query("docs_completion")
def q_docs_completion(spark, sf):
    train, held = parted(spark, sf)
    return ON.completion(ON.estimate(train, ["lang"]), held)


@query("docs_next_token")
def q_docs_next_token(spark, sf):
    """The probability of every held-out document's last token after all the tokens before it."""
    train, held = parted(spark, sf)
    t = T.tokens(F.col("text"))
    tests = held.where(F.size(t) > 1).select("doc_id", "lang", F.array_join(F.slice(t, F.lit(1), F.size(t) - 1), " ").alias("prefix"),
                                             F.element_at(t, -1).alias("token"))
    p = ON.next_token_probs(ON.estimate(train, ["lang"]), tests)
    return p.select("lang", "doc_id", "token", F.round(-F.log("prob"), 6).alias("loss"))
