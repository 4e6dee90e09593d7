"""Bigram language model as Spark aggregates: estimation, next-token probabilities, decision tests, per-token
loss and perplexity.

Estimation is ``groupBy(model, prev, next).count()`` over in-row token pairs (``posexplode`` plus an index read of
the successor, so no window or self-join is needed to pair neighbours) -- partial aggregation runs before the shuffle, so a hot context
token is combined map-side. Context totals and vocabulary sizes come from the count table. Losses are worked out once
per distinct pair, so scoring is one join of the token pairs with that table, by ordinary equi-joins that AQE turns
into broadcasts only when their runtime size is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.functions import text as T

# --- fixed values: decision-point thresholds (mass tests) ------------------------------------------------------
MASS_THRESHOLD_RUN = 0.1
MASS_THRESHOLD_PAIR = 0.05
MASS_THRESHOLD_CLOSE = 0.01
SMOOTHING_ALPHA = 0.1
SHARE = 20_000
# -------------------------------------------------------------------------------------------------------------

# --- fixed values: decision-point tests per rule set: (name, kind, prefix, good tokens, bad tokens, threshold) -----
#   prefer: p(good) > p(bad)          group: sum p(good) > sum p(bad)          mass: sum p(good) > threshold
#   each: p(good) > p(bad) for every bad token
DECISION_TESTS = {
    "grammar1": [
        ("start_prefer_mid", "prefer", "START", ["MID"], ["END"], None),
        ("after_one_mid_valid_continuations", "mass", "START MID", ["END", "MID"], [], MASS_THRESHOLD_RUN),
        ("after_three_mids_valid_continuations", "mass", "START MID MID MID", ["END", "MID"], [],
         MASS_THRESHOLD_RUN),
        ("no_double_start", "prefer", "START", ["MID"], ["START"], None),
    ],
    "grammar2": [
        ("red_valid_shapes", "group", "RED", ["CIRCLE", "SQUARE"], ["TRIANGLE", "DIAMOND"], None),
        ("blue_valid_shapes", "group", "BLUE", ["TRIANGLE", "DIAMOND"], ["CIRCLE", "SQUARE"], None),
        ("after_pair_colors", "mass", "RED CIRCLE", ["RED", "BLUE"], [], MASS_THRESHOLD_PAIR),
        ("red_not_triangle", "prefer", "RED", ["CIRCLE"], ["TRIANGLE"], None),
    ],
    "grammar3": [
        ("open_prefers_content_or_close", "group", "<tivari3> FEP", ["NUL", "TAS", "WEJ", "KOB", "GOR"],
         ["FEP", "BLAX"], None),
        ("tag_then_open", "prefer", "<tivari3>", ["FEP"], ["GOR"], None),
        ("content_continues", "mass", "<tivari3> FEP NUL", ["NUL", "TAS", "WEJ", "KOB", "GOR"], [],
         MASS_THRESHOLD_RUN),
        ("close_then_end_tag", "prefer", "<tivari3> FEP GOR", ["</tivari3>"], ["FEP"], None),
        ("mirror_start", "each", "<tivari3> FEP NUL", ["NUL"], ["TAS", "WEJ"], None),
        ("mirror_middle", "each", "<tivari3> FEP NUL KOB", ["KOB"], ["NUL", "TAS"], None),
        ("mirror_closing", "each", "<tivari3> FEP NUL KOB KOB", ["NUL"], ["KOB", "TAS"], None),
        ("close_after_pair", "mass", "<tivari3> FEP NUL NUL", ["GOR"], [], MASS_THRESHOLD_CLOSE),
    ],
    "tivari": [
        ("xaq_prefer_ziv", "prefer", "XAQ", ["ZIV"], ["BEK"], None),
        ("after_one_ziv_valid_continuations", "mass", "XAQ ZIV", ["BEK", "ZIV"], [], MASS_THRESHOLD_RUN),
        ("after_three_zivs_valid_continuations", "mass", "XAQ ZIV ZIV ZIV", ["BEK", "ZIV"], [], MASS_THRESHOLD_RUN),
        ("no_double_xaq", "prefer", "XAQ", ["ZIV"], ["XAQ"], None),
    ],
    "tivari_b": [
        ("xaq_prefer_ziv", "prefer", "XAQ", ["ZIV"], ["BEK"], None),
        ("after_one_ziv_valid_continuations", "mass", "XAQ ZIV", ["BEK", "ZIV"], [], MASS_THRESHOLD_RUN),
        ("after_three_zivs_valid_continuations", "mass", "XAQ ZIV ZIV ZIV", ["BEK", "ZIV"], [], MASS_THRESHOLD_RUN),
        ("no_double_xaq", "prefer", "XAQ", ["ZIV"], ["XAQ"], None),
        ("four_zivs_prefer_bek", "prefer", "XAQ ZIV ZIV ZIV ZIV", ["BEK"], ["ZIV"], None),
    ],
}
# -------------------------------------------------------------------------------------------------------------


def suffixes(prefix: str) -> list[str]:
    """The whole prefix and its shorter ends, longest first."""
    t = prefix.split()
    return [" ".join(t[i:]) for i in range(len(t))]


def decision_tests_dim(spark) -> DataFrame:
    """(rule, test, kind, prefix, contexts, token, side, threshold): one row per (test, token of interest)."""
    rows = []
    for rule, tests in DECISION_TESTS.items():
        for name, kind, prefix, good, bad, thr in tests:
            ctx = suffixes(prefix)
            rows += [(rule, name, kind, prefix, ctx, t, "good", thr) for t in good]
            rows += [(rule, name, kind, prefix, ctx, t, "bad", thr) for t in bad]
    return spark.createDataFrame(
        rows, "rule string, test string, kind string, prefix string, contexts array<string>, token string, side string, "
              "threshold double")


def token_pairs(df: DataFrame, keys: list[str], text_col: str = "text", with_pos: bool = False,
                ends: bool = False) -> DataFrame:
    """(keys..., [pos], prev, next) for every adjacent token pair of every row; ``ends``: also (last token, null).

    ``posexplode`` over all but the last token, the successor read by index from the same array (an
    ``arrays_zip`` of two slices builds a struct per pair and runs several times slower).
    """
    x = df.select(*keys, T.tokens(F.col(text_col)).alias("_t"))
    t = F.col("_t")
    m = F.size(t) if ends else F.greatest(F.size(t) - 1, F.lit(0))
    y = x.select(*keys, "_t", F.posexplode(F.slice(t, 1, m)).alias("pos", "prev"))
    nxt = F.get(t, F.col("pos") + 1).alias("next")
    if with_pos:
        return y.select(*keys, F.col("pos").cast("int").alias("pos"), "prev", nxt)
    return y.select(*keys, "prev", nxt)


def distinct_texts(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys..., text, times): equal texts once, counted before they are shuffled. For corpora of few distinct sentences."""
    return df.groupBy(*keys, F.col(text_col).alias("text")).agg(F.count(F.lit(1)).alias("times"))


def bigram_counts(df: DataFrame, keys: list[str], text_col: str = "text", ends: bool = False,
                  contexts: list[str] | None = None, times: str | None = None) -> DataFrame:
    """(keys..., prev, next, n). ``ends`` counts last tokens under a null successor, so the table holds the vocabulary;
    with ``contexts`` all pairs after other tokens count under (null, null), so every model keeps a row. ``times``: a
    column that says how many equal texts a row stands for."""
    more = [times] if times else []
    pairs = token_pairs(df, keys + more, text_col, ends=ends)
    if contexts is not None:
        wanted = F.col("prev").isin(contexts)
        pairs = pairs.select(*keys, *more, *[F.when(wanted, F.col(c)).alias(c) for c in ("prev", "next")])
    n = F.sum(times) if times else F.count(F.lit(1))
    return pairs.groupBy(*keys, "prev", "next").agg(n.alias("n"))


def prefix_counts(df: DataFrame, keys: list[str], prefixes: list[str], text_col: str = "text", times: str | None = None) -> DataFrame:
    """(keys..., ctx, next, n): tokens after every suffix of the prefixes, anywhere in a text. All other pairs count under
    (null, null), so every model keeps a row. ``times`` as in `bigram_counts`."""
    more = [times] if times else []
    contexts = sorted({c for p in prefixes for c in suffixes(p)})
    lasts, longest = sorted({c.split()[-1] for c in contexts}), max(len(c.split()) for c in contexts)
    t, pos = F.col("_t"), F.col("pos")
    x = df.select(*keys, *more, T.tokens(F.col(text_col)).alias("_t"))
    y = x.select(*keys, *more, "_t", F.posexplode(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))).alias("pos", "prev"))
    ends = F.array(*[F.when(pos + 1 >= k, F.array_join(F.slice(t, F.greatest(pos + 2 - k, F.lit(1)), F.lit(k)), " "))
                     for k in range(1, longest + 1)])
    known = F.when(F.col("prev").isin(lasts), F.filter(ends, lambda c: c.isin(contexts)))
    z = y.select(*keys, *more, F.get(t, pos + 1).alias("next"), F.explode_outer(known).alias("ctx"))
    z = z.select(*keys, *more, "ctx", F.when(F.col("ctx").isNotNull(), F.col("next")).alias("next"))
    return z.groupBy(*keys, "ctx", "next").agg((F.sum(times) if times else F.count(F.lit(1))).alias("n"))


def context_totals(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.where("next is not null").groupBy(*keys, "prev").agg(F.sum("n").alias("ctx_n"))


def vocab_sizes(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct tokens per model (keys), from counts with ends: every token is a ``prev`` there."""
    return counts.select(*keys, "prev").distinct().groupBy(*keys).agg(F.count("prev").alias("vocab"))


def next_token_probs(counts: DataFrame, keys: list[str], tests: DataFrame) -> DataFrame:
    """Maximum-likelihood p(token | prefix) for every (model, test token); 0.0 when unseen. A prefix that a model has
    not seen backs off to its longest suffix that it has.

    ``counts`` come from `prefix_counts`. ``tests`` holds (rule, test, contexts, token, ...) and is crossed with the
    models of its rule by an equi-join on ``rule`` (models carry a ``rule`` key).
    """
    tot = counts.where("next is not null").groupBy(*keys, "ctx").agg(F.sum("n").alias("ctx_n"))
    models = counts.select(*keys).distinct()
    columns = [c for c in tests.columns if c not in ("rule", "contexts")]
    grid = models.join(tests.select("rule", *columns, F.posexplode("contexts").alias("dropped", "ctx")), "rule")
    c = counts.select(*keys, "ctx", F.col("next").alias("token"), "n")
    j = grid.join(c, keys + ["ctx", "token"], "left").join(tot, keys + ["ctx"], "left")
    seen = F.when(F.col("ctx_n").isNotNull(), F.struct("dropped", "n", "ctx_n"))
    j = j.groupBy(*keys, *columns).agg(F.min(seen).alias("seen"))
    p = F.coalesce(F.try_divide(F.col("seen.n").cast("double"), F.col("seen.ctx_n").cast("double")), F.lit(0.0))
    return j.withColumn("prob", p)


def decision_results(probs: DataFrame, keys: list[str]) -> DataFrame:
    g = probs.groupBy(*keys, "test", "kind").agg(
        F.sum(F.when(F.col("side") == "good", F.col("prob")).otherwise(0.0)).alias("good_prob"),
        F.sum(F.when(F.col("side") == "bad", F.col("prob")).otherwise(0.0)).alias("bad_prob"),
        F.coalesce(F.max(F.when(F.col("side") == "bad", F.col("prob"))), F.lit(0.0)).alias("worst"),
        F.max("threshold").alias("threshold"))
    correct = (F.when(F.col("kind") == "mass", F.col("good_prob") > F.col("threshold"))
               .when(F.col("kind") == "each", F.col("good_prob") > F.col("worst"))
               .otherwise(F.col("good_prob") > F.col("bad_prob")))
    return g.select(*keys, "test", "kind", F.round("good_prob", 6).alias("good_prob"),
                    F.round("bad_prob", 6).alias("bad_prob"), correct.alias("correct"))


def completion_accuracy(results: DataFrame, keys: list[str]) -> DataFrame:
    g = results.groupBy(*keys).agg(F.count_if(F.col("correct")).alias("n_correct"),
                                   F.count(F.lit(1)).alias("n_total"))
    return g.select(*keys, "n_correct", "n_total",
                    F.round(F.col("n_correct") / F.col("n_total"), 6).alias("accuracy"))


def loss_table(pairs: DataFrame, counts: DataFrame, shared: list[str], model_keys: list[str],
               alpha: float = SMOOTHING_ALPHA) -> DataFrame:
    """(model_keys..., prev, next, loss) of every distinct pair under every model that has its ``shared`` keys:
    -ln p(next | prev) with add-alpha smoothing over the model's vocabulary. ``counts`` are with ends."""
    seen = pairs.select(*shared, "prev", "next").distinct()
    j = (seen.join(vocab_sizes(counts, model_keys), shared)
             .join(counts, model_keys + ["prev", "next"], "left")
             .join(context_totals(counts, model_keys), model_keys + ["prev"], "left"))
    p = ((F.coalesce(F.col("n"), F.lit(0)) + F.lit(alpha)) /
         (F.coalesce(F.col("ctx_n"), F.lit(0)) + F.lit(alpha) * F.col("vocab")))
    return j.select(*model_keys, "prev", "next", (-F.log(p)).alias("loss"))


def token_loss(eval_texts: DataFrame, eval_keys: list[str], counts: DataFrame, shared: list[str],
               model_keys: list[str], alpha: float = SMOOTHING_ALPHA, texts: DataFrame | None = None) -> DataFrame:
    """Loss of every scored token under every model that has the text's ``shared`` keys (all of them in
    ``eval_keys``). A text is tokenised once for all models; without a model it has no rows. ``texts`` (shared keys, text):
    the distinct texts, where few distinct pairs occur in them; the pairs are then read off these and broadcast, and the
    tokens of ``eval_texts`` are not shuffled."""
    pairs = token_pairs(eval_texts, eval_keys, "text", with_pos=True)
    table = loss_table(pairs if texts is None else token_pairs(texts, shared), counts, shared, model_keys, alpha)
    more = [k for k in model_keys if k not in shared]
    table = table if texts is None else F.broadcast(table)
    return pairs.join(table, shared + ["prev", "next"]).select(*eval_keys, *more, "pos", "prev", "next", "loss")


def met_by_share(rows: DataFrame, table: DataFrame, keys: list[str], times: str, share: int = SHARE) -> DataFrame:
    """Inner join with a written ``table`` of distinct keys, of which ``times`` says how many rows have each. Keys with a part in
    ``share`` of all rows, so ``share`` at most, are broadcast; only rows of the others are shuffled, and none of these is
    hot. ``rows`` are made again for both."""
    total = table.agg(F.sum(times)).first()[0] or 0
    often = F.col(times) * F.lit(share) >= F.lit(total)
    hot, rest = table.where(often), table.where(~often)
    out = rows.join(F.broadcast(hot), keys)
    if rest.isEmpty():
        return out
    rare = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return out.unionByName(rare.join(rest.hint("merge"), keys))


def ppl_per_text(loss: DataFrame, text_keys: list[str]) -> DataFrame:
    """Texts with no scored token (one-token texts) have no loss rows and no perplexity, as in the reference."""
    g = loss.groupBy(*text_keys).agg(F.sum("loss").alias("loss_sum"), F.count(F.lit(1)).alias("n_tokens"))
    return g.withColumn("ppl", F.exp(F.col("loss_sum") / F.col("n_tokens")))


def ppl_corpus(per_text: DataFrame, group_keys: list[str], n_samples: DataFrame, times: tuple[str, str] | None = None) -> DataFrame:
    """Token-weighted perplexity, mean loss, mean and population std of per-text perplexity, token total;
    ``n_samples`` (group_keys..., n_samples) counts every text, scored or not. Without a scored token the losses and
    perplexities are infinite. ``times``: columns that say of how many rows and of how many texts a row has the loss."""
    rows, texts = (F.col(c) for c in times) if times else (F.lit(1), F.lit(1))
    x = per_text.select(*group_keys, (F.col("loss_sum") * rows).alias("loss_sum"), (F.col("n_tokens") * rows).alias("n_tokens"), "ppl", texts.alias("_w"))
    if times:
        means = x.groupBy(*group_keys).agg((F.sum(F.col("ppl") * F.col("_w")) / F.sum("_w")).alias("_mean"))
        x = x.join(means, group_keys)
        mean_ppl, sd = F.first("_mean"), F.sqrt(F.sum(F.col("_w") * (F.col("ppl") - F.col("_mean")) ** 2) / F.sum("_w"))
    else:
        mean_ppl, sd = F.avg("ppl"), F.stddev_pop("ppl")
    g = x.groupBy(*group_keys).agg(F.sum("loss_sum").alias("ls"), F.sum("n_tokens").alias("nt"), mean_ppl.alias("mean_ppl"),
                                   sd.alias("sd"), F.sum("_w").alias("n_scored"))
    g = n_samples.join(g, group_keys, "left")
    mean_loss = F.coalesce(F.try_divide(F.col("ls"), F.col("nt").cast("double")), F.lit(float("inf")))
    return g.select(*group_keys,
                    F.round(F.exp(mean_loss), 6).alias("perplexity"), F.round(mean_loss, 6).alias("mean_loss"),
                    F.round(F.coalesce("mean_ppl", F.lit(float("inf"))), 6).alias("mean_per_text_ppl"),
                    F.round(F.when(F.col("n_scored") > 1, F.col("sd")).otherwise(F.lit(0.0)), 6)
                    .alias("std_per_text_ppl"),
                    F.coalesce(F.col("nt"), F.lit(0)).cast("long").alias("total_tokens"), "n_samples")


def ppl_gap(corpus: DataFrame, model_keys: list[str], label_col: str = "label") -> DataFrame:
    g = corpus.groupBy(*model_keys).agg(
        F.max(F.when(F.col(label_col) == "valid", F.col("perplexity"))).alias("valid_ppl"),
        F.max(F.when(F.col(label_col) == "invalid", F.col("perplexity"))).alias("invalid_ppl"))
    return g.select(*model_keys, "valid_ppl", "invalid_ppl",
                    F.round(F.col("invalid_ppl") - F.col("valid_ppl"), 6).alias("perplexity_gap"),
                    F.round(F.try_divide(F.col("invalid_ppl"), F.col("valid_ppl")), 6).alias("perplexity_ratio"))
