"""Corpus building: examples-only corpora, exact-ratio interleave of explanations, ratio mixing with a canonical
corpus, seeded shuffle, truncation, token budget and achieved-ratio audit.

Interleave is closed form: with ``n`` examples and ratio ``r`` the reference loop inserts an explanation before
example ``m * every`` for ``m = 1 .. K`` where ``k = max(1, int(n r / (1 - r)))``, ``every = max(1, n // (k + 1))``
and ``K = min(k, (n - 1) // every)``. Every output row therefore knows its own position -- no global window, no
driver loop -- and the dense corpus position of example ``i`` is ``i + min(K, i // every)``.

Mixing draws, for each canonical row in order, a geometric number of synthetic rows placed before it (each draw
is synthetic with probability ``p``). The synthetic rows are read cyclically, so each canonical row needs the
running total of earlier draws: ``prefix_sum`` computes it with block totals (a small table) plus a per-block
window, never a single-partition window over the whole corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.functions import text as T
from seqlab.functions.draws import md5_key, pick, u32, uniform
from seqlab.operators import rules as R
from seqlab.operators import scan
from seqlab.operators import synth as S

# --- fixed values: explanation ratios of the synthetic corpora, mixing probability, truncation length --------
EXPLANATION_RATIOS = [0.01, 0.05, 0.10, 1.00]
MIX_PROBABILITY = 0.1
MAX_SEQ_TOKENS = 512
SHUFFLE_SEED = 42
SHUFFLE_BUFFER = 10_000
# -------------------------------------------------------------------------------------------------------------

# Explanations are composed from the rules' tokens and limits. grammar1 and grammar2 explain with one block; the other
# rule sets with single sentences, one picked uniformly per insertion.
def _run_explanation(name: str, opening: str, middle: str, closing: str, most: int | None = None) -> list[str]:
    count = "any positive number" if most is None else f"at most {most} and at least 1"
    out = [f"{name}: {opening} first, {closing} last, and {count} of {middle} in the middle.",
           f"A {name} sequence has no fewer than 3 tokens, as in {opening} {middle} {closing}."]
    if most is not None:
        out.append(f"A {name} sequence has no more than {most + 2} tokens.")
    return out


def _pair_explanation(name: str, allowed: dict[str, list[str]], most: int) -> list[str]:
    out = [f"{name} is read two tokens at a time, up to {most} times."]
    return out + [f"What comes after {head} is {' or '.join(tails)}." for head, tails in allowed.items()]


def _mirror_explanation(name: str, opening: str, closing: str, inner: list[str], even: list[str]) -> list[str]:
    return [f"{name}: {opening} and {closing} enclose a palindrome over {', '.join(inner)}.",
            f"In {name} the count of {' and the count of '.join(even)} is each divisible by 2.",
            f"{name} allows the empty palindrome, {opening} {closing}."]


EXPLANATION_BLOCKS = {
    "grammar1": "\n".join(_run_explanation("grammar1", "START", "MID", "END")),
    "grammar2": "\n".join(_pair_explanation("grammar2", {"RED": R.RED_SHAPES, "BLUE": R.BLUE_SHAPES}, 4)),
}
EXPLANATION_SENTENCES = {
    "grammar3": _mirror_explanation("grammar3", R.G3_OPEN, R.G3_CLOSE, list(R.G3_CONTENT), list(R.G3_EVEN_ONLY)),
    "tivari": _run_explanation("tivari", R.TV_OPEN, R.TV_MID, R.TV_CLOSE),
    "tivari_b": _run_explanation("tivari_b", R.TV_OPEN, R.TV_MID, R.TV_CLOSE, 4),
}


def explanation_text(rule: str) -> str:
    """Full explanation text of a rule set (sentence lists joined by newlines)."""
    if rule in EXPLANATION_BLOCKS:
        return EXPLANATION_BLOCKS[rule]
    return "\n".join(EXPLANATION_SENTENCES[rule])


def explanation_lines(rule: str) -> int:
    return len(explanation_text(rule).strip().split("\n"))


def explanation_pick(rule: str, key: Column) -> Column:
    """Uniform pick of one explanation sentence (or the block) for an insertion keyed by ``key``."""
    if rule in EXPLANATION_BLOCKS:
        return F.lit(EXPLANATION_BLOCKS[rule])
    sents = EXPLANATION_SENTENCES[rule]
    return pick(sents, u32(md5_key(f"expl:{rule}", key)) % len(sents))


# ---- interleave ------------------------------------------------------------------------------------------------

def interleave_plan(n: int, ratio: float, mode: str = "docs", lines: int = 1) -> tuple[int, int, int]:
    """(k, every, K): requested inserts, spacing, inserts actually made, for ``n`` examples.

    ``mode`` selects how ``k`` is derived: ``docs`` (document share), ``lines_a`` (share of lines counted over the
    grown corpus) or ``lines_b`` (share of lines over the examples only).
    """
    if mode == "docs":
        k = max(1, int(n * ratio / (1 - ratio)))
    elif mode == "lines_a":
        total = n + int(n * ratio / (1 - ratio))
        k = max(1, int(total * ratio / lines))
    elif mode == "lines_b":
        k = max(1, int(n * ratio / lines))
    else:
        raise ValueError(mode)
    every = max(1, n // (k + 1))
    big_k = min(k, (n - 1) // every) if n > 0 else 0
    return k, every, big_k


def interleave(examples: DataFrame, n: int, rule: str, ratio: float, mode: str = "docs",
               wrap: bool = True, pos_col: str = "pos") -> DataFrame:
    """Interleave explanations into ``examples(pos, text)`` (``pos`` dense 0..n-1).

    Returns (rule, ratio, ord, doc_pos, kind, text): ``ord`` orders the corpus (2*pos for an insertion before
    example pos, 2*pos+1 for the example) and ``doc_pos`` is the dense 0-based corpus position.
    """
    ex = examples.select(F.col(pos_col).alias("pos"), F.col("text"))
    if ratio >= 1.0:
        # All documents are explanations, one per example slot.
        return ex.select(F.lit(rule).alias("rule"), F.lit(ratio).alias("ratio"), (F.col("pos") * 2).alias("ord"),
                         F.col("pos").alias("doc_pos"), F.lit("explanation").alias("kind"),
                         explanation_pick(rule, F.col("pos")).alias("text"))
    k, every, big_k = interleave_plan(n, ratio, mode, explanation_lines(rule))
    pos = F.col("pos")
    text = S.wrap(rule, F.col("text")) if wrap else F.col("text")
    examples_out = ex.select(
        F.lit(rule).alias("rule"), F.lit(ratio).alias("ratio"), (pos * 2 + 1).alias("ord"),
        (pos + F.least(F.lit(big_k), F.expr(f"pos div {every}"))).alias("doc_pos"),
        F.lit("example").alias("kind"), text.alias("text"))
    m = F.expr(f"pos div {every}")
    inserts = (ex.filter((pos > 0) & (pos % every == 0) & (m <= big_k))
                 .select(F.lit(rule).alias("rule"), F.lit(ratio).alias("ratio"), (pos * 2).alias("ord"),
                         (pos + m - 1).alias("doc_pos"), F.lit("explanation").alias("kind"),
                         explanation_pick(rule, m).alias("text")))
    return examples_out.unionByName(inserts)


def corpus_examples(ids: DataFrame, rules: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Examples-only corpora: valid sentences (wrapped for tagged rule sets) with ``doc_pos`` = id."""
    out = None
    for r in rules or R.RULES:
        df = S.synth_valid(ids, r, seed).select(F.lit(r).alias("rule"), F.col("id").alias("doc_pos"),
                                                S.wrap(r, F.col("text")).alias("text"))
        out = df if out is None else out.unionByName(df)
    return out


# ---- mixing ----------------------------------------------------------------------------------------------------

def prefix_sum(df: DataFrame, pos_col: str, val_col: str, out_col: str = "cum_before") -> DataFrame:
    """Exclusive running sum of ``val_col`` in ``pos_col`` order; positions need not be dense.

    Totals of range partitions first, then sums within a partition (`scan.running_total`): no window spans the input.
    """
    return scan.running_total(df, [pos_col], val_col, out_col)


def geometric_draws(pos: Column, p: float, seed: int | str = SHUFFLE_SEED) -> Column:
    """Number of synthetic draws before a canonical row: P(g >= k) = p^k (each draw synthetic w.p. ``p``)."""
    u = uniform(md5_key(f"mix:{seed}", pos))
    return F.floor(F.log(u) / F.lit(math.log(p))).cast("long")


def density(df: DataFrame, col: str):
    """(n, u, lo, hi, dense): rows, distinct values and range of a column, and whether it numbers the rows 0 .. n-1."""
    r = df.agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"), F.count_distinct(col).alias("u")).first()
    return r.n, r.u, r.lo, r.hi, not r.n or (r.lo == 0 and r.hi == r.n - 1 and r.u == r.n)


def dense_count(df: DataFrame, col: str) -> int:
    """Number of rows whose positions are 0 .. n-1; any gap or repeat raises, for callers that can't rank them."""
    n, u, lo, hi, dense = density(df, col)
    if not dense:
        raise ValueError(f"{col} must number the rows from 0 without gaps or repeats: {n} rows, {u} values, {lo} to {hi}")
    return n


def dense_positions(df: DataFrame, col: str) -> tuple[DataFrame, int]:
    """The rows with ``col`` replaced by its rank from 0, and their number. Numbers that are dense already stay as they are;
    others (with gaps or repeats, or not from 0) are ranked over range partitions, without a global window."""
    n, _, _, _, dense = density(df, col)
    if dense:
        return df, n
    return scan.numbered(df, [col], "_rank").drop(col).withColumnRenamed("_rank", col).select(*df.columns), n


def mix_ratio(canonical: DataFrame, synthetic: DataFrame, n_synthetic: int, p: float = MIX_PROBABILITY,
              canon_pos: str = "pos", syn_pos: str = "doc_pos", drawn: int = 0) -> DataFrame:
    """Interleave a canonical corpus (pos, text) with a synthetic corpus (doc_pos, text) read cyclically.

    Output (canon_pos, slot, source, syn_pos, text): for canonical row ``i``, ``g_i`` synthetic rows (slots
    0..g_i-1) then the canonical row (slot g_i); synthetic draw ``j`` overall reads ``doc_pos = j mod n``. ``drawn``: draws
    that were made before these rows.
    """
    c = canonical.select(F.col(canon_pos).alias("canon_pos"), F.col("text"),
                         geometric_draws(F.col(canon_pos), p).alias("g"))
    # texts stay in the scan: only positions and draw counts go through the running total
    sums = prefix_sum(c.select("canon_pos", "g").filter(F.col("g") > 0), "canon_pos", "g")
    canon_rows = c.select("canon_pos", F.col("g").alias("slot"), F.lit("canonical").alias("source"),
                          F.lit(None).cast("long").alias("syn_pos"), "text")
    draws = (sums.select("canon_pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("slot"),
                      "cum_before"))
    draws = draws.select("canon_pos", "slot", F.pmod(F.col("cum_before") + F.col("slot") + F.lit(drawn),
                                                     F.lit(n_synthetic)).alias("syn_pos"))
    syn = synthetic.select(F.col(syn_pos).alias("syn_pos"), F.col("text"))
    syn_rows = draws.join(syn, "syn_pos").select("canon_pos", "slot", F.lit("synthetic").alias("source"),
                                                  "syn_pos", "text")
    return canon_rows.unionByName(syn_rows)


def shuffle_key(pos: Column, seed: int = SHUFFLE_SEED) -> Column:
    return md5_key(f"shuffle:{seed}", pos)


def shuffle_seeded(df: DataFrame, pos_col: str, seed: int = SHUFFLE_SEED) -> DataFrame:
    """Global seeded shuffle: sort by md5(seed:pos) (range-partitioned sort, spills; no single task)."""
    return df.withColumn("shuffle_key", shuffle_key(F.col(pos_col), seed)).orderBy("shuffle_key")


def window_keys(df: DataFrame, pos_col: str, buffer: int = SHUFFLE_BUFFER, seed: int = SHUFFLE_SEED) -> DataFrame:
    """The rows with `shuffle_at`, up to ``buffer`` - 1 places after their own, and `shuffle_key` for ties."""
    key = md5_key(f"window:{seed}", F.col(pos_col))
    rows = df.withColumn("shuffle_key", key)
    return rows.withColumn("shuffle_at", F.col(pos_col) + u32(F.col("shuffle_key")) % buffer)


def window_shuffle(df: DataFrame, pos_col: str, buffer: int = SHUFFLE_BUFFER, seed: int = SHUFFLE_SEED) -> DataFrame:
    """Shuffle in stream order, as a buffer does: every row moves by less than ``buffer`` places, given as `shuffled_pos`.

    A row is ordered by a place drawn from the ``buffer`` places after its own. Rows ``buffer`` places apart can't change
    order, so what a buffer in one task does is a sort by ranges here."""
    rows = scan.numbered(window_keys(df, pos_col, buffer, seed), ["shuffle_at", "shuffle_key"], "shuffled_pos")
    return rows.drop("shuffle_at", "shuffle_key")


# ---- truncation, budget, audit ----------------------------------------------------------------------------------

def truncate_tokens(df: DataFrame, text_col: str = "text", max_tokens: int = MAX_SEQ_TOKENS) -> DataFrame:
    toks = T.tokens(F.col(text_col))
    return df.select("*", F.size(toks).cast("int").alias("n_tokens"),
                     F.array_join(F.slice(toks, 1, max_tokens), " ").alias("truncated"))


def token_budget(df: DataFrame, keys: list[str], text_col: str = "text",
                 max_tokens: int = MAX_SEQ_TOKENS) -> DataFrame:
    n = T.n_tokens_norm(T.ws_norm(F.col(text_col)))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"),
                                 F.sum(n).cast("long").alias("raw_tokens"),
                                 F.sum(F.least(n, F.lit(max_tokens))).cast("long").alias("budget_tokens"))


def mix_audit(corpus: DataFrame, keys: list[str]) -> DataFrame:
    """Achieved explanation share per corpus (requested ratio is a key column)."""
    g = corpus.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"),
                                  F.count_if(F.col("kind") == "explanation").alias("n_explanations"))
    return g.select(*keys, "n_docs", "n_explanations",
                    F.round(F.col("n_explanations") / F.col("n_docs"), 6).alias("achieved_ratio"))


def interleave_grid(ids: DataFrame, n: int, ratios: dict[str, float], rules: list[str] | None = None,
                    seed: int = 42, id_col: str = "id") -> DataFrame:
    """Every rule set x every corpus condition in one pipeline: (rule, variant, ord, doc_pos, kind, text).

    Same rows as ``interleave`` per (rule, ratio) (``ratio`` 0 = examples only), but rules and conditions are
    exploded from literal arrays and dispatched per row, so the plan has two branches instead of one per corpus.
    """
    rules = rules or R.RULES
    arr = F.array(*[F.lit(r) for r in rules])
    base = ids.select(F.col(id_col).alias("pos"), F.explode(arr).alias("rule"))
    base, d = S.with_draws(base, S.sentence_key(seed, F.col("rule"), F.col("pos")))
    rc = F.col("rule")
    sent = S.by_rule_col(rc, lambda r: S.wrap(r, S.valid_sentence(r, d)))
    base = base.select("pos", "rule", sent.alias("text"))
    # the (variant, every, kk) of a rule are one literal array: a condition for each pair outgrows the JIT's method limit
    plans = {r: {v: interleave_plan(n, x, "docs", explanation_lines(r)) if 0 < x < 1 else (0, 0, 0) for v, x in ratios.items()} for r in rules}
    conditions = S.by_rule_col(rc, lambda r: F.array(*[
        F.struct(F.lit(v).alias("variant"), F.lit(p[1]).alias("_every"), F.lit(p[2]).alias("_kk")) for v, p in plans[r].items()]), rules)
    grid = base.select("pos", "rule", "text", F.inline(conditions))
    pos, every, kk = F.col("pos"), F.col("_every"), F.col("_kk")
    ex = grid.select("rule", "variant", (pos * 2 + 1).alias("ord"),
                     (pos + F.when(kk > 0, F.least(kk, F.expr("pos div _every"))).otherwise(0))
                     .alias("doc_pos"), F.lit("example").alias("kind"), "text")
    m = F.expr("pos div _every")
    ins = (grid.filter((kk > 0) & (pos > 0) & (pos % every == 0) & (m <= kk))
               .select("rule", "variant", (pos * 2).alias("ord"), (pos + m - 1).alias("doc_pos"),
                       F.lit("explanation").alias("kind"),
                       S.by_rule_col(rc, lambda r: explanation_pick(r, m)).alias("text")))
    return ex.unionByName(ins)
