"""Generation samples derived from a driver table, standing where the reference samples a neural model.

Each input row (an ``events`` row) becomes one sample: a rule set, a variant (corpus condition), a checkpoint step,
one of the rule set's prompts, and a generated text. The text is a valid or a broken sentence of the rule set
plus the kinds of residue a model leaves (trailing words taken from the row itself, a second line, fused
punctuation, a stray close tag, leading Unicode spaces). The share of valid bodies depends on variant and step, so
reports over the samples have signal.

All choices come from md5 keys of the row id; no shuffle, no Python per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.functions.draws import Draws, md5_key, nibble, pick, u32
from seqlab.functions.memo import session_cached
from seqlab.operators import rules as R
from seqlab.operators.synth import by_rule_col, invalid_sentence, sentence_key, valid_sentence, with_draws

# --- fixed values: corpus conditions (ordered) and fine-tuning checkpoints ------------------------------------
VARIANTS = ["examples", "explained_1pct", "explained_5pct", "explained_10pct"]
VARIANT_RATIOS = {"examples": 0.0, "explained_1pct": 0.01, "explained_5pct": 0.05, "explained_10pct": 0.10}
STEPS = [1000, 2000, 3000, 4000]
GEN_SEED = "gen"
# -------------------------------------------------------------------------------------------------------------


def generation_samples(events: DataFrame, id_col: str = "event_id") -> DataFrame:
    """samples(id, model, rule, variant, step, prompt, generated) -- one row per input row."""
    ev = events.select(F.col(id_col).alias("id"), "event_type", "props")
    ev = ev.select("*", md5_key("sample", F.col("id")).alias("_ms"))
    m = F.col("_ms")
    base = ev.select(
        "id", "event_type", "props",
        pick(R.RULES, u32(m, 1) % len(R.RULES)).alias("rule"),
        (nibble(m, 9) % len(VARIANTS)).alias("_vi"), (nibble(m, 10) % len(STEPS)).alias("_si"),
        nibble(m, 11).alias("_pd"), nibble(m, 12).alias("_gd"), (nibble(m, 13) % 6).alias("_noise"))
    base = base.select("*", pick(VARIANTS, F.col("_vi")).alias("variant"),
                       F.elt((F.col("_si") + 1).cast("int"), *[F.lit(str(s)) for s in STEPS]).cast("int")
                       .alias("step"),
                       (F.col("_gd") < (F.lit(4) + F.col("_vi") * 2 + F.col("_si"))).alias("_good"))
    r = F.col("rule")
    idc = F.col("id")
    base, _ = with_draws(base, sentence_key(GEN_SEED, r, idc), "_v")
    base, _ = with_draws(base, sentence_key(GEN_SEED, r, idc, "invalid"), "_i")
    prompt, body_expr, o_expr, c_expr, generated = _sample_exprs()
    # Body in its own projection: referenced by every noise branch below, so it must not be inlined.
    base = base.select("id", "rule", "variant", "step", "event_type", "props", "_noise", prompt.alias("prompt"),
                       body_expr.alias("_body"), o_expr.alias("_o"), c_expr.alias("_c"))
    model = F.concat_ws("_", F.lit("ngram"), r, F.col("variant"), F.concat(F.lit("checkpoint-"), F.col("step")))
    return base.select("id", model.alias("model"), "rule", "variant", "step", "prompt",
                       generated.alias("generated"))


@session_cached
def _sample_exprs():
    r = F.col("rule")
    idc = F.col("id")
    dv, di = Draws("_v"), Draws("_i")
    prompt = by_rule_col(r, lambda x: pick(R.PROMPTS[x], F.col("_pd") % len(R.PROMPTS[x])))
    good_body = by_rule_col(r, lambda x: valid_sentence(x, dv))
    bad_body = by_rule_col(r, lambda x: invalid_sentence(x, di, idc))
    body_expr = F.when(F.col("_good"), good_body).otherwise(bad_body)
    body = F.col("_body")
    nz = F.col("_noise")
    word = F.col("event_type")
    untagged = (F.when(nz == 0, body)
                .when(nz == 1, F.concat_ws(" ", body, word))
                .when(nz == 2, F.concat_ws("\n", body, F.col("props")))
                .when(nz == 3, F.concat(body, F.lit(".")))
                .when(nz == 4, F.concat_ws(" ", body, body))
                .otherwise(F.concat(F.lit("\u3000"), body, F.lit("\u00a0"), word)))
    # Tagged rule sets share one expression with per-row tag columns.
    o = F.col("_o")
    c = F.col("_c")
    tagged = (F.when(nz == 0, F.concat_ws(" ", o, body, c))
              .when(nz == 1, F.concat_ws(" ", o, body, c, word))
              .when(nz == 2, F.concat(o, F.lit(" "), body, F.lit("\n"), F.col("props")))
              .when(nz == 3, F.concat(o, F.lit(" "), body, F.lit(". "), c))
              .when(nz == 4, F.concat(o, F.lit(" "), body, F.lit(" "), word, F.lit(" </x>")))
              .otherwise(F.concat(body, F.lit("\n"), word)))
    generated = F.when(o.isNull(), untagged).otherwise(tagged)
    return prompt, body_expr, R.open_tag_col(r), R.close_tag_col(r), generated


def variants_dim(spark) -> DataFrame:
    return spark.createDataFrame([(v, i, VARIANT_RATIOS[v]) for i, v in enumerate(VARIANTS)],
                                 "variant string, ord int, ratio double")
