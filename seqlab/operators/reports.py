"""Comparison reports over per-run metric rows: leaderboard, pivots, baseline tests, trends, best variant.

Inputs are aggregated run rows (one per model/rule/variant/step), so windows here partition small, bounded
tables -- the per-sample work has already been reduced by partial aggregation upstream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlab.functions.stats import pooled_z, stars, two_sided_p
from seqlab.operators.generation import VARIANTS
from seqlab.operators import rules as R
from seqlab.operators.metrics import rate

BASELINE_VARIANT = "examples"


def leaderboard(runs: DataFrame) -> DataFrame:
    """Models by validity rate descending (null counts as 0), ties by name; ``position`` is 1-based."""
    key = F.coalesce(F.col("validity_rate"), F.lit(0.0))
    w = Window.orderBy(key.desc(), F.col("model"))
    return runs.select("model", "validity_rate", F.row_number().over(w).cast("int").alias("position"))


def checkpoint_order(names: DataFrame, col: str = "checkpoint") -> DataFrame:
    """Checkpoint names by their numeric suffix (``checkpoint-N``), not lexically."""
    num = F.regexp_extract(F.col(col), r"-(\d+)$", 1).cast("int")
    w = Window.orderBy(num, F.col(col))
    return names.select(col, num.alias("step_num"), F.row_number().over(w).cast("int").alias("position"))


def pivot_by_variant(v: DataFrame, keys: list[str]) -> DataFrame:
    """Validity rate per ``keys`` with one column per variant (explicit value list: no extra job to find them)."""
    g = v.groupBy(*keys).pivot("variant", VARIANTS).agg(
        rate(F.count_if(F.col("is_valid")), F.count(F.lit(1))))
    return g


def baseline_join(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Each non-baseline run beside the baseline run with the same ``keys`` (inner equi-join)."""
    base = (runs.filter(F.col("variant") == BASELINE_VARIANT)
                .select(*keys, F.col("valid").alias("base_valid"), F.col("total").alias("base_total"),
                        F.col("validity_rate").alias("base_rate")))
    return runs.filter(F.col("variant") != BASELINE_VARIANT).join(base, keys, "inner")


def z_test(runs: DataFrame, keys: list[str]) -> DataFrame:
    j = baseline_join(runs, keys)
    z = pooled_z(F.col("valid").cast("double"), F.col("total").cast("double"),
                 F.col("base_valid").cast("double"), F.col("base_total").cast("double"))
    j = j.withColumn("z", z).withColumn("p", two_sided_p(F.col("z")))
    return j.select(*keys, "variant", "valid", "total", "base_valid", "base_total",
                    F.round("z", 6).alias("z"), F.round("p", 6).alias("p_value"),
                    F.when(F.col("z").isNull(), F.lit("")).otherwise(stars(F.col("p"))).alias("stars"))


def pp_delta(runs: DataFrame, keys: list[str]) -> DataFrame:
    j = baseline_join(runs, keys)
    d = F.col("validity_rate") - F.col("base_rate")
    return j.select(*keys, "variant", "validity_rate", "base_rate",
                    F.round(d * 100.0, 6).alias("delta_pp"),
                    F.round(F.try_divide(d, F.col("base_rate")), 6).alias("rel_improvement"))


def best_variant(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Best variant per group by validity rate; ties are all listed (rank, not row_number)."""
    w = Window.partitionBy(*keys).orderBy(F.col("validity_rate").desc())
    return (runs.withColumn("rk", F.rank().over(w)).filter(F.col("rk") == 1)
                .select(*keys, "variant", "validity_rate"))


def checkpoint_trend(runs: DataFrame, keys: list[str], step: str = "step") -> DataFrame:
    """Per run series over steps: previous rate, change, peak step (earliest at the maximum), final minus peak."""
    w = Window.partitionBy(*keys).orderBy(step)
    wall = Window.partitionBy(*keys)
    peak = F.max(F.struct(F.col("validity_rate"), (-F.col(step)).alias("neg"))).over(wall)
    last = F.max_by(F.col("validity_rate"), F.col(step)).over(wall)
    prev = F.lag("validity_rate").over(w)
    return runs.select(*keys, step, "validity_rate", prev.alias("prev_rate"),
                       F.round(F.col("validity_rate") - prev, 6).alias("delta"),
                       (-peak["neg"]).alias("peak_step"),
                       F.round(last - peak["validity_rate"], 6).alias("final_minus_peak"))


def parse_run_names(names: DataFrame, col: str = "model") -> DataFrame:
    """Split run names ``<base>_<rule>_<variant>_checkpoint-<step>`` into parts; percent label from the variant."""
    c = F.col(col)
    rule_alt = "|".join(sorted(R.RULES, key=len, reverse=True))
    var_alt = "|".join(sorted(VARIANTS, key=len, reverse=True))
    pat = r"^(.+?)_(%s)_(%s)_checkpoint-(\d+)$" % (rule_alt, var_alt)
    pct = F.regexp_extract(c, r"_explained_(\d+)pct_", 1)
    return names.select(col, F.regexp_extract(c, pat, 1).alias("base"), F.regexp_extract(c, pat, 2).alias("rule"),
                        F.regexp_extract(c, pat, 3).alias("variant"),
                        F.regexp_extract(c, pat, 4).cast("int").alias("step"),
                        F.when(pct == "", F.lit(0)).otherwise(pct.cast("int")).alias("pct"))
