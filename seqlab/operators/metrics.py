"""Validity metrics over generation samples: overall, lenient, per prompt, rollup, examples per class.

All aggregates are plain ``groupBy().agg()`` (partial aggregation before the shuffle, so a hot group is combined
map-side) and rates use ``try_divide`` so an empty group publishes 0 instead of raising under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab.functions import text as T
from seqlab.functions.fence import fence
from seqlab.operators import rules as R

RUN_KEYS = ["model", "rule", "variant", "step"]


def rate(num: Column, den: Column, digits: int = 6) -> Column:
    """num / den rounded; 0.0 when den is 0 (the reference publishes 0 for empty sets)."""
    return F.round(F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0)), digits)


def verdicts(samples: DataFrame) -> DataFrame:
    """samples + extracted, is_valid, is_lenient_valid (null where the rule set has no lenient check)."""
    return R.with_verdicts(samples, "generated", "rule")


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("is_valid")).alias("valid"),
            F.count_if(F.coalesce(F.col("is_lenient_valid"), F.lit(False))).alias("lenient_valid")]


def validity(v: DataFrame, keys: list[str]) -> DataFrame:
    """total, valid, invalid, lenient_valid and both rates per group of ``keys``."""
    g = v.groupBy(*keys).agg(*_counts())
    return g.select(*keys, "total", "valid", (F.col("total") - F.col("valid")).alias("invalid"),
                    rate(F.col("valid"), F.col("total")).alias("validity_rate"),
                    "lenient_valid", rate(F.col("lenient_valid"), F.col("total")).alias("lenient_validity_rate"))


def validity_rollup(v: DataFrame) -> DataFrame:
    """Totals and per-prompt figures in one pass: ROLLUP(rule, variant, step, prompt)."""
    g = v.rollup("rule", "variant", "step", "prompt").agg(*_counts())
    return g.select("rule", "variant", "step", "prompt", "total", "valid",
                    rate(F.col("valid"), F.col("total")).alias("validity_rate"),
                    "lenient_valid", rate(F.col("lenient_valid"), F.col("total")).alias("lenient_validity_rate"))


def sample_class(v: DataFrame) -> DataFrame:
    cls = (F.when(F.col("is_valid"), "valid")
           .when(F.coalesce(F.col("is_lenient_valid"), F.lit(False)), "lenient_only")
           .otherwise("invalid"))
    return v.withColumn("class", cls)


def examples_per_class(v: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """First ``k`` samples (by id, i.e. arrival order) of each class per group.

    ``row_number() <= k`` is planned with a partial WindowGroupLimit before the exchange, so each map task ships
    at most ``k`` rows per group -- a hot group never lands whole in one task.
    """
    c = sample_class(v)
    w = Window.partitionBy(*keys, "class").orderBy("id")
    return (c.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
             .select(*keys, "class", F.col("rn").cast("int").alias("rn"), "id", "prompt", "extracted"))


def example_arrays(v: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """(keys, examples): a map of class to its first ``k`` samples (id, prompt, extracted) in arrival order. What is gathered of
    a key is at most ``k`` rows a class."""
    e = examples_per_class(v, keys, k)
    lists = e.groupBy(*keys, "class").agg(F.sort_array(F.collect_list(F.struct("rn", "id", "prompt", "extracted"))).alias("_l"))
    return lists.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "_l")))).alias("examples"))


def lenient_only(v: DataFrame) -> DataFrame:
    """Residue: lenient-valid but not strictly valid."""
    return (v.filter(F.coalesce(F.col("is_lenient_valid"), F.lit(False)) & ~F.col("is_valid"))
             .select("id", "rule", "prompt", "extracted"))


def violation_classes(v: DataFrame) -> DataFrame:
    """Which rule a sample breaks first (in the rule set's own check order), or ``valid``."""
    n = v.select("id", "rule", "variant", T.ws_norm(F.col("extracted")).alias("_n"))
    c = n.select("id", "rule", "variant",
                 R.by_rule(F.col("rule"), lambda s: s.violation_norm(F.col("_n"))).alias("violation"))
    return fence(c, ["id", "rule", "variant"], ["violation"])
