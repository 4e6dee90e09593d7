"""Quality rules whose cutoffs are chosen with a bound on the clean text that they reject (DataFrame functions only).

Each document gets whole-text counts and five per-mille metrics. For each stratum (four classes of length) and each
metric, cutoffs are tried from the most lenient to the strictest on labelled holdout documents of quality 1. A cutoff
holds if the exact (Clopper-Pearson) upper bound of its false rejection is at most `alpha`, that is if
P(Binomial(n, alpha) <= k) <= delta / (number of strata x metrics); the first that fails ends the walk, so no further
correction is needed within one metric. The strictest cutoff that held is used; where none held, the metric rejects
nothing in that stratum.

Defined results: null or empty text has no words, counts of 0 and fails the base rule. Repeated rows each give a row.
Several labels of one doc_id count as one document, of quality 1 only if all say so. Rows of `labels` with a null
doc_id or quality take no part. Further columns of any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import documents, only, staged

ALPHA, DELTA = 0.01, 0.05
STRATA = (200, 600, 2000)
METRICS = ("symbols", "dup_lines", "repeats", "marks", "capitals")
#: Cutoffs in per mille, most lenient first.
CUTOFFS = tuple(range(1000, 0, -25))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the metrics; one pass over the texts, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    times = lambda chars: (F.size(F.split("text", chars, -1)) - 1).cast("long")  # noqa: E731  of single characters
    out = only(docs, "doc_id", "text").select("doc_id", text.alias("text"), F.split(text, "[ \\t-\\r]", -1).alias("raw"),
                                              F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit("[^ \\t-\\r]"))).alias("l"))
    out = out.select(
        "doc_id", F.filter("raw", lambda w: w != "").alias("w"),
        (F.length("text") - F.size("raw") + 1).cast("long").alias("word_chars"),
        times("[#*$%&|<>]").alias("n_symbols"), times("[!?]").alias("n_marks"), times("[A-Z]").alias("n_caps"),
        F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"))
    n = F.size("w")
    # 34 bits of a cheap mix of three word hashes above 30 bits of position: sorted, windows that may be equal are
    # neighbours. The few that are get their full hashes compared below, so the cheap mix decides nothing.
    out = out.withColumn("hw", F.transform("w", lambda x: F.xxhash64(x)))
    packed = F.transform("hw", lambda x, i: F.shiftleft(x.bitwiseXOR(F.shiftleft(F.get("hw", i + 1), 11))
                                                        .bitwiseXOR(F.shiftright(F.get("hw", i + 2), 7)), 30).bitwiseOR(i))
    out = out.withColumn("s", F.sort_array(F.filter(packed, lambda x: x.isNotNull())))
    near = lambda x, y: F.shiftright(x, 30) == F.shiftright(y, 30)
    maybe = F.filter("s", lambda x, i: near(x, F.get("s", i + 1)) | (near(x, F.get("s", i - 1))))
    out = out.withColumn("c", F.transform(maybe, lambda x: x.bitwiseAND(F.lit((1 << 30) - 1)).cast("int")))
    window = F.sort_array(F.transform("c", lambda i: F.struct(
        F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i"))))
    out = out.withColumn("s", F.when(F.size("c") > 0, window))
    h = lambda i: F.get(F.col("s"), i)["h"]
    same = F.filter(F.col("s"), lambda x, i: F.coalesce(h(i + 1) == x["h"], F.lit(False))
                    | F.coalesce(h(i - 1) == x["h"], F.lit(False)))
    covered = F.aggregate(
        F.sort_array(F.transform(same, lambda x: x["i"])), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    out = out.select("doc_id", n.cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                     F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_marks", "n_caps")
    mille = lambda a, b: F.when(F.col(b) > 0, F.expr(f"({a} * 1000) div {b}")).otherwise(F.lit(0)).cast("long")
    return out.select(
        "*", mille("n_symbols", "n_words").alias("symbols"), mille("n_dup_lines", "n_lines").alias("dup_lines"),
        mille("n_repeat_words", "n_words").alias("repeats"), mille("n_marks", "n_words").alias("marks"),
        mille("n_caps", "word_chars").alias("capitals"), stratum().alias("stratum"))


def stratum() -> Column:
    """One of four values, by number of words: a table by stratum has four rows at most."""
    out = F.lit(len(STRATA))
    for i, most in reversed(list(enumerate(STRATA))):
        out = F.when(F.col("n_words") < most, i).otherwise(out)
    return out


def within(k: Column, n: Column, alpha: float, level: float) -> Column:
    """Whether P(Binomial(n, alpha) <= k) <= level, summed in logarithms. k/n over alpha never holds."""
    odds = alpha / (1 - alpha)
    first = n * F.log(F.lit(1 - alpha))

    def step(a: Column, i: Column) -> Column:
        term = a["t"] + F.log((n - i + 1) * odds / i)
        high, low = F.greatest(a["s"], term), F.least(a["s"], term)
        return F.struct(term.alias("t"), (high + F.log1p(F.exp(low - high))).alias("s"))

    start = F.struct(first.alias("t"), first.alias("s"))
    total = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), start,
                                      step, lambda a: a["s"])).otherwise(first)
    return F.when(k > n * alpha, F.lit(False)).otherwise(total <= F.log(F.lit(level)))


def thresholds(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per stratum (at most four rows): the cutoff of each metric, null where none is safe."""
    level = delta / ((len(STRATA) + 1) * len(METRICS))
    good = (only(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
            .groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id"))
    hold = (measured.where("n_words >= 50 and doc_id is not null").groupBy("doc_id", "stratum")
            .agg(*[F.max(m).alias(m) for m in METRICS]).join(good, "doc_id"))
    step = CUTOFFS[0] - CUTOFFS[1]
    # A value lies over every cutoff below it: counts by bin, then running sums over at most len(CUTOFFS) bins.
    value = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
    bins = (hold.select("stratum", value)
            .groupBy("stratum", "metric", F.least(F.expr(f"(value + {step - 1}) div {step}"), F.lit(len(CUTOFFS) + 1)).alias("bin"))
            .agg(F.count("*").alias("c")).groupBy("stratum", "metric")
            .agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("by")))
    # bin b: values in (step * (b - 1), step * b]; over the cutoff step * j are the bins beyond j
    tests = F.transform(F.sequence(F.lit(1), F.lit(len(CUTOFFS))), lambda j: F.struct(
        (j * step).alias("cutoff"), F.aggregate(F.sequence(j + 1, F.lit(len(CUTOFFS) + 1)), F.lit(0).cast("long"),
                                                lambda a, b: a + F.coalesce(F.get(F.map_values(F.map_filter(F.col("by"), lambda x, _: x == b)), F.lit(0)), F.lit(0))).alias("k")))
    held = (bins.select("stratum", "metric", "n", F.inline(tests))
            .select("stratum", "metric", "cutoff", within(F.col("k"), F.col("n"), alpha, level).alias("ok")))
    # fixed sequence: strictest cutoff above the most lenient one that failed
    best = held.groupBy("stratum", "metric").agg(
        F.coalesce(F.max(F.when(~F.col("ok"), F.col("cutoff"))), F.lit(0)).alias("failed"),
        F.collect_set(F.when(F.col("ok"), F.col("cutoff"))).alias("oks"))
    cut = best.select("stratum", "metric", F.array_min(F.filter("oks", lambda c: c > F.col("failed"))).alias("cut"))
    return cut.groupBy("stratum").pivot("metric", list(METRICS)).agg(F.first("cut"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts, base verdict and final verdict of every document."""
    measured = staged(counts(docs), "rules")
    cuts = thresholds(measured, labels, alpha, delta).select("stratum", *[F.col(m).alias(f"cut_{m}") for m in METRICS])
    # broadcast: `stratum` has four values by construction
    out = measured.join(F.broadcast(cuts), "stratum", "left")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    good = F.lit(True)
    for m in METRICS:
        good = good & F.coalesce(F.col(m) <= F.col(f"cut_{m}"), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & good).alias("kept"))


def op10(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
