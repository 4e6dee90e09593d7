"""A language model of order n with backoff, estimated once on whole texts: one count table, next-token probabilities,
losses and completion accuracy of held-out texts.

`estimate` counts every token once, after its longest context, and reads the counts of each shorter context off the next longer
one's: (keys, k, ctx, next, n) with ctx the k - 1 tokens before, and the totals of each context with a link to its next shorter one.
The probability of order k mixes in the shorter context by the number of different tokens seen after the longer one (Witten and
Bell); a context that was never seen leaves all to the shorter one:

    p_k = (n + types * p_(k-1)) / (total + types),    p_1 = (n + alpha) / (total + alpha * (types + 1))

Scoring works on distinct (contexts, next) rows. Sequences are looked up by equi-joins whose keys are distinct on the
count side. Many sequences share a context, so the totals of contexts are joined with a salt: there are up to SALTS copies of those
that are asked for, and a sequence takes the copy that its next token hashes to. Only hashes of few sequences are broadcast by hint.
Tables that are read more than once are written, and shuffle files of finished steps are let go.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.functions import text as T
from seqlab.session import released, written

ORDER, ALPHA, SALTS = 3, 0.1, 8
FEW = 2**19  # sequences asked for, whose hashes may be broadcast


@dataclass(frozen=True)
class Model:
    """counts: (keys, k, ctx, next, n). totals: (keys, k, ctx, shorter, total, types)."""
    keys: list[str]
    order: int
    counts: DataFrame
    totals: DataFrame


def contexts(order: int) -> list[str]:
    return [f"c{k}" for k in range(2, order + 1)]


def _before(j: int):
    return F.get("_t", F.col("pos") - j)


def _words(texts: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """(columns, _t, pos, next) of every token, with all the tokens of its text. What is read off the array by place is
    compiled, and it is read before anything is shuffled."""
    t = texts.select(*columns, T.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    return t.select(*columns, "_t", F.posexplode("_t").alias("pos", "next"))


def sequences(texts: DataFrame, columns: list[str], order: int = ORDER, text_col: str = "text") -> DataFrame:
    """(columns, pos, next, c2 .. c_order): every token of every text with the 1 .. order - 1 tokens before it, joined by spaces;
    null where the text has not so many. Null and blank texts have no tokens."""
    before = [F.when(F.col("pos") >= k - 1, F.concat_ws(" ", *[_before(j) for j in range(k - 1, 0, -1)])).alias(f"c{k}") for k in range(2, order + 1)]
    return _words(texts, columns, text_col).select(*columns, "pos", "next", *before)


def _counted(rows: DataFrame, keys: list[str], n, k, name: str) -> DataFrame:
    """(keys, k, ctx, next, n) of rows (keys, _g): n-grams as one string, which is all that is shuffled of them."""
    g = F.col("_g")
    c = rows.groupBy("_g", *keys).agg(n.alias("n")).withColumn("k", k).withColumn("next", F.substring_index(g, " ", -1))
    ctx = F.when(F.col("k") > 1, F.substring(g, F.lit(1), F.length(g) - F.length("next") - 1)).otherwise("")
    c = written(c.select(*keys, "k", ctx.alias("ctx"), "next", "n"), name)
    released(rows.sparkSession)
    return c


def estimate(texts: DataFrame, keys: list[str], order: int = ORDER, text_col: str = "text") -> Model:
    """The model of each key (null keys are a key of their own)."""
    longest = F.concat_ws(" ", *[_before(j) for j in range(order - 1, 0, -1)], "next")  # before the first token is nothing
    words = F.length("_g") - F.length(F.replace("_g", F.lit(" "), F.lit(""))) + 1
    rows = _words(texts, keys, text_col).select(*keys, longest.alias("_g"))
    top = _counted(rows, keys, F.count(F.lit(1)), words, "order-n-top")
    counts = level = top.where(F.col("k") == order).withColumn("k", F.lit(order))
    for k in range(order - 1, 0, -1):  # a sequence ends a longer one or begins a text
        end = F.concat_ws(" ", F.substring_index("ctx", " ", 1 - k), "next") if k > 1 else F.col("next")
        both = level.select(*keys, end.alias("_g"), "n").unionByName(top.where(F.col("k") == k).select(*keys, end.alias("_g"), "n"))
        level = _counted(both, keys, F.sum("n"), F.lit(k), f"order-n-{k}").withColumn("k", F.lit(k))
        counts = counts.unionByName(level)
    totals = counts.groupBy(*keys, "k", "ctx").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
    words = F.split("ctx", " ")
    shorter = F.when(F.col("k") > 1, F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " "))
    return Model(keys, order, counts, totals.select(*keys, "k", "ctx", shorter.alias("shorter"), "total", "types"))


def _met(keys: list[str], left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on keys (null meets null) and ``on``; the right side's keys go. Rows are sorted by the first column of a join, so the one of
    fewest equal values, the last, is put there."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys + on else F.col(c) for c in right.columns])
    cond = None
    for c in reversed(keys + on):
        x = left[c].eqNullSafe(r[f"_r_{c}"]) if c in keys else left[c] == r[f"_r_{c}"]
        cond = x if cond is None else cond & x
    out = left.join(r, cond, how)
    return out if how == "left_semi" else out.drop(*[f"_r_{c}" for c in keys + on])


def _sieved(table: DataFrame, asked: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The rows of ``table`` whose columns hash as those of a row of ``asked`` (``columns``: theirs by name). A join still has to compare
    them; what is broadcast is one number a row asked for."""
    some = asked.select(F.xxhash64(*columns.values()).alias("_h")).distinct()
    return table.withColumn("_h", F.xxhash64(*columns)).join(F.broadcast(some), "_h", "left_semi").drop("_h")


def probabilities(model: Model, asked: DataFrame) -> DataFrame:
    """``asked`` (keys, c2 .. c_order, next, ...) with `p`. Rows of a key without a model go. ``asked`` is read several times.

    Up to FEW rows go through the counts as a sieve before any is shuffled. For more rows the counts of one order are shuffled at a
    time: what has been joined is written and its shuffles are let go."""
    keys, wanted, few = model.keys, asked, asked.count() <= FEW
    same, key = {c: c for c in keys}, F.struct(*keys).alias("_key")  # equal structs may hold nulls, and are dealt alike by groups and joins
    sieved = _sieved if few else lambda table, *_: table
    done = (lambda df: df) if few else _done
    one = model.totals.where("k = 1").select(*keys, F.col("total").alias("_total"), F.col("types").alias("_types"))
    known = sieved(model.counts.where("k = 1"), wanted, same | {"next": "next"}).select(*keys, "next", F.col("n").alias("_n"))
    out = _met(keys, _met(keys, asked, one, [], "inner"), known, ["next"], "left")
    p = (F.coalesce(F.col("_n"), F.lit(0)) + F.lit(ALPHA)) / (F.col("_total") + F.lit(ALPHA) * (F.col("_types") + 1))
    out = out.withColumn("p", p).drop("_n", "_total", "_types").withColumn("_salt", F.pmod(F.hash("next"), F.lit(SALTS)))
    for k in range(2, model.order + 1):
        c = f"c{k}"
        counts = model.counts.where(F.col("k") == k)
        # a context and its next token are shuffled as one string
        known = sieved(counts, wanted, same | {"ctx": c, "next": "next"}).select(*keys, F.concat_ws(" ", "ctx", "next").alias("_g"), F.col("n").alias("_n"))
        out = done(_met(keys, out.withColumn("_g", F.concat(c, F.lit(" "), "next")), known, ["_g"], "left").drop("_g"))
        totals = sieved(counts, wanted, same | {"ctx": c}).select(key, F.col("ctx").alias(c), "n")
        totals = totals.groupBy(c, "_key").agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_types"))
        copies = out.select(key, c, "_salt").where(F.col(c).isNotNull()).distinct()
        out = out.withColumn("_key", key).join(totals.join(copies, [c, "_key"]), [c, "_salt", "_key"], "left").select(*out.columns, "_total", "_types")
        mixed = (F.coalesce(F.col("_n"), F.lit(0)) + F.col("_types") * F.col("p")) / (F.col("_total") + F.col("_types"))
        out = out.withColumn("p", F.when(F.col("_total").isNotNull(), mixed).otherwise(F.col("p"))).drop("_n", "_total", "_types")
        out = done(out) if k < model.order else out
    return out.drop("_salt")


def _done(df: DataFrame) -> DataFrame:
    df = written(df, "order-n-mixed")
    released(df.sparkSession)
    return df


def next_token_probs(model: Model, tests: DataFrame) -> DataFrame:
    """``tests`` (keys, prefix, token, ...) with `prob`, the probability of the token after the whole prefix. Of a prefix longer
    than the model's contexts the last tokens count."""
    t = tests.withColumn("_p", T.tokens(F.coalesce(F.col("prefix"), F.lit(""))))
    for k in range(2, model.order + 1):
        t = t.withColumn(f"c{k}", F.expr(f"if(size(_p) >= {k - 1}, array_join(slice(_p, -{k - 1}, {k - 1}), ' '), null)"))
    t = written(t.drop("_p").withColumnRenamed("token", "next"), "order-n-tests")
    return probabilities(model, t).drop(*contexts(model.order)).withColumnRenamed("next", "token").withColumnRenamed("p", "prob")


def _scored(model: Model, texts: DataFrame, text_keys: list[str], text_col: str) -> DataFrame:
    """(keys, text_keys, next, contexts, times): what is scored of each text, equal sequences of a text once."""
    rows = sequences(texts, model.keys + text_keys, model.order, text_col).where("pos > 0")
    rows = rows.groupBy("next", *contexts(model.order), *text_keys, *model.keys).agg(F.count(F.lit(1)).alias("times"))
    rows = written(rows, "order-n-scored")
    released(rows.sparkSession)
    return rows


def _with(model: Model, rows: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the probability `p` of their sequences, and that of all distinct sequences in ``asked``."""
    cols = model.keys + contexts(model.order) + ["next"]
    asked = written(asked.select(*cols).distinct(), "order-n-asked")
    released(rows.sparkSession)
    p = _done(probabilities(model, asked))
    return _met(cols, rows, p, [], "inner"), p


def text_losses(model: Model, texts: DataFrame, text_keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, text_keys, loss_sum, n_tokens, ppl) of every text with a token to score: all but the first, each after the
    tokens before it."""
    rows = _scored(model, texts, text_keys, text_col)
    rows, _ = _with(model, rows, rows)
    g = rows.groupBy(*model.keys, *text_keys).agg(F.sum(F.col("times") * -F.log("p")).alias("loss_sum"), F.sum("times").alias("n_tokens"))
    return g.withColumn("ppl", F.exp(F.col("loss_sum") / F.col("n_tokens")))


def completion(model: Model, texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(keys, rival, n_correct, n_total, accuracy): how often the token that follows is likelier than the key's most frequent
    token (ties: the greater one in byte order), over all places where they differ."""
    keys = model.keys
    rival = model.counts.where("k = 1").groupBy(*keys).agg(F.max(F.struct("n", "next")).alias("_m")).select(*keys, F.col("_m.next").alias("rival"))
    rows = _met(keys, _scored(model, texts, [], text_col), written(rival, "order-n-rival"), [], "inner").where("next != rival")
    cols = keys + contexts(model.order)
    theirs = rows.select(*cols, F.col("rival").alias("next"))
    rows, p = _with(model, rows, rows.select(*cols, "next").unionByName(theirs))  # both are looked up at once
    rows = _met(cols + ["rival"], rows, p.select(*cols, F.col("next").alias("rival"), F.col("p").alias("_q")), [], "inner")
    g = rows.groupBy(*keys, "rival").agg(F.sum(F.when(F.col("p") > F.col("_q"), F.col("times")).otherwise(0)).alias("n_correct"), F.sum("times").alias("n_total"))
    return g.select(*keys, "rival", "n_correct", "n_total", F.round(F.col("n_correct") / F.col("n_total"), 6).alias("accuracy"))


def sizes(model: Model) -> DataFrame:
    """(keys, k, n_tokens, n_sequences, n_contexts, n_once): what the count table holds of each order."""
    c = model.counts.groupBy(*model.keys, "k").agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_sequences"), F.count_if(F.col("n") == 1).alias("n_once"))
    t = model.totals.groupBy(*model.keys, "k").agg(F.count(F.lit(1)).alias("n_contexts"))
    return _met(model.keys, c, t, ["k"], "inner").select(*model.keys, "k", "n_tokens", "n_sequences", "n_contexts", "n_once")
