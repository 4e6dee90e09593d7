"""Sentence synthesis: valid and deliberately broken sentences, one row per input id.

Each generator is a column expression over draw columns of one ``md5(seed:rule:label:id)`` key -- no Python per row,
no shuffle. Spark and SQL produce identical sentences, and a retried task (lost executor) regenerates the same rows.

Distributions follow the reference generators: counts uniform over the stated ranges, tokens uniform, invalid
violation types round-robin by id. Rejection sampling (not-palindrome) is replaced by a bump of the last token,
which always yields a non-palindrome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.functions.draws import LETTERS, Draws, pick, spelt
from seqlab.functions.fence import fence
from seqlab.operators import rules as R

# --- fixed values: split seeds and default sizes ----------------------------------------------------------------
SPLIT_SEEDS = {"train": 42, "val": 123, "test": 456}
N_TRAIN, N_VAL, N_TEST = 10000, 1000, 1000
G3_MAX_HALF = 8
# -------------------------------------------------------------------------------------------------------------

# Pair strings indexed by a 4-bit draw: colour = d % 2, shape given colour = (d // 2) % 2.
PAIRS = [f"{R.COLORS[d % 2]} {(R.RED_SHAPES if d % 2 == 0 else R.BLUE_SHAPES)[(d // 2) % 2]}" for d in range(4)]


def sentence_key(seed, rule, id_col: Column, label: str = "valid") -> Column:
    """md5 key of a sentence; ``rule`` and ``seed`` may be Python values or columns (per-row dispatch)."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(str(v))
    return F.md5(F.concat_ws(":", lit(seed), lit(rule), F.lit(label), id_col.cast("string")))


def _pair(d: Draws, pos: int) -> Column:
    return pick(PAIRS, d.n(pos) % 4)


def _run(open_t: str | None, mid: str, k: Column, close: str | None, open_twice=False, close_twice=False) -> Column:
    parts = []
    if open_t:
        parts.append(F.lit(open_t + (" " + open_t if open_twice else "")))
    parts.append(F.trim(F.repeat(F.lit(" " + mid), k)))
    if close:
        parts.append(F.lit(close + (" " + close if close_twice else "")))
    return F.concat_ws(" ", *parts)


def _g3(letters: Column) -> Column:
    """Content letters spelt as tokens."""
    return spelt(letters, R.G3_CONTENT)


def valid_sentence(rule: str, d: Draws) -> Column:
    a = d.a
    if rule == "grammar1":
        return _run(R.G1_OPEN, R.G1_MID, F.lit(1) + a % 10, R.G1_CLOSE)
    if rule == "tivari":
        return _run(R.TV_OPEN, R.TV_MID, F.lit(1) + a % 10, R.TV_CLOSE)
    if rule == "tivari_b":
        return _run(R.TV_OPEN, R.TV_MID, F.lit(1) + a % 4, R.TV_CLOSE)
    if rule == "grammar2":
        n = F.lit(1) + a % 4
        return F.concat_ws(" ", _pair(d, 9), *[F.when(n >= i, _pair(d, 8 + i)) for i in range(2, 5)])
    if rule == "grammar3":
        h = (a % (G3_MAX_HALF + 1)).cast("int")
        half = d.letters(9, h)
        centre = F.when((d.n(17) < 8) & (h > 0), F.concat(F.lit(" "), pick(R.G3_CENTRES, d.n(18) % 2))).otherwise("")
        return _g3(F.concat(F.lit(R.G3_OPEN), half, centre, F.reverse(half), F.lit(" " + R.G3_CLOSE)))
    raise KeyError(rule)


def violation_index(rule: str, id_col: Column) -> Column:
    return F.pmod(id_col, F.lit(len(R.INVALID_TYPES[rule])))


def violation_type(rule: str, id_col: Column) -> Column:
    return pick(R.INVALID_TYPES[rule], violation_index(rule, id_col))


def invalid_sentence(rule: str, d: Draws, id_col: Column) -> Column:
    """A sentence breaking ``rule`` the way named by ``violation_type(rule, id)``."""
    a = d.a
    vi = violation_index(rule, id_col)
    if rule in ("grammar1", "tivari", "tivari_b"):
        o, mid, c = (R.G1_OPEN, R.G1_MID, R.G1_CLOSE) if rule == "grammar1" else (R.TV_OPEN, R.TV_MID, R.TV_CLOSE)
        k = F.lit(1) + a % (5 if rule != "tivari_b" else 4)
        text = (F.when(vi == 0, F.lit(f"{o} {c}"))
                .when(vi == 1, _run(None, mid, k, c))
                .when(vi == 2, _run(o, mid, k, None))
                .when(vi == 3, F.lit(f"{c} {mid} {o}"))
                .when(vi == 4, _run(o, mid, k, c, open_twice=True))
                .when(vi == 5, _run(o, mid, k, c, close_twice=True)))
        if rule == "tivari_b":
            text = text.when(vi == 6, _run(o, mid, F.lit(5) + a % 6, c))
        return text
    if rule == "grammar2":
        d9 = d.n(9)
        n_inc = F.lit(1) + a % 2
        n_many = F.lit(5) + a % 3
        rev_pairs = [" ".join(reversed(p.split())) for p in PAIRS]
        dbl_colour = [f"{p.split()[0]} {p}" for p in PAIRS]
        dbl_shape = [f"{p} {p.split()[1]}" for p in PAIRS]
        return (F.when(vi == 0, F.concat(F.lit("RED "), pick(R.BLUE_SHAPES, d9 % 2)))
                .when(vi == 1, F.concat(F.lit("BLUE "), pick(R.RED_SHAPES, d9 % 2)))
                .when(vi == 2, F.concat_ws(" ", _pair(d, 10), F.when(n_inc >= 2, _pair(d, 11)),
                                           pick(R.COLORS, d.n(12) % 2)))
                .when(vi == 3, pick(rev_pairs, d9 % 4))
                .when(vi == 4, pick(dbl_colour, d9 % 4))
                .when(vi == 5, pick(dbl_shape, d9 % 4))
                .when(vi == 6, F.concat_ws(" ", *[_pair(d, 10 + i) for i in range(5)],
                                           *[F.when(n_many >= 6 + i, _pair(d, 15 + i)) for i in range(2)])))
    if rule == "grammar3":
        n = (F.lit(2) + a % 3).cast("int")
        word = d.letters(9, n)
        # a palindrome ends as it begins: its last token is bumped
        bumped = F.lit(LETTERS).substr(((d.n(9) + 1 + d.n(13) % 3) % 4 + 1).cast("int"), F.lit(1))
        not_pal = F.when(word == F.reverse(word), F.concat(d.letters(9, n - 1), bumped)).otherwise(word)
        half = d.letters(17, (F.lit(1) + a % 2).cast("int"))
        rev = F.reverse(half)
        t0 = d.letters(20, 1)
        o, c = F.lit(R.G3_OPEN), F.lit(" " + R.G3_CLOSE)
        return F.ltrim(_g3(F.when(vi == 0, F.concat(o, not_pal, c))
                           .when(vi == 1, F.concat(o, half, F.lit(" WEJ"), rev, c))
                           .when(vi == 2, F.concat(o, half, F.lit(" TAS"), rev, c))
                           .when(vi == 3, F.concat(o, half, rev))
                           .when(vi == 4, F.concat(half, rev, c))
                           .when(vi == 5, F.concat(o, t0, F.lit(" " + R.G3_BAD_TOKEN), t0, c))))
    raise KeyError(rule)


def wrap(rule: str, c: Column) -> Column:
    """``<tag> text </tag>`` for rule sets with corpus tags; unchanged otherwise."""
    tag = R.REGISTRY[rule].tag
    if not tag:
        return c
    return F.concat_ws(" ", F.lit(tag[0]), c, F.lit(tag[1]))


def with_draws(df: DataFrame, key: Column, prefix: str = "_d") -> tuple[DataFrame, Draws]:
    """Project the draw columns of ``key`` once; returns the frame and the handle generators use."""
    d = Draws(prefix)
    keyed = df.select("*", key.alias(f"{prefix}m"))
    return keyed.select("*", *d.columns(F.col(f"{prefix}m"))).drop(f"{prefix}m"), d


def synth_valid(ids: DataFrame, rule: str, seed: int | str = 42, id_col: str = "id", keep: tuple = ()) -> DataFrame:
    """One valid sentence per input row: (id, keep, text)."""
    base = ids.select(F.col(id_col).alias("id"), *keep)
    keyed, d = with_draws(base, sentence_key(seed, rule, F.col("id")))
    return keyed.select("id", *keep, valid_sentence(rule, d).alias("text"))


def synth_invalid(ids: DataFrame, rule: str, seed: int | str = 42, id_col: str = "id", keep: tuple = ()) -> DataFrame:
    """One broken sentence per input row: (id, keep, violation, text)."""
    base = ids.select(F.col(id_col).alias("id"), *keep)
    keyed, d = with_draws(base, sentence_key(seed, rule, F.col("id"), "invalid"))
    idc = F.col("id")
    return keyed.select("id", *keep, violation_type(rule, idc).alias("violation"),
                        invalid_sentence(rule, d, idc).alias("text"))


def by_rule_col(rule_col: Column, fn, rules: list[str] | None = None) -> Column:
    out = None
    for r in rules or R.RULES:
        v = fn(r)
        out = F.when(rule_col == r, v) if out is None else out.when(rule_col == r, v)
    return out


def split_combos(splits: list[str] | None = None, labels: list[str] | None = None) -> list[tuple[str, str, int, str]]:
    combos = []
    for r in R.RULES:
        for split, seed in SPLIT_SEEDS.items():
            combos.append((r, split, seed, "valid"))
            if split != "train":
                combos.append((r, split, seed, "invalid"))
    return [c for c in combos if (splits is None or c[1] in splits) and (labels is None or c[3] in labels)]


def synth_splits(ids: DataFrame, id_col: str = "id", splits: list[str] | None = None,
                 labels: list[str] | None = None) -> DataFrame:
    """Every rule set x split x id: valid sentences for all splits, invalid ones for val and test; `splits` and
    `labels` choose among them before anything is made.

    Each of the ten (rule, label) pairs is a branch of a union with the expressions of its own sentences alone: HotSpot
    leaves methods of over 8000 bytes to its interpreter, and one expression for all rules is several times that. A branch
    explodes its splits per id (a generator, not a join), so the id side is never shuffled; the seed is part of the md5 key.
    """
    branches: dict[tuple[str, str], list[tuple[str, int]]] = {}
    for rule, split, seed, label in split_combos(splits, labels):
        branches.setdefault((rule, label), []).append((split, seed))
    out = None
    for (rule, label), its in branches.items():
        arr = F.array(*[F.struct(F.lit(split).alias("split"), F.lit(str(seed)).alias("seed")) for split, seed in its])
        base = ids.select(F.col(id_col).alias("id"), F.explode(arr).alias("c")).select("id", "c.*")
        keyed, d = with_draws(base, sentence_key(F.col("seed"), rule, F.col("id"), label))
        violation, text = F.lit(None).cast("string"), valid_sentence
        if label == "invalid":
            violation, text = violation_type(rule, F.col("id")), lambda r, d: invalid_sentence(r, d, F.col("id"))
        made = keyed.select(F.lit(rule).alias("rule"), "split", F.lit(label).alias("label"), "id", violation.alias("violation"),
                            text(rule, d).alias("text"))
        made = fence(made, ["rule", "split", "label", "id", "violation"], ["text"])
        out = made if out is None else out.unionByName(made)
    return out
