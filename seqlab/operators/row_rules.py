"""Rules over ordered rows: is the sequence of tokens of each key a sentence of a rule?

A rule is a finite automaton over tokens, optionally with two conditions that no automaton can hold: some tokens occur an even
number of times, and the inner tokens read the same forwards and backwards. One operator, `judge`, takes any table with
key, order and token columns.

Parts of a sequence are folded on their own and merged in order, so a key with a third of all rows is no hot group. What is
known of a part composes: for every state the automaton may be in before it, the state after it and the row at which all
hope was lost; whether a closing token came; the parities of some tokens; and polynomial sums of the inner tokens, forward
and backward, modulo two primes. Rows are numbered within their key (`scan.numbered_within`), blocks of BLOCK rows are
folded, then BLOCK blocks at a time until a key is one row: no list is longer than BLOCK. Sequences whose two sums agree
are compared token by token, row i with row n - 1 - i, so the sums decide nothing but who is compared.

Everything is built from native expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.operators import scan
from seqlab.session import materialize

BLOCK = 256
#: Two primes under 2**31, so that products fit a long, and a base for each.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 362436069)


@dataclass(frozen=True)
class RowRule:
    """A rule as an automaton. ``moves[state]`` maps tokens to the next state; what has no move is hopeless.

    ``even``: tokens that occur an even number of times. ``mirrored``: inner tokens that read the same both ways. With
    ``closes`` what follows the first such token is ignored (valid-prefix check)."""
    name: str
    moves: tuple[dict[str, int], ...]
    accept: frozenset[int]
    even: tuple[str, ...] = ()
    mirrored: tuple[str, ...] = ()
    closes: str | None = None
    tokens: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self):
        seen = dict.fromkeys(t for m in self.moves for t in m)
        object.__setattr__(self, "tokens", tuple(seen))


def run_rule(name: str, opens: str, middle: list[str], closes: str, most: int | None = None, prefix: bool = False) -> RowRule:
    """One opening token, one or more (at most ``most``) of the middle, one closing token. ``prefix``: anything may follow."""
    if most is None:
        moves = [{opens: 1}, dict.fromkeys(middle, 2), {**dict.fromkeys(middle, 2), closes: 3}, {}]
    else:
        moves = [{opens: 1}, dict.fromkeys(middle, 2)]
        moves += [{**(dict.fromkeys(middle, k + 1) if k <= most else {}), closes: most + 2} for k in range(2, most + 2)] + [{}]
    return RowRule(name, tuple(moves), frozenset([len(moves) - 1]), closes=closes if prefix else None)


def pair_rule(name: str, pairs: dict[str, list[str]], most: int | None = None) -> RowRule:
    """One or more (at most ``most``) pairs of a first token and a second that goes with it."""
    firsts = list(pairs)
    if most is None:  # states: 0 start, 1 after a pair, then after each first token
        open_ = {f: 2 + i for i, f in enumerate(firsts)}
        moves = [open_, dict(open_)] + [dict.fromkeys(pairs[f], 1) for f in firsts]
        return RowRule(name, tuple(moves), frozenset([1]))
    moves, width = [], len(firsts) + 1
    for k in range(most + 1):  # after k pairs
        moves.append({f: k * width + 1 + i for i, f in enumerate(firsts)} if k < most else {})
        moves += [dict.fromkeys(pairs[f], (k + 1) * width) for f in firsts] if k < most else []
    return RowRule(name, tuple(moves), frozenset(range(width, most * width + 1, width)))


def mirror_rule(name: str, opens: str, inner: list[str], closes: str, even: list[str], prefix: bool = False) -> RowRule:
    """An opening token, inner tokens that read the same both ways with an even number of some, a closing token."""
    moves = ({opens: 1}, {**dict.fromkeys(inner, 1), closes: 2}, {})
    return RowRule(name, moves, frozenset([2]), tuple(even), tuple(inner), closes if prefix else None)


# ---- the fold, as SQL -------------------------------------------------------------------------------------------


def _table(rule: RowRule) -> str:
    """moves[state][token number]: the next state; the last state is hopeless, the last token is any other one."""
    dead = len(rule.moves)
    rows = []
    for s, m in enumerate(rule.moves):
        done = rule.closes is not None and s in rule.accept  # what follows is ignored
        rows.append([s if done else m.get(t, dead) for t in rule.tokens] + [s if done else dead])
    rows.append([dead] * (len(rule.tokens) + 1))
    return "array(" + ", ".join("array(" + ", ".join(map(str, r)) + ")" for r in rows) + ")"


def _fields(rule: RowRule) -> list[str]:
    return (["closed"] if rule.closes else []) + (["odd"] if rule.even else []) + (
        [f"{k}{i}" for i in range(2) for k in "fbw"] if rule.mirrored else [])


def _one(rule: RowRule) -> str:
    """A part of one row e: token number `e.tok` at `e.pos`."""
    dead, far = len(rule.moves), "cast(null as bigint)"
    out = [f"'ways', transform(sequence(0, {dead}), q -> named_struct('to', _moves[q][e.tok], "
           f"'lost', if(q < {dead} and _moves[q][e.tok] = {dead}, e.pos, {far})))"]
    if rule.closes:
        out.append(f"'closed', e.tok = {rule.tokens.index(rule.closes)}")
    if rule.even:
        bits = " ".join(f"when {rule.tokens.index(t)} then {1 << i}" for i, t in enumerate(rule.even))
        out.append(f"'odd', case e.tok {bits} else 0 end")
    if rule.mirrored:
        inner = ", ".join(str(rule.tokens.index(t)) for t in rule.mirrored)
        for i in range(2):
            out += [f"'{k}{i}', if(e.tok in ({inner}), {v}, cast({z} as bigint))"
                    for k, v, z in (("f", "e.tok + 1L", 0), ("b", "e.tok + 1L", 0), ("w", f"{BASES[i]}L", 1))]
    return "named_struct(" + ", ".join(out) + ")"


def _merge(rule: RowRule) -> str:
    """Part y after part x."""
    out = ["'ways', transform(x.ways, v -> named_struct('to', y.ways[v.to].to, 'lost', coalesce(v.lost, y.ways[v.to].lost)))"]
    held = (lambda k, v: f"if(x.closed, x.{k}, {v})") if rule.closes else (lambda k, v: v)
    if rule.closes:
        out.append("'closed', x.closed or y.closed")
    if rule.even:
        out.append("'odd', " + held("odd", "x.odd ^ y.odd"))
    for i, p in enumerate(PRIMES) if rule.mirrored else ():
        out += [f"'f{i}', " + held(f"f{i}", f"(x.f{i} * y.w{i} + y.f{i}) % {p}L"),
                f"'b{i}', " + held(f"b{i}", f"(y.b{i} * x.w{i} + x.b{i}) % {p}L"),
                f"'w{i}', " + held(f"w{i}", f"(x.w{i} * y.w{i}) % {p}L")]
    return "named_struct(" + ", ".join(out) + ")"


def _folded(parts: DataFrame, keys: list[str], rule: RowRule, rows: bool) -> DataFrame:
    """(keys, blk, part): BLOCK consecutive parts (``rows``: tokens) are merged in order."""
    item, one = (F.struct("blk", "tok"), _one(rule).replace("e.pos", "e.blk")) if rows else (F.struct("blk", "part"), "e.part")
    g = parts.groupBy(*keys, F.expr(f"blk div {BLOCK}").alias("_up")).agg(F.sort_array(F.collect_list(item)).alias("_l"))
    g = g.withColumn("_moves", F.expr(_table(rule))).select(*keys, F.col("_up").alias("blk"), F.expr(f"transform(_l, e -> {one})").alias("_l"))
    return g.select(*keys, "blk", F.expr(f"aggregate(slice(_l, 2, {BLOCK}), _l[0], (x, y) -> {_merge(rule)})").alias("part"))


def judge(rows: DataFrame, keys: list[str], order: list[str], token: str, rule: RowRule, parts: int | None = None) -> DataFrame:
    """(keys, n, lost, valid): rows of the key, the 0-based row from which no continuation could make the sequence valid for the
    automaton (null if none), and whether it is a sentence.

    Rows that tie in ``order`` are taken by token. A null token is one that the rule doesn't know; null keys are a key.
    An empty table gives no rows. Further columns are ignored.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    slim = rows.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], *[F.col(f"`{o}`").alias(f"_o{i}") for i, o in enumerate(order)],
                       F.col(f"`{token}`").alias("_t"))
    # a null key must meet itself in joins
    nulls = [F.col(n).isNull().alias(f"{n}n") for n in names]
    slim = slim.select("*", *nulls)
    flags = [f"{n}n" for n in names]
    keyed = slim.select(*[F.coalesce(n, _zero(slim, n)).alias(n) for n in names], *flags, *[c for c in slim.columns if c[:2] in ("_o", "_t")])
    every = names + flags
    placed = scan.numbered_within(keyed, every, [f"_o{i}" for i in range(len(order))] + ["_t"], parts=parts).select(*every, "pos", "n", "_t")
    number = F.lit(len(rule.tokens))
    for i, t in enumerate(rule.tokens):
        number = F.when(F.col("_t") == t, i).otherwise(number)
    numbered = placed.select(*every, "pos", "n", number.alias("tok"))
    top = numbered.groupBy(*every).agg(F.max("n").alias("n"))
    longest = top.agg(F.max("n")).first()[0] or 0
    folded = _folded(numbered.select(*every, F.col("pos").alias("blk"), "tok"), every, rule, True)
    while longest > BLOCK:
        longest = -(-longest // BLOCK)
        folded = _folded(folded, every, rule, False)
    got = folded.join(top, every).select(*every, "n", "part")
    ok = F.col("part.ways")[0]["to"].isin(*rule.accept)
    if rule.even:
        ok = ok & (F.col("part.odd") == 0)
    if rule.mirrored:
        ok = ok & (F.col("part.f0") == F.col("part.b0")) & (F.col("part.f1") == F.col("part.b1"))
    got = got.select(*every, "n", F.col("part.ways")[0]["lost"].alias("lost"), ok.alias("valid"))
    if rule.mirrored:
        got = materialize(got)
        got = got.join(_unlike(numbered, got, every, rule), every, "left").withColumn("valid", F.col("valid") & F.col("_bad").isNull())
    return got.select(*[F.when(~F.col(f"{n}n"), F.col(n)).alias(k) for k, n in zip(keys, names)], "n", "lost", "valid")


def _zero(df: DataFrame, name: str) -> Column:
    """Some value of the column's type, to stand for null beside its flag."""
    kind = dict(df.dtypes)[name]
    return F.lit("").cast(kind) if kind == "string" else F.lit(0).cast("timestamp").cast(kind) if kind in ("date", "timestamp", "timestamp_ntz") else F.lit(0).cast(kind)


def _unlike(numbered: DataFrame, got: DataFrame, every: list[str], rule: RowRule) -> DataFrame:
    """Keys among the valid ones whose inner tokens differ from their mirror image: (keys, _bad). Row i of the inner tokens meets
    row m - 1 - i by their key and the smaller of the two, so no key is gathered."""
    hits = got.where("valid").select(*every)
    rows = numbered.join(hits, every, "left_semi").select(*every, "pos", "n", "tok")
    last = F.col("n") - 1
    if rule.closes:
        ends = rows.where(F.col("tok") == rule.tokens.index(rule.closes)).groupBy(*every).agg(F.min("pos").alias("_last"))
        rows, last = rows.join(ends, every), F.col("_last")
    inner = rows.where((F.col("pos") > 0) & (F.col("pos") < last))
    met = inner.groupBy(*every, F.least(F.col("pos") - 1, last - 1 - F.col("pos")).alias("_pair")).agg(F.min("tok").alias("lo"), F.max("tok").alias("hi"))
    return met.where("lo != hi").select(*every).distinct().withColumn("_bad", F.lit(True))


# --- fixed values: the row rules of the registered queries -------------------------------------------------------
EVENT_RULES = {
    "run": run_rule("run", "signup", ["view", "click"], "purchase"),
    "pairs": pair_rule("pairs", {"view": ["click", "purchase"], "click": ["view", "error"]}, 4),
    "run_b": run_rule("run_b", "view", ["click"], "purchase"),
    "bounded": run_rule("bounded", "view", ["click", "error"], "purchase", 4),
    "palindrome": mirror_rule("palindrome", "signup", ["view", "click", "error"], "purchase", ["click", "error"]),
    "lenient_run": run_rule("lenient_run", "view", ["click"], "purchase", prefix=True),
    "lenient_palindrome": mirror_rule("lenient_palindrome", "signup", ["view", "click", "error"], "purchase", ["click", "error"], prefix=True),
}
TURN_RULES = {
    "run": run_rule("run", "user", ["assistant"], "user"),
    "pairs": pair_rule("pairs", {"user": ["assistant"]}, 4),
    "alternating": pair_rule("alternating", {"user": ["assistant"]}),
    "bounded": run_rule("bounded", "system", ["user"], "assistant", 4),
}
# -------------------------------------------------------------------------------------------------------------
