"""Rule sets ("grammars") as a registry of column builders.

A ``RuleSpec`` bundles, for one rule set, the strict predicate, the optional lenient (valid-prefix) predicate, the
generation-time extractor and the violation classifier -- each a function ``Column -> Column`` built from native
expressions. Regular rules are checked with one anchored regex over the single-space-joined tokens (stays inside
whole-stage codegen); the palindrome rule adds string reversal over a one-letter-per-token code.

Plugging in a new rule set means ``register``-ing a ``RuleSpec``; `declared` builds one from tokens and limits.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.functions import text as T
from seqlab.functions.fence import fence
from seqlab.functions.memo import session_cached

# --- fixed values: rule vocabularies, tags, prompts, violation names (must equal the reference) -------------
RULES = ["grammar1", "grammar2", "grammar3", "tivari", "tivari_b"]

G1_OPEN, G1_MID, G1_CLOSE = "START", "MID", "END"
COLORS = ["RED", "BLUE"]
RED_SHAPES = ["CIRCLE", "SQUARE"]
BLUE_SHAPES = ["TRIANGLE", "DIAMOND"]
G3_OPEN, G3_CLOSE = "FEP", "GOR"
G3_CONTENT = ["NUL", "TAS", "WEJ", "KOB"]
G3_EVEN_ONLY = ["TAS", "WEJ"]
G3_CENTRES = ["NUL", "KOB"]
G3_BAD_TOKEN = "BLAX"
TV_OPEN, TV_MID, TV_CLOSE = "XAQ", "ZIV", "BEK"

TAGS = {
    "grammar3": ("<tivari3>", "</tivari3>"),
    "tivari": ("<tivari>", "</tivari>"),
}
# Prompt tags used at generation time (tivari_b is prompted with the tivari tags though its corpus is unwrapped).
EXTRACT_TAGS = {
    "grammar3": ("<tivari3>", "</tivari3>"),
    "tivari": ("<tivari>", "</tivari>"),
    "tivari_b": ("<tivari>", "</tivari>"),
}

PROMPTS = {
    "grammar1": ["START", "START MID", "START MID MID"],
    "grammar2": ["RED", "BLUE", "RED CIRCLE", "BLUE TRIANGLE"],
    "grammar3": ["<tivari3>", "<tivari3> FEP"],
    "tivari": ["<tivari>", "<tivari> XAQ", "<tivari> XAQ ZIV", "<tivari> XAQ ZIV ZIV"],
    "tivari_b": ["<tivari>", "<tivari> XAQ", "<tivari> XAQ ZIV", "<tivari> XAQ ZIV ZIV"],
}

INVALID_TYPES = {
    "grammar1": ["no_mid", "no_start", "no_end", "wrong_order", "extra_start", "extra_end"],
    "grammar2": ["red_with_blue_shape", "blue_with_red_shape", "incomplete_pair", "shape_first",
                 "double_color", "double_shape", "too_many_pairs"],
    "grammar3": ["not_palindrome", "odd_wej", "odd_tas", "unmatched_open", "unmatched_close", "invalid_token"],
    "tivari": ["no_ziv", "no_xaq", "no_bek", "wrong_order", "extra_xaq", "extra_bek"],
    "tivari_b": ["no_ziv", "no_xaq", "no_bek", "wrong_order", "extra_xaq", "extra_bek", "too_many_zivs"],
}
# Rule sets with a lenient (valid-prefix) check; the others publish 0 lenient-valid, not null.
LENIENT_RULES = ["grammar3", "tivari"]
# -------------------------------------------------------------------------------------------------------------


def _run_regex(open_t: str, mid: str, close: str, max_mid: int | None = None) -> str:
    rep = "++" if max_mid is None else "{1,%d}+" % max_mid  # possessive: no stack a repetition
    return "^%s( %s)%s %s$" % (open_t, mid, rep, close)


def _pair_alt() -> str:
    return "(%s)" % "|".join(
        ["RED (%s)" % "|".join(RED_SHAPES), "BLUE (%s)" % "|".join(BLUE_SHAPES)])


G2_REGEX = "^%s( %s){0,3}$" % (_pair_alt(), _pair_alt())
G3_SHAPE = "^%s(?: (?:%s))*+ %s$" % (G3_OPEN, "|".join(G3_CONTENT), G3_CLOSE)


def _g3_code(n: Column) -> Column:
    """One letter per token (first letter; the rule's tokens have distinct initials), brackets removed."""
    letters = F.regexp_replace(n, "([A-Z])[A-Z]* ?", "$1")
    return letters.substr(F.lit(2), F.length(letters) - F.lit(2))


def _count_char(s: Column, ch: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))


def _g3_ok_code(code: Column) -> Column:
    even = None
    for tok in G3_EVEN_ONLY:
        e = (_count_char(code, tok[0]) % 2) == 0
        even = e if even is None else (even & e)
    return (code == F.reverse(code)) & even


G3_PREFIX = "^(%s(?: (?:%s))*+ %s)(?: |$)" % (G3_OPEN, "|".join(G3_CONTENT), G3_CLOSE)


class Bind:
    """Named intermediate expressions of one rule set over a normalised text ``n``.

    Standalone, ``get`` inlines the expression; inside ``with_verdicts`` each one is projected once as a column
    (so a CASE branch references it instead of repeating a regex several times).
    """

    def __init__(self, n: Column, defs: dict, prefix: str | None = None):
        self.n, self.defs, self.prefix = n, defs, prefix

    def get(self, name: str) -> Column:
        if self.prefix is not None:
            return F.col(f"{self.prefix}{name}")
        return self.defs[name](self)


G3_DEFS = {
    "code": lambda b: _g3_code(b.n),
    "pref": lambda b: F.regexp_extract(b.n, G3_PREFIX, 1),
    "pcode": lambda b: _g3_code(b.get("pref")),
}


def g3_strict_b(b: Bind) -> Column:
    return F.when(b.n.rlike(G3_SHAPE), _g3_ok_code(b.get("code"))).otherwise(F.lit(False))


def g3_lenient_b(b: Bind) -> Column:
    """Valid FEP ... GOR prefix: content tokens cannot be GOR, so only the first GOR can close a valid prefix."""
    return F.when(b.get("pref") != "", _g3_ok_code(b.get("pcode"))).otherwise(F.lit(False))


def g3_strict_norm(n: Column) -> Column:
    return g3_strict_b(Bind(n, G3_DEFS))


def g3_lenient_norm(n: Column) -> Column:
    return g3_lenient_b(Bind(n, G3_DEFS))


def tivari_lenient_norm(n: Column) -> Column:
    return n.rlike("^%s( %s)++ %s( |$)" % (TV_OPEN, TV_MID, TV_CLOSE))


# ---- violation classes (checked in the rule's own order) ----------------------------------------------------

def _run_violation(n: Column, open_t: str, mid: str, close: str, max_mid: int | None) -> Column:
    k = T.n_tokens_norm(n)
    mids_ok = n.rlike("^%s( %s)++ %s$" % (open_t, mid, close))
    c = (F.when(k < 3, "too_short")
         .when(T.first_token(n) != open_t, "bad_open")
         .when(T.last_token(n) != close, "bad_close")
         .when(~mids_ok, "bad_middle"))
    if max_mid is not None:
        c = c.when(k - 2 > max_mid, "too_long")
    return c.otherwise("valid")


def _g2_violation(n: Column) -> Column:
    k = T.n_tokens_norm(n)
    good = "(?:RED (?:%s)|BLUE (?:%s))" % ("|".join(RED_SHAPES), "|".join(BLUE_SHAPES))
    rest = F.regexp_replace(n, "^(?:%s(?: |$))*+" % good, "")
    return (F.when(k == 0, "empty")
            .when(k % 2 != 0, "odd_length")
            .when((rest != "") & ~T.first_token(rest).isin(*COLORS), "bad_color")
            .when(rest != "", "bad_shape")
            .when(k / 2 > 4, "too_many_pairs")
            .otherwise("valid"))


def _g3_violation(n: Column) -> Column:
    k = T.n_tokens_norm(n)
    inner_ok = n.rlike(G3_SHAPE)
    code = _g3_code(n)
    odd = None
    for tok in G3_EVEN_ONLY:
        o = (_count_char(code, tok[0]) % 2) != 0
        odd = o if odd is None else (odd | o)
    return (F.when(k < 2, "too_short")
            .when((T.first_token(n) != G3_OPEN) | (T.last_token(n) != G3_CLOSE), "bad_brackets")
            .when(~inner_ok, "bad_token")
            .when(code != F.reverse(code), "not_palindrome")
            .when(odd, "odd_count")
            .otherwise("valid"))


@dataclass(frozen=True)
class RuleSpec:
    name: str
    strict_norm: Callable[[Column], Column]            # normalised text -> boolean
    extract: Callable[[Column], Column]                # raw generated text -> extracted string
    violation_norm: Callable[[Column], Column]         # normalised text -> class name
    lenient_norm: Callable[[Column], Column] | None = None
    punct_normalise: bool = False
    tag: tuple[str, str] | None = None                 # corpus wrapper tags
    extract_tag: tuple[str, str] | None = None         # tags that the generated text is cut at; else extract_pre
    prompts: list[str] = field(default_factory=list)
    rule_tokens: list[str] = field(default_factory=list)
    # (normalised text, stripped text) -> extracted string, for rule sets extracted without tags
    extract_pre: Callable[[Column, Column], Column] | None = None
    # named intermediates shared by strict and lenient, and their Bind-based forms
    defs: dict = field(default_factory=dict)
    strict_b: Callable[[Bind], Column] | None = None
    lenient_b: Callable[[Bind], Column] | None = None

    def strict(self, c) -> Column:
        return self.strict_norm(T.ws_norm(c))

    def lenient(self, c) -> Column:
        """Null when the rule set has no lenient check (callers publish that as 0)."""
        if self.lenient_norm is None:
            return F.lit(None).cast("boolean")
        n = T.ws_norm(c)
        if self.punct_normalise:
            n = T.strip_punct_tokens(n)
        return self.lenient_norm(n)

    def violation(self, c) -> Column:
        return self.violation_norm(T.ws_norm(c))


def _tagged_extract(rule: str) -> Callable[[Column], Column]:
    o, c = EXTRACT_TAGS[rule]
    return lambda col: T.extract_tagged(col, o, c)


REGISTRY: dict[str, RuleSpec] = {}
_changes = 0


def register(spec: RuleSpec) -> None:
    """Add a rule set (or replace the one of that name): from now on all dispatch on rule names knows it."""
    global _changes
    if spec.extract_tag is None and spec.extract_pre is None:
        raise ValueError(f"{spec.name}: a rule set needs extract_tag or extract_pre")
    REGISTRY[spec.name] = spec
    _changes += 1


def unregister(name: str) -> None:
    global _changes
    del REGISTRY[name]
    _changes += 1


register(RuleSpec(
    "grammar1", strict_norm=lambda n: n.rlike(_run_regex(G1_OPEN, G1_MID, G1_CLOSE)),
    extract=lambda c: T.extract_to_token(c, G1_CLOSE),
    extract_pre=lambda n, st: T.to_token_pre(n, st, G1_CLOSE),
    violation_norm=lambda n: _run_violation(n, G1_OPEN, G1_MID, G1_CLOSE, None),
    prompts=PROMPTS["grammar1"], rule_tokens=[G1_OPEN, G1_MID, G1_CLOSE]))
register(RuleSpec(
    "grammar2", strict_norm=lambda n: n.rlike(G2_REGEX),
    extract=lambda c: T.extract_leading_pairs(c, COLORS, RED_SHAPES + BLUE_SHAPES),
    extract_pre=lambda n, st: T.leading_pairs_pre(n, st, COLORS, RED_SHAPES + BLUE_SHAPES),
    violation_norm=_g2_violation, prompts=PROMPTS["grammar2"], rule_tokens=COLORS + RED_SHAPES + BLUE_SHAPES))
register(RuleSpec(
    "grammar3", strict_norm=g3_strict_norm, extract=_tagged_extract("grammar3"), extract_tag=EXTRACT_TAGS["grammar3"], violation_norm=_g3_violation,
    lenient_norm=g3_lenient_norm, tag=TAGS["grammar3"], prompts=PROMPTS["grammar3"],
    defs=G3_DEFS, strict_b=g3_strict_b, lenient_b=g3_lenient_b,
    rule_tokens=[G3_OPEN, G3_CLOSE] + G3_CONTENT))
register(RuleSpec(
    "tivari", strict_norm=lambda n: n.rlike(_run_regex(TV_OPEN, TV_MID, TV_CLOSE)),
    extract=_tagged_extract("tivari"), extract_tag=EXTRACT_TAGS["tivari"],
    violation_norm=lambda n: _run_violation(n, TV_OPEN, TV_MID, TV_CLOSE, None),
    lenient_norm=tivari_lenient_norm, punct_normalise=True, tag=TAGS["tivari"], prompts=PROMPTS["tivari"],
    rule_tokens=[TV_OPEN, TV_MID, TV_CLOSE]))
register(RuleSpec(
    "tivari_b", strict_norm=lambda n: n.rlike(_run_regex(TV_OPEN, TV_MID, TV_CLOSE, 4)),
    extract=_tagged_extract("tivari_b"), extract_tag=EXTRACT_TAGS["tivari_b"],
    violation_norm=lambda n: _run_violation(n, TV_OPEN, TV_MID, TV_CLOSE, 4),
    prompts=PROMPTS["tivari_b"], rule_tokens=[TV_OPEN, TV_MID, TV_CLOSE]))


def by_rule(rule_col: Column, fn: Callable[[RuleSpec], Column], rules: list[str] | None = None) -> Column:
    """Dispatch on a rule-name column: ``CASE rule WHEN 'grammar1' THEN fn(spec1) ...``.

    This is the broadcast-free form of joining a rule dimension: the rule table is a handful of constants, so
    the choice is folded into the projection and stays in codegen.
    """
    expr = None
    for name in rules or list(REGISTRY):
        branch = fn(REGISTRY[name])
        expr = F.when(rule_col == name, branch) if expr is None else expr.when(rule_col == name, branch)
    return expr


def _tag_col(rule_col: Column, side: int) -> Column:
    tagged = [r for r, s in REGISTRY.items() if s.extract_tag]
    return by_rule(rule_col, lambda s: F.lit(s.extract_tag[side]), tagged) if tagged else F.lit(None).cast("string")


def open_tag_col(rule_col: Column) -> Column:
    """Per-row generation-time open tag (null for untagged rule sets)."""
    return _tag_col(rule_col, 0)


def close_tag_col(rule_col: Column) -> Column:
    return _tag_col(rule_col, 1)


@session_cached
def _verdict_exprs(text_col: str, rule_col: str, changes: int):
    """``changes`` of the registry make the expressions anew."""
    r = F.col(rule_col)
    e = {}
    e["s"] = T.strip_ws(F.col(text_col))
    e["o"] = open_tag_col(r)
    e["c"] = close_tag_col(r)
    e["gn"] = T.ws_norm(F.col("_s"))
    e["pos"] = F.expr("instr(_s, _o)")
    e["rest"] = F.expr("substr(_s, _pos + length(_o))")
    cut = F.expr("CASE WHEN instr(_rest, _c) > 0 THEN substring_index(_rest, _c, 1) "
                 "WHEN instr(_rest, '</') > 0 THEN substring_index(_rest, '</', 1) ELSE _rest END")
    tagged = F.when(F.col("_pos") > 0, T.strip_ws(cut)).otherwise(T.first_line_stripped(F.col("_s")))
    untagged = by_rule(r, lambda s: s.extract_pre(F.col("_gn"), F.col("_s")), [n for n, s in REGISTRY.items() if not s.extract_tag])
    e["extracted"] = F.when(F.col("_o").isNotNull(), tagged).otherwise(untagged)
    e["n"] = T.ws_norm(F.col("extracted"))
    e["pn"] = F.when(r.isin(*[n for n, s in REGISTRY.items() if s.punct_normalise]), T.strip_punct_tokens(F.col("_n")))
    # Each rule set's named intermediates, projected once in definition order.
    defs = []
    binds = {}
    for name, spec in REGISTRY.items():
        pre = f"_{name}_"
        binds[name] = Bind(F.col("_n"), spec.defs, pre)
        for key, fn in spec.defs.items():
            defs.append((pre + key, F.when(r == name, fn(binds[name]))))
    e["defs"] = defs

    def strict_of(spec):
        return spec.strict_b(binds[spec.name]) if spec.strict_b else spec.strict_norm(F.col("_n"))

    def lenient_of(spec):
        if spec.lenient_norm is None:
            return F.lit(None).cast("boolean")
        if spec.lenient_b:
            return spec.lenient_b(binds[spec.name])
        return spec.lenient_norm(F.col("_pn") if spec.punct_normalise else F.col("_n"))

    e["strict"] = by_rule(r, strict_of)
    e["lenient"] = by_rule(r, lenient_of)
    return e


def with_verdicts(df: DataFrame, text_col: str = "generated", rule_col: str = "rule") -> DataFrame:
    """Extract the rule string from generated text and attach strict and lenient verdicts.

    Adds ``extracted string``, ``is_valid boolean`` and ``is_lenient_valid boolean`` (null where the rule set
    has no lenient check). Stripping, normalising and tag positions are projected once per row and shared by
    every rule branch; tagged rule sets share one extraction expression driven by per-row tag columns.
    """
    e = _verdict_exprs(text_col, rule_col, _changes)
    cols = df.columns
    x = df.select("*", e["s"].alias("_s"), e["o"].alias("_o"), e["c"].alias("_c"))
    x = x.select("*", e["gn"].alias("_gn"), e["pos"].alias("_pos"))
    x = x.select("*", e["rest"].alias("_rest"))
    x = x.select(*cols, e["extracted"].alias("extracted"))
    x = x.select("*", e["n"].alias("_n"))
    x = x.select("*", e["pn"].alias("_pn"))
    for name, expr in e["defs"]:
        x = x.select("*", expr.alias(name))
    # Verdicts leave through an optimizer fence, so a later filter on them never inlines the alias chain.
    x = x.select(*cols, "extracted", e["strict"].alias("is_valid"), e["lenient"].alias("is_lenient_valid"))
    return fence(x, cols, ["extracted", "is_valid", "is_lenient_valid"])
