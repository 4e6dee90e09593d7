"""Rule sets from a declaration: tokens, limits and tags are compiled to predicate, lenient predicate, extractor and violation
classes (a `rules.RuleSpec`), and to the automaton that judges ordered rows by the same rule (`row_rules`).

Three kinds: a run (an opening token, middle tokens, a closing token), pairs (a first token and a second that goes with it)
and a mirror (inner tokens that read the same both ways, some of them an even number of times). Tokens may hold any
characters but white space; they are quoted wherever a pattern is built.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqlab.functions import text as T
from seqlab.operators import row_rules as RR
from seqlab.operators.rules import RuleSpec


def _any(tokens: list[str]) -> str:
    return "(?:" + "|".join(re.escape(t) for t in tokens) + ")"


def _only(tokens: Column, wanted: str) -> Column:
    return F.filter(tokens, lambda t: t == F.lit(wanted))


@dataclass(frozen=True)
class Declared:
    """``kind`` run: opens, middle, closes, most (middle tokens; no limit if None). pairs: pairs, most (pairs). mirror: opens,
    middle (the inner tokens), closes, even. ``lenient``: a valid beginning counts too (runs and mirrors). ``tag``: the tags
    that texts of the rule stand between. ``punct``: the lenient check drops punctuation around tokens."""
    name: str
    kind: str
    opens: str = ""
    middle: tuple[str, ...] = ()
    closes: str = ""
    pairs: dict[str, list[str]] = field(default_factory=dict)
    most: int | None = None
    even: tuple[str, ...] = ()
    tag: tuple[str, str] | None = None
    lenient: bool = False
    punct: bool = False
    prompts: tuple[str, ...] = ()

    def __post_init__(self):
        bad = [t for t in self.tokens() if not t or re.search(r"\s", t)]
        if bad or self.kind not in ("run", "pairs", "mirror") or (self.kind == "pairs" and self.lenient):
            raise ValueError(f"{self.name}: {self.kind} {bad}")

    def tokens(self) -> list[str]:
        if self.kind == "pairs":
            return list(dict.fromkeys([*self.pairs, *[t for s in self.pairs.values() for t in s]]))
        return list(dict.fromkeys([self.opens, *self.middle, self.closes]))

    # ---- strings ------------------------------------------------------------------------------------------------

    def _pair(self) -> str:
        return "(?:" + "|".join(f"{re.escape(a)} {_any(b)}" for a, b in self.pairs.items()) + ")"

    def _shape(self, limited: bool = True) -> str:
        if self.kind == "pairs":
            more = "*+" if self.most is None or not limited else "{0,%d}+" % (self.most - 1)
            return f"{self._pair()}(?: {self._pair()}){more}"
        least = "*+" if self.kind == "mirror" else "++" if self.most is None or not limited else "{1,%d}+" % self.most
        return f"{re.escape(self.opens)}(?: {_any(list(self.middle))}){least} {re.escape(self.closes)}"

    def _mirror_ok(self, n: Column) -> tuple[Column, Column]:
        """Whether the inner tokens read the same both ways, and whether all that must be even are."""
        t = F.split(n, " ")
        inner = F.slice(t, F.lit(2), F.greatest(F.size(t) - 2, F.lit(0)))
        even = F.lit(True)
        for tok in self.even:
            even = even & (F.size(_only(inner, tok)) % 2 == 0)
        return inner == F.reverse(inner), even

    def strict(self, n: Column) -> Column:
        ok = n.rlike(f"^{self._shape()}$")
        if self.kind != "mirror":
            return ok
        same, even = self._mirror_ok(n)
        return F.when(ok, same & even).otherwise(F.lit(False))

    def lenient_ok(self, n: Column) -> Column:
        beginning = F.regexp_extract(n, f"^({self._shape()})(?: |$)", 1)
        if self.kind != "mirror":
            return beginning != ""
        same, even = self._mirror_ok(beginning)
        return F.when(beginning != "", same & even).otherwise(F.lit(False))

    def violation(self, n: Column) -> Column:
        """The first rule that is broken, from the outside in."""
        k = T.n_tokens_norm(n)
        if self.kind == "pairs":
            rest = F.regexp_replace(n, f"^(?:{self._pair()}(?: |$))*+", "")
            c = (F.when(k == 0, "empty").when(k % 2 != 0, "odd_length")
                 .when((rest != "") & ~T.first_token(rest).isin(*self.pairs), "bad_first").when(rest != "", "bad_second"))
            return (c if self.most is None else c.when(k / 2 > self.most, "too_many_pairs")).otherwise("valid")
        c = (F.when(k < (2 if self.kind == "mirror" else 3), "too_short").when(T.first_token(n) != self.opens, "bad_open")
             .when(T.last_token(n) != self.closes, "bad_close").when(~n.rlike(f"^{self._shape(False)}$"), "bad_middle"))
        if self.kind == "mirror":
            same, even = self._mirror_ok(n)
            c = c.when(~same, "not_mirrored").when(~even, "odd_count")
        elif self.most is not None:
            c = c.when(k - 2 > self.most, "too_long")
        return c.otherwise("valid")

    def spec(self) -> RuleSpec:
        """The rule set, ready for `rules.register`."""
        if self.tag:
            extract, pre = lambda c: T.extract_tagged(c, *self.tag), None
        elif self.kind == "pairs":
            seconds = [re.escape(t) for t in dict.fromkeys(t for s in self.pairs.values() for t in s)]
            firsts = [re.escape(t) for t in self.pairs]
            pre = lambda n, st: T.leading_pairs_pre(n, st, firsts, seconds)
            extract = lambda c: pre(T.ws_norm(c), T.strip_ws(c))
        else:
            pre = lambda n, st: T.to_token_pre(n, st, re.escape(self.closes))
            extract = lambda c: pre(T.ws_norm(c), T.strip_ws(c))
        return RuleSpec(self.name, strict_norm=self.strict, extract=extract, violation_norm=self.violation,
                        lenient_norm=self.lenient_ok if self.lenient else None, punct_normalise=self.punct, tag=self.tag,
                        extract_tag=self.tag, extract_pre=pre, prompts=list(self.prompts), rule_tokens=[re.escape(t) for t in self.tokens()])

    # ---- rows ---------------------------------------------------------------------------------------------------

    def rows(self, prefix: bool = False) -> RR.RowRule:
        """The rule over ordered rows; ``prefix``: its lenient form."""
        if self.kind == "pairs":
            return RR.pair_rule(self.name, {a: list(b) for a, b in self.pairs.items()}, self.most)
        if self.kind == "mirror":
            return RR.mirror_rule(self.name, self.opens, list(self.middle), self.closes, list(self.even), prefix)
        return RR.run_rule(self.name, self.opens, list(self.middle), self.closes, self.most, prefix)
