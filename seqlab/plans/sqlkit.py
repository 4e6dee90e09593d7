"""SQL fragments for the DuckDB oracle (independent re-statements, not generated from the Spark plans).

The oracle is written the way an analyst would write it in SQL -- list functions where natural, RE2 regexes
otherwise -- and shares only the fixed values (vocabularies, prompts, violation names) with the Spark side.
"""

from __future__ import annotations

from seqlab.functions.text import PUNCT_CLASS, WS_CLASS
from seqlab.operators import rules as R

WS = WS_CLASS + "+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def u32(m: str, start: int = 1) -> str:
    return f"('0x' || substr({m}, {start}, 8))::BIGINT"


def nib(m: str, pos: int) -> str:
    return f"('0x' || substr({m}, {pos}, 1))::INTEGER"


def pick(opts, idx: str) -> str:
    return f"{lst(opts)}[({idx}) + 1]"


def md5key(*parts: str) -> str:
    return "md5(concat_ws(':', " + ", ".join(parts) + "))"


def strip(s: str) -> str:
    return f"regexp_replace({s}, '^{WS}|{WS}\\z', '', 'g')"


def toks(s: str) -> str:
    return f"list_filter(regexp_split_to_array({s}, '{WS}'), lambda x: x <> '')"


def norm(s: str) -> str:
    return f"array_to_string({toks(s)}, ' ')"


def first_line(s: str) -> str:
    return strip(f"split_part({strip(s)}, chr(10), 1)")


def punct_strip_norm(n: str) -> str:
    """Tokens of a normalised string stripped of punctuation at both ends; empties dropped; re-joined."""
    return (f"array_to_string(list_filter(list_transform(string_split({n}, ' '), "
            f"lambda x: regexp_replace(x, {q('^' + PUNCT_CLASS + '+|' + PUNCT_CLASS + '+$')}, '', 'g')), lambda x: x <> ''), ' ')")


# ---- sentence generators (same draws as the Spark side) -----------------------------------------------------

_PAIRS = [f"{R.COLORS[d % 2]} {(R.RED_SHAPES if d % 2 == 0 else R.BLUE_SHAPES)[(d // 2) % 2]}" for d in range(4)]


def _run(o, mid, k, c, o2=False, c2=False) -> str:
    parts = []
    if o:
        parts.append(q(o + (" " + o if o2 else "")))
    parts.append(f"trim(repeat({q(' ' + mid)}, {k}))")
    if c:
        parts.append(q(c + (" " + c if c2 else "")))
    return "concat_ws(' ', " + ", ".join(parts) + ")"


def _pair(m, pos):
    return pick(_PAIRS, f"{nib(m, pos)} % 4")


def _half(m, h, first, n):
    t = [pick(R.G3_CONTENT, f"{nib(m, first + i)} % 4") for i in range(n)]
    fwd = "concat_ws(' ', " + ", ".join(f"CASE WHEN {h} >= {i + 1} THEN {t[i]} END" for i in range(n)) + ")"
    rev = "concat_ws(' ', " + ", ".join(f"CASE WHEN {h} >= {i + 1} THEN {t[i]} END"
                                        for i in reversed(range(n))) + ")"
    return f"nullif({fwd}, '')", f"nullif({rev}, '')"


def valid_sql(rule: str, m: str) -> str:
    a = u32(m)
    if rule == "grammar1":
        return _run("START", "MID", f"1 + {a} % 10", "END")
    if rule == "tivari":
        return _run("XAQ", "ZIV", f"1 + {a} % 10", "BEK")
    if rule == "tivari_b":
        return _run("XAQ", "ZIV", f"1 + {a} % 4", "BEK")
    if rule == "grammar2":
        n = f"(1 + {a} % 4)"
        rest = ", ".join(f"CASE WHEN {n} >= {i} THEN {_pair(m, 8 + i)} END" for i in range(2, 5))
        return f"concat_ws(' ', {_pair(m, 9)}, {rest})"
    if rule == "grammar3":
        h = f"({a} % 9)"
        fwd, rev = _half(m, h, 9, 8)
        centre = f"CASE WHEN {nib(m, 17)} < 8 AND {h} > 0 THEN {pick(R.G3_CENTRES, nib(m, 18) + ' % 2')} END"
        return f"concat_ws(' ', 'FEP', {fwd}, {centre}, {rev}, 'GOR')"
    raise KeyError(rule)


def invalid_sql(rule: str, m: str, idx: str) -> tuple[str, str]:
    types = R.INVALID_TYPES[rule]
    vi = f"({idx} % {len(types)})"
    vt = pick(types, vi)
    a = u32(m)
    if rule in ("grammar1", "tivari", "tivari_b"):
        o, mid, c = ("START", "MID", "END") if rule == "grammar1" else ("XAQ", "ZIV", "BEK")
        k = f"(1 + {a} % {5 if rule != 'tivari_b' else 4})"
        cases = [f"WHEN {vi} = 0 THEN {q(o + ' ' + c)}",
                 f"WHEN {vi} = 1 THEN {_run(None, mid, k, c)}",
                 f"WHEN {vi} = 2 THEN {_run(o, mid, k, None)}",
                 f"WHEN {vi} = 3 THEN {q(c + ' ' + mid + ' ' + o)}",
                 f"WHEN {vi} = 4 THEN {_run(o, mid, k, c, o2=True)}",
                 f"WHEN {vi} = 5 THEN {_run(o, mid, k, c, c2=True)}"]
        if rule == "tivari_b":
            cases.append(f"WHEN {vi} = 6 THEN {_run(o, mid, f'(5 + {a} % 6)', c)}")
        return vt, "CASE " + " ".join(cases) + " END"
    if rule == "grammar2":
        d = nib(m, 9)
        n_inc = f"(1 + {a} % 2)"
        n_many = f"(5 + {a} % 3)"
        rev_pairs = [" ".join(reversed(p.split())) for p in _PAIRS]
        dbl_c = [f"{p.split()[0]} {p}" for p in _PAIRS]
        dbl_s = [f"{p} {p.split()[1]}" for p in _PAIRS]
        many = ", ".join([_pair(m, 10 + i) for i in range(5)] +
                         [f"CASE WHEN {n_many} >= {6 + i} THEN {_pair(m, 15 + i)} END" for i in range(2)])
        cases = [f"WHEN {vi} = 0 THEN 'RED ' || {pick(R.BLUE_SHAPES, d + ' % 2')}",
                 f"WHEN {vi} = 1 THEN 'BLUE ' || {pick(R.RED_SHAPES, d + ' % 2')}",
                 f"WHEN {vi} = 2 THEN concat_ws(' ', {_pair(m, 10)}, CASE WHEN {n_inc} >= 2 THEN {_pair(m, 11)} END,"
                 f" {pick(R.COLORS, nib(m, 12) + ' % 2')})",
                 f"WHEN {vi} = 3 THEN {pick(rev_pairs, d + ' % 4')}",
                 f"WHEN {vi} = 4 THEN {pick(dbl_c, d + ' % 4')}",
                 f"WHEN {vi} = 5 THEN {pick(dbl_s, d + ' % 4')}",
                 f"WHEN {vi} = 6 THEN concat_ws(' ', {many})"]
        return vt, "CASE " + " ".join(cases) + " END"
    if rule == "grammar3":
        L = f"(2 + {a} % 3)"
        ix = [f"({nib(m, 9 + i)} % 4)" for i in range(4)]
        pal = (f"(CASE WHEN {L} = 2 THEN {ix[0]} = {ix[1]} WHEN {L} = 3 THEN {ix[0]} = {ix[2]} "
               f"ELSE {ix[0]} = {ix[3]} AND {ix[1]} = {ix[2]} END)")
        bump = f"({nib(m, 13)} % 3)"
        fx = [ix[0]] + [f"(CASE WHEN {pal} AND {L} = {p + 1} THEN ({ix[p]} + 1 + {bump}) % 4 ELSE {ix[p]} END)"
                        for p in range(1, 4)]
        tk = [pick(R.G3_CONTENT, x) for x in fx]
        not_pal = (f"concat_ws(' ', 'FEP', {tk[0]}, {tk[1]}, CASE WHEN {L} >= 3 THEN {tk[2]} END, "
                   f"CASE WHEN {L} >= 4 THEN {tk[3]} END, 'GOR')")
        h = f"(1 + {a} % 2)"
        fwd, rev = _half(m, h, 17, 2)
        t0 = pick(R.G3_CONTENT, f"{nib(m, 20)} % 4")
        cases = [f"WHEN {vi} = 0 THEN {not_pal}",
                 f"WHEN {vi} = 1 THEN concat_ws(' ', 'FEP', {fwd}, 'WEJ', {rev}, 'GOR')",
                 f"WHEN {vi} = 2 THEN concat_ws(' ', 'FEP', {fwd}, 'TAS', {rev}, 'GOR')",
                 f"WHEN {vi} = 3 THEN concat_ws(' ', 'FEP', {fwd}, {rev})",
                 f"WHEN {vi} = 4 THEN concat_ws(' ', {fwd}, {rev}, 'GOR')",
                 f"WHEN {vi} = 5 THEN concat_ws(' ', 'FEP', {t0}, 'BLAX', {t0}, 'GOR')"]
        return vt, "CASE " + " ".join(cases) + " END"
    raise KeyError(rule)


def by_rule(rule_col: str, fn, rules=None) -> str:
    return "CASE " + " ".join(f"WHEN {rule_col} = {q(r)} THEN {fn(r)}" for r in (rules or R.RULES)) + " END"


# ---- rule predicates, written over token lists -------------------------------------------------------------

def strict_sql(rule: str, t: str) -> str:
    """Strict predicate over a token list expression ``t``."""
    if rule in ("grammar1", "tivari", "tivari_b"):
        o, mid, c = ("START", "MID", "END") if rule == "grammar1" else ("XAQ", "ZIV", "BEK")
        cap = f" AND len({t}) - 2 <= 4" if rule == "tivari_b" else ""
        return (f"(len({t}) >= 3 AND {t}[1] = {q(o)} AND {t}[len({t})] = {q(c)} AND "
                f"len(list_filter(list_slice({t}, 2, len({t}) - 1), lambda x: x <> {q(mid)})) = 0{cap})")
    if rule == "grammar2":
        ok = (f"len(list_filter(range(1, len({t}) + 1, 2), lambda i: NOT coalesce("
              f"({t}[i] = 'RED' AND {t}[i + 1] IN ('CIRCLE', 'SQUARE')) OR "
              f"({t}[i] = 'BLUE' AND {t}[i + 1] IN ('TRIANGLE', 'DIAMOND')), false))) = 0")
        return f"(len({t}) > 0 AND len({t}) % 2 = 0 AND len({t}) <= 8 AND {ok})"
    if rule == "grammar3":
        c = f"list_slice({t}, 2, len({t}) - 1)"
        return (f"(len({t}) >= 2 AND {t}[1] = 'FEP' AND {t}[len({t})] = 'GOR' AND "
                f"len(list_filter({c}, lambda x: x NOT IN ('NUL', 'TAS', 'WEJ', 'KOB'))) = 0 AND "
                f"{c} = list_reverse({c}) AND "
                f"len(list_filter({c}, lambda x: x = 'TAS')) % 2 = 0 AND len(list_filter({c}, lambda x: x = 'WEJ')) % 2 = 0)")
    raise KeyError(rule)


def lenient_sql(rule: str, t: str) -> str:
    if rule == "tivari":
        # prefix XAQ ZIV+ BEK, next token free
        p = f"coalesce(list_position({t}, 'BEK'), 0)"
        return (f"(len({t}) >= 3 AND {t}[1] = 'XAQ' AND {p} > 2 AND "
                f"len(list_filter(list_slice({t}, 2, {p} - 1), lambda x: x <> 'ZIV')) = 0)")
    if rule == "grammar3":
        p = f"list_slice({t}, 1, list_position({t}, 'GOR'))"
        return f"(len({t}) >= 1 AND {t}[1] = 'FEP' AND coalesce(list_position({t}, 'GOR'), 0) > 1 AND " \
               f"{strict_sql('grammar3', p)})"
    return "NULL::BOOLEAN"


def extract_sql(rule: str, s: str) -> str:
    st = strip(s)
    if rule == "grammar1":
        t = toks(s)
        return (f"CASE WHEN coalesce(list_position({t}, 'END'), 0) > 0 "
                f"THEN array_to_string(list_slice({t}, 1, list_position({t}, 'END')), ' ') ELSE {st} END")
    if rule == "grammar2":
        run = (f"rtrim(regexp_extract({norm(s)}, '^((?:(?:RED|BLUE) (?:CIRCLE|SQUARE|TRIANGLE|DIAMOND)(?: |$))+)',"
               f" 1), ' ')")
        return f"CASE WHEN {run} <> '' THEN {run} ELSE {st} END"
    o, c = R.EXTRACT_TAGS[rule]
    rest = f"substr({st}, strpos({st}, {q(o)}) + {len(o)})"
    cut = (f"CASE WHEN strpos({rest}, {q(c)}) > 0 THEN split_part({rest}, {q(c)}, 1) "
           f"WHEN strpos({rest}, '</') > 0 THEN split_part({rest}, '</', 1) ELSE {rest} END")
    return f"CASE WHEN strpos({st}, {q(o)}) > 0 THEN {strip(cut)} ELSE {first_line(st)} END"


def violation_sql(rule: str, t: str) -> str:
    if rule in ("grammar1", "tivari", "tivari_b"):
        o, mid, c = ("START", "MID", "END") if rule == "grammar1" else ("XAQ", "ZIV", "BEK")
        extra = f" WHEN len({t}) - 2 > 4 THEN 'too_long'" if rule == "tivari_b" else ""
        return (f"CASE WHEN len({t}) < 3 THEN 'too_short' WHEN {t}[1] <> {q(o)} THEN 'bad_open' "
                f"WHEN {t}[len({t})] <> {q(c)} THEN 'bad_close' "
                f"WHEN len(list_filter(list_slice({t}, 2, len({t}) - 1), lambda x: x <> {q(mid)})) > 0 "
                f"THEN 'bad_middle'{extra} ELSE 'valid' END")
    if rule == "grammar2":
        bad = (f"list_filter(range(1, len({t}) + 1, 2), lambda i: NOT coalesce("
               f"({t}[i] = 'RED' AND {t}[i + 1] IN ('CIRCLE', 'SQUARE')) OR "
               f"({t}[i] = 'BLUE' AND {t}[i + 1] IN ('TRIANGLE', 'DIAMOND')), false))")
        return (f"CASE WHEN len({t}) = 0 THEN 'empty' WHEN len({t}) % 2 <> 0 THEN 'odd_length' "
                f"WHEN len({bad}) > 0 AND {t}[{bad}[1]] NOT IN ('RED', 'BLUE') THEN 'bad_color' "
                f"WHEN len({bad}) > 0 THEN 'bad_shape' WHEN len({t}) / 2 > 4 THEN 'too_many_pairs' "
                f"ELSE 'valid' END")
    if rule == "grammar3":
        c = f"list_slice({t}, 2, len({t}) - 1)"
        return (f"CASE WHEN len({t}) < 2 THEN 'too_short' "
                f"WHEN {t}[1] <> 'FEP' OR {t}[len({t})] <> 'GOR' THEN 'bad_brackets' "
                f"WHEN len(list_filter({c}, lambda x: x NOT IN ('NUL', 'TAS', 'WEJ', 'KOB'))) > 0 THEN 'bad_token' "
                f"WHEN {c} <> list_reverse({c}) THEN 'not_palindrome' "
                f"WHEN len(list_filter({c}, lambda x: x = 'TAS')) % 2 <> 0 OR "
                f"len(list_filter({c}, lambda x: x = 'WEJ')) % 2 <> 0 THEN 'odd_count' ELSE 'valid' END")
    raise KeyError(rule)


def fused_sql(t: str, rule_tokens) -> str:
    ors = " OR ".join(f"contains(x, {q(tok)})" for tok in rule_tokens)
    return f"len(list_filter({t}, lambda x: x NOT IN ({', '.join(q(x) for x in rule_tokens)}) AND ({ors})))"


def tag_extract(s: str, o: str, c: str, fallback: bool = True) -> str:
    """After the first ``o``; cut at the first ``c``, else (optionally) at the first '</', else rest; stripped.
    NULL when ``o`` does not occur."""
    rest = f"substr({s}, strpos({s}, {q(o)}) + {len(o)})"
    fb = f"WHEN strpos({rest}, '</') > 0 THEN split_part({rest}, '</', 1) " if fallback else ""
    cut = f"CASE WHEN strpos({rest}, {q(c)}) > 0 THEN split_part({rest}, {q(c)}, 1) {fb}ELSE {rest} END"
    return f"CASE WHEN strpos({s}, {q(o)}) > 0 THEN {strip(cut)} END"
