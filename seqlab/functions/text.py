"""Whitespace, tokenisation, normalisation and extraction as built-in Spark column expressions.

Everything here returns a ``Column`` built from JVM-side functions (regexp, substring_index, instr, concat_ws), so
it stays inside whole-stage codegen; no Python runs per row.

Tokens follow Python's ``str.split()``: runs of Unicode whitespace separate tokens and empty tokens are dropped.
Java's ``\\s`` is ASCII-only and Spark's ``trim`` removes only U+0020, so the separator class is spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------------------
# The characters Python's str.split() treats as whitespace (U+0009-000D, U+001C-0020, U+0085, U+00A0, U+1680,
# U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000). U+200B is not whitespace.
WS_CLASS = (r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
            r"\x{205f}\x{3000}]")
# Python's string.punctuation, as a regex character class: !"#$%&'()*+,-./:;<=>?@[\]^_`{|}~
PUNCT_CLASS = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
# -------------------------------------------------------------------------------------------------------------

WS_RUN = WS_CLASS + "+"
# The same whitespace set as a plain string, for trim/translate (no regex per row).
WS_CHARS = "".join(chr(c) for c in list(range(0x09, 0x0E)) + list(range(0x1C, 0x21)) + [0x85, 0xA0, 0x1680]
                   + list(range(0x2000, 0x200B)) + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``s.strip()``: remove Unicode whitespace at both ends (``TRIM`` with a character set)."""
    return F.trim(_col(c), F.lit(WS_CHARS))


def ws_norm(c) -> Column:
    """``' '.join(s.split())``: map every whitespace character to a space, collapse runs, drop the ends.

    ``translate`` is a per-character table lookup; the collapsing regex only runs on rows holding a double space.
    """
    t = F.translate(_col(c), WS_CHARS, " " * len(WS_CHARS))
    return F.trim(F.when(F.instr(t, "  ") > 0, F.regexp_replace(t, " {2,}", " ")).otherwise(t))


def tokens(c) -> Column:
    """``s.split()`` as ``array<string>``; the empty string gives an empty array (not ``['']``)."""
    # split of "" is [""]; drop empty tokens instead of branching (the normalised text is referenced once)
    return F.array_remove(F.split(ws_norm(c), " "), "")


def n_tokens_norm(n: Column) -> Column:
    """Token count of an already normalised string, without materialising the array."""
    return F.when(n == "", F.lit(0)).otherwise(F.length(n) - F.length(F.regexp_replace(n, " ", "")) + 1)


def first_token(n: Column) -> Column:
    return F.substring_index(n, " ", 1)


def last_token(n: Column) -> Column:
    return F.substring_index(n, " ", -1)


def strip_punct_tokens(n: Column) -> Column:
    """Normalised text -> each token stripped of ASCII punctuation at both ends, empty tokens dropped.

    Works on the single-space-joined form: cut punctuation after a token start and before a token end, then
    re-collapse the spaces left by tokens that were punctuation only.
    """
    lead = F.regexp_replace(n, "(^| )" + PUNCT_CLASS + "+", "$1")
    trail = F.regexp_replace(lead, PUNCT_CLASS + "+( |$)", "$1")
    return F.trim(F.regexp_replace(trail, " +", " "))


def first_line_stripped(stripped: Column) -> Column:
    """First line of an already stripped text, stripped."""
    return strip_ws(F.substring_index(stripped, "\n", 1))


def first_line(c) -> Column:
    """``s.strip().split('\\n')[0].strip()``."""
    return first_line_stripped(strip_ws(c))


def after_first(c: Column, marker: str) -> Column:
    """Text after the first occurrence of ``marker`` (caller guarantees it occurs)."""
    return F.substr(c, F.instr(c, marker) + F.lit(len(marker)))


def between_tags(c, open_tag: str, close_tag: str, close_fallback: bool = True) -> Column:
    """Text after the first ``open_tag``; cut at the first full ``close_tag``, else (optionally) at the first
    ``</``, else the rest; stripped. Null when ``open_tag`` does not occur."""
    t = _col(c)
    rest = after_first(t, open_tag)
    cut = F.when(F.instr(rest, close_tag) > 0, F.substring_index(rest, close_tag, 1))
    if close_fallback:
        cut = cut.when(F.instr(rest, "</") > 0, F.substring_index(rest, "</", 1))
    cut = cut.otherwise(rest)
    return F.when(F.instr(t, open_tag) > 0, strip_ws(cut))


def extract_tagged(c, open_tag: str, close_tag: str) -> Column:
    """Generation-time extraction for tagged rule sets: between tags when the open tag occurs, else first line."""
    t = strip_ws(c)
    return F.coalesce(between_tags(t, open_tag, close_tag, close_fallback=True), first_line(t))


def unwrap_doc(c, open_tag: str, close_tag: str) -> Column:
    """Verification-time unwrap: between tags without the ``</`` fallback; text unchanged when untagged."""
    t = _col(c)
    return F.coalesce(between_tags(t, open_tag, close_tag, close_fallback=False), t)


def to_token_pre(n: Column, stripped: Column, token: str) -> Column:
    """As ``extract_to_token`` on already normalised and stripped forms of the text."""
    hit = F.regexp_extract(n, "^((?:(?!%s(?: |$))[^ ]++ )*+%s)(?: |$)" % (token, token), 1)
    return F.when(hit != "", hit).otherwise(stripped)


def extract_to_token(c, token: str) -> Column:
    """Tokens up to and including the first ``token``, single-space joined; else the stripped raw text."""
    return to_token_pre(ws_norm(c), strip_ws(c), token)


def leading_pairs_pre(n: Column, stripped: Column, heads: list[str], tails: list[str]) -> Column:
    pair = "(?:" + "|".join(heads) + ") (?:" + "|".join(tails) + ")"
    run = F.trim(F.regexp_extract(n, "^((?:" + pair + "(?: |$))++)", 1))
    return F.when(run != "", run).otherwise(stripped)


def extract_leading_pairs(c, heads: list[str], tails: list[str]) -> Column:
    """Leading run of (head, tail) token pairs -- any head with any tail; else the stripped raw text."""
    return leading_pairs_pre(ws_norm(c), strip_ws(c), heads, tails)


def strip_prefix(c, prefix) -> Column:
    """Drop ``prefix`` when the text starts with it (older extraction protocol), then keep the first line."""
    t = _col(c)
    p = _col(prefix)
    rest = F.when(t.startswith(p), F.substr(t, F.length(p) + 1)).otherwise(t)
    return first_line(rest)


def count_fused(n: Column, rule_tokens: list[str]) -> Column:
    """Number of tokens that contain a rule token but are not one (``END.``, ``ENDMARKER``, ``BEKER``)."""
    alt = "|".join(rule_tokens)
    pat = "(?:^| )(?!(?:%s)(?: |$))[^ ]*(?:%s)[^ ]*" % (alt, alt)
    return F.regexp_count(n, F.lit(pat))
