"""Deterministic pseudo-random draws from md5, identical in Spark and in SQL engines.

One ``md5`` per row yields 32 hex digits: digits 1-8 form a 32-bit integer for counts and choices, and each of the
remaining digits is an independent 4-bit draw for per-position choices. ``rand()``, ``hash()`` and
``monotonically_increasing_id()`` are avoided: they differ between engines and (for the id) between runs.

SQL equivalents: ``md5(concat_ws(':', tag, CAST(id AS VARCHAR)))``, ``('0x' || substr(m, 1, 8))::BIGINT`` and
``('0x' || substr(m, p, 1))::INTEGER``.

Generators reference draws many times inside conditional branches, where common-subexpression elimination does not
reach. ``Draws`` therefore projects every draw once as an int column (``draw_columns``) and hands generators plain
column references, which keeps the generated code small enough for whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0
NIBBLE_FIRST, NIBBLE_LAST = 9, 24
LETTERS = "wxyz"


def md5_key(tag: str, key) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", F.lit(tag), key.cast("string")))


def u32(m: Column, start: int = 1) -> Column:
    """32-bit unsigned integer from 8 hex digits of ``m`` starting at ``start`` (1-based)."""
    return F.conv(F.substring(m, start, 8), 16, 10).cast("bigint")


def nibble(m: Column, pos: int) -> Column:
    """4-bit draw (0..15) from the hex digit at ``pos`` (1-based): ascii arithmetic, no base conversion."""
    c = F.ascii(F.substring(m, pos, 1))
    return F.when(c >= 97, c - 87).otherwise(c - 48)


def uniform(m: Column, start: int = 1) -> Column:
    """Uniform double in the open interval (0, 1)."""
    return (u32(m, start) + F.lit(0.5)) / F.lit(TWO_32)


def pick(options: list[str], idx: Column) -> Column:
    """``options[idx]`` with a 0-based integer column (``elt`` compiles to a switch; no per-row array)."""
    return F.elt((idx + F.lit(1)).cast("int"), *[F.lit(o) for o in options])


class Draws:
    """Named draw columns of one md5 key: ``a`` (32-bit), nibbles 9..24, and ``letters``: for every nibble a letter of
    LETTERS, by its remainder modulo 4, so that a whole sequence of choices is one string expression."""

    def __init__(self, prefix: str):
        self.prefix = prefix

    def columns(self, m: Column) -> list[Column]:
        cols = [u32(m, 1).alias(f"{self.prefix}a")]
        cols += [nibble(m, p).alias(f"{self.prefix}n{p}") for p in range(NIBBLE_FIRST, NIBBLE_LAST + 1)]
        hexes = F.substring(m, NIBBLE_FIRST, NIBBLE_LAST - NIBBLE_FIRST + 1)
        cols.append(F.translate(hexes, "0123456789abcdef", LETTERS * 4).alias(f"{self.prefix}letters"))
        return cols

    def names(self) -> list[str]:
        return [f"{self.prefix}a"] + [f"{self.prefix}n{p}" for p in range(NIBBLE_FIRST, NIBBLE_LAST + 1)] + [f"{self.prefix}letters"]

    @property
    def a(self) -> Column:
        return F.col(f"{self.prefix}a")

    def n(self, pos: int) -> Column:
        return F.col(f"{self.prefix}n{pos}")

    def letters(self, pos: int, length: Column | int) -> Column:
        """Letters of ``length`` nibbles from ``pos``."""
        return F.col(f"{self.prefix}letters").substr(F.lit(pos - NIBBLE_FIRST + 1), F.lit(length) if isinstance(length, int) else length)


def spelt(letters: Column, options: list[str]) -> Column:
    """Every letter of LETTERS replaced by a space and its option."""
    for letter, option in zip(LETTERS, options, strict=True):
        letters = F.replace(letters, F.lit(letter), F.lit(" " + option))
    return letters
