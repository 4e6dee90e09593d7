"""An optimizer fence for wide derived columns.

Catalyst pushes filters down through projections by substituting each alias with its definition. When derived
columns form a chain of shared intermediates (normalise -> extract -> verdict), that substitution multiplies every
shared subexpression into the filter condition. Passing the derived columns through a one-row ``inline`` (a Generate
node) stops the substitution: filters on generated columns stay above it, and everything below is computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame, keep: list[str], derived: list[str]) -> DataFrame:
    """``keep`` columns pass through; ``derived`` columns come out of the Generate."""
    return df.select(*keep, F.inline(F.array(F.struct(*[F.col(c) for c in derived]))))
