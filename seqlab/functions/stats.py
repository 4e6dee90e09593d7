"""Statistics as column expressions: two-proportion z-test with a normal tail from an erfc polynomial.

Neither Spark nor the SQL oracle ships ``erf``/``erfc``; the Abramowitz-Stegun 7.1.26 polynomial is accurate to
about 1.5e-7 absolute, which is ample for significance stars.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: Abramowitz & Stegun 7.1.26 coefficients ---------------------------------------------------
AS_P = 0.3275911
AS_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# -------------------------------------------------------------------------------------------------------------


def erfc_abs(x: Column) -> Column:
    """erfc(|x|) for a double column."""
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * ax)
    poly = F.lit(0.0)
    for a in reversed(AS_A):
        poly = (poly + F.lit(a)) * t
    return poly * F.exp(-ax * ax)


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value: P(|Z| >= |z|) = erfc(|z| / sqrt 2)."""
    return erfc_abs(z / F.lit(2.0 ** 0.5))


def pooled_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Pooled two-proportion z statistic of sample 1 vs sample 2; null when undefined."""
    p1 = x1 / n1
    p2 = x2 / n2
    p = (x1 + x2) / (n1 + n2)
    se = F.sqrt(p * (F.lit(1.0) - p) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    return F.when(se > 0, (p1 - p2) / se)


def stars(p: Column) -> Column:
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise(""))
