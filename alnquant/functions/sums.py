"""Sums that don't depend on the order of their terms.

Weights are 1/N or 1/(2N).  In units of 1/720720 they are whole numbers for N up to 15 (and within a millionth beyond), so a
sum of units is the same whatever the partitioning; length-normalised terms are rounded to 1e-12 each.  With ``exact``
off, plain double sums are taken.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = 720720
FINE = 1_000_000_000_000


def weight_sum(c: Column, when: Column | None = None, exact: bool = False) -> Column:
    term = F.round(c * float(UNITS)).cast("bigint") if exact else c
    if when is not None:
        term = F.when(when, term)
    zero = F.lit(0).cast("bigint") if exact else F.lit(0.0)
    total = F.coalesce(F.sum(term), zero)
    return total / F.lit(float(UNITS)) if exact else total


def fine(c: Column) -> Column:
    return F.floor(c * float(FINE) + 0.5).cast("bigint")


def total(c: Column, exact: bool = False, norm: bool = False) -> Column:
    """Sum of weights, or with ``norm`` of length-normalised terms."""
    if not exact:
        return F.sum(c)
    if norm:
        return F.sum(fine(c)) / F.lit(float(FINE))
    return F.sum(F.round(c * float(UNITS)).cast("bigint")) / F.lit(float(UNITS))
