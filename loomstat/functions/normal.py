"""Tails of the normal and of the chi-square distribution as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 2000


def two_sided_normal(z: str) -> Column:
    """Probability that a standard normal value lies further from zero than the column ``z``; a
    Simpson sum over ten units, beyond which nothing is left of the integrand."""
    start, step = f"abs({z})", 10 / STEPS
    point = f"(abs({z}) + i * {step!r}D)"
    total = f"aggregate(sequence(0, {STEPS}), 0.0D, (s, i) -> s + IF(i = 0 OR i = {STEPS}, 1.0D, IF(i % 2 = 1, 4.0D, 2.0D)) * exp(-{point} * {point} / 2))"
    return F.expr(f"IF({start} IS NULL, NULL, {step!r}D / 3 * {total} * sqrt(2 / pi()))")


def chi_square_tail(q: str, df: str) -> Column:
    """Upper tail of a chi-square column ``q`` with a whole number of degrees of freedom, column ``df``:
    the finite sums for even and for odd ones. Null without degrees of freedom."""
    even = f"exp(-{q} / 2) * aggregate(sequence(1, greatest(CAST({df} DIV 2 AS INT), 1)), named_struct('s', 0.0D, 't', 1.0D), (z, j) -> named_struct('s', z.s + z.t, 't', z.t * {q} / 2 / j)).s"
    odd = f"exp(-{q} / 2) * aggregate(sequence(0, CAST({df} DIV 2 AS INT)), named_struct('s', 0.0D, 't', sqrt(2 * {q} / pi())), (z, j) -> IF(j = 0, z, named_struct('s', z.s + z.t, 't', z.t * {q} / (2 * j + 1)))).s"
    return F.when(F.expr(f"{df} >= 1 AND {q} IS NOT NULL"), F.when(F.expr(f"{df} % 2 = 0"), F.expr(even)).otherwise(two_sided_normal(f"sqrt({q})") + F.expr(odd)))
