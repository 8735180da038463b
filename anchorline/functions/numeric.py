"""Numeric column expressions: rounding for comparison, the normal distribution, guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anchorline.spec import Z90

# fixed values: West (2005) rational approximation of the normal upper tail, highest power first
_NUM = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_DEN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948,
        440.413735824752)
_SPLIT = 7.07106781186547
_ROOT_TWO_PI = 2.506628274631


def rounded_value(c) -> Column:
    """Rounding for comparison between engines: five decimals, so that the order of a floating-point sum does not show; a nudge moves exact
    half-way values off the tie, and negative zero becomes zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(1e-9), 5) + F.lit(0.0)


def _horner(coefs, a: str) -> str:
    acc = f"{coefs[0]!r}D"
    for c in coefs[1:]:
        acc = f"({acc} * {a} + {c!r}D)"
    return acc


def phi(z: str) -> Column:
    """Standard normal distribution function of a SQL expression; one parsed expression, all of it inside generated code. The tail stands in it once (1 - t is
    1 + -1 * t to the bit), as a generated method of twice the size is not compiled."""
    a = f"abs({z})"
    e = f"exp(-({a} * {a}) / 2D)"
    frac = f"({a} + 1D/({a} + 2D/({a} + 3D/({a} + 4D/({a} + 0.65D)))))"
    tail = (f"CASE WHEN {a} > 37D THEN 0D WHEN {a} < {_SPLIT!r}D THEN {e} * {_horner(_NUM, a)} / {_horner(_DEN, a)} "
            f"ELSE {e} / {frac} / {_ROOT_TWO_PI!r}D END")
    return F.expr(f"if({z} > 0, 1D, 0D) + if({z} > 0, -1D, 1D) * ({tail})")


def exceed_probability(baseline: str, mean: str, sd: str, threshold: float) -> Column:
    """P(baseline + rise >= threshold) for a normal rise, from SQL expressions."""
    margin = f"({baseline} + {mean} - {float(threshold)!r}D)"
    return F.when(F.expr(f"{sd} > 0"), phi(f"({margin} / {sd})")).otherwise(F.expr(f"CAST({margin} >= 0 AS DOUBLE)"))


def interval90(mean: Column, sd: Column) -> tuple[Column, Column]:
    return mean - F.lit(Z90) * sd, mean + F.lit(Z90) * sd


def finite(c) -> Column:
    """True for a value that is neither NULL, NaN nor infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def clean(c) -> Column:
    """NaN and infinities become NULL: pandas-style missing values, once, at ingest."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(finite(c), c)


def log_loss(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))
