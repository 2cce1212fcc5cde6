"""Null-safe arithmetic, rounding of K, deterministic draws and decision labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Score is clipped to this distance from 0 and 1 before a logit.
LOGIT_EDGE = 1e-6
FOUR_FIFTHS = 0.8


def finite(x: Column) -> Column:
    """NaN as null: the engine knows one missing value only."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or either is missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def k_of(fraction: Column | float, n: Column, least: int = 1) -> Column:
    """Rows to select of ``n``: half to even, ``least`` at least."""
    f = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return F.greatest(F.lit(least).cast("long"), F.rint(f * n).cast("long"))


def tie_key(seed: int | Column, *keys: Column) -> Column:
    """A total order of rows that depends on their keys only, never on their place."""
    first = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", first, *(k.cast("string") for k in keys)))


def hash_unit(*parts: Column) -> Column:
    """A uniform number in [0, 1) with 28 bits, from the MD5 of the parts."""
    return hash_int(*parts) / F.lit(float(1 << 28))


def hash_int(*parts: Column) -> Column:
    """A uniform integer below 2**28, from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 7), 16, 10).cast("long")


def normal(mean: Column | float, sd: float, *parts: Column) -> Column:
    """A normal draw by Box-Muller on two hashed uniforms."""
    u = (hash_int(*parts, F.lit("u")) + 1) / F.lit(float((1 << 28) + 1))
    v = hash_unit(*parts, F.lit("v"))
    m = mean if isinstance(mean, Column) else F.lit(float(mean))
    return m + F.lit(float(sd)) * F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0) * F.lit(3.141592653589793) * v)


def poisson(rate: float, *parts: Column, most: int = 30) -> Column:
    """A Poisson draw by the inverse distribution function of a hashed uniform."""
    import math

    u, total, term, steps = hash_unit(*parts), 0.0, math.exp(-rate), []
    for k in range(most):
        total += term
        term *= rate / (k + 1)
        steps.append(total)
    return sum((F.when(u >= F.lit(x), 1).otherwise(0) for x in steps), F.lit(0)).cast("int")


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logit(p: Column) -> Column:
    c = F.greatest(F.lit(LOGIT_EDGE), F.least(F.lit(1 - LOGIT_EDGE), p))
    return F.ln(c / (F.lit(1.0) - c))


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def binary_group(value: Column, group_0: Sequence[str], group_1: Sequence[str]) -> Column:
    """0, 1, or -1 for values of neither; group 0 where a value is in both."""
    return F.when(value.isin(list(group_0)), 0).when(value.isin(list(group_1)), 1).otherwise(-1)


def group_of(value: Column, axis: Mapping) -> Column:
    return binary_group(value, axis["group_0_values"], axis["group_1_values"])


def four_fifths(di: Column, symmetric: bool = False) -> Column:
    """Whether a ratio passes: 0.8 or more, and with ``symmetric`` 1.25 or less."""
    ok = di >= FOUR_FIFTHS
    return ok & (di <= 1.25) if symmetric else ok


def decomposition_label(original: Column, stripped: Column) -> Column:
    """What drives a disparity, from the ratios before and after markers are stripped."""
    before, after = F.abs(original - 1), F.abs(stripped - 1)
    return (
        F.when(original.isNull() | stripped.isNull(), "n/a").when(before < 0.1, "no DI to explain")
        .when(after < 0.4 * before, "marker-driven").when(after > 0.7 * before, "content-driven").otherwise("mixed")
    )


def equivalence_verdict(r: Column) -> Column:
    """``r``: mean distance across strata in a seed, over that across seeds."""
    return F.when(r < 0.7, "holds constant").when(r > 0.9, "meaningful variation").otherwise("marginal")


def prereg_decision(di: Column, p: Column) -> Column:
    """The confirmatory rule; the region that it leaves open is named, not guessed."""
    return F.when(di >= 0.8, "H1").when((di < 0.8) & (p <= 0.1), "H0").when((di >= 0.65) & (di < 0.8) & (p > 0.1), "ambiguous").otherwise("undefined")


def stratum_label(*parts: Column) -> Column:
    return F.translate(F.concat_ws("_", *parts), "/ ", "__")


def stratum_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)
