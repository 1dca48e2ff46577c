"""The normal distribution as column arithmetic, good to about fifteen digits: nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A published rational form of the upper tail, highest power first.
TAIL_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BOTTOM = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: A published rational form of the quantile, in the middle and in the tails, highest power first.
MIDDLE_TOP = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
MIDDLE_BOTTOM = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
OUTER_TOP = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
OUTER_BOTTOM = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
OUTER = 0.02425
ROOT = 2.5066282746310002  # of two pi


def _horner(x: Column, powers: tuple[float, ...]) -> Column:
    return reduce(lambda total, c: total * x + c, powers[1:], F.lit(powers[0]))


def _with(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out once, however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def _cdf(x: Column) -> Column:
    z = F.abs(x)
    far = z + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = z + k / far
    tail = F.exp(-z * z / 2) * F.when(z < 7.07106781186547, _horner(z, TAIL_TOP) / _horner(z, TAIL_BOTTOM)).otherwise(1 / (far * ROOT))
    return _with(F.when(z > 37, 0.0).otherwise(tail), lambda t: F.when(x > 0, 1 - t).otherwise(t))


def normal_cdf(x: Column) -> Column:
    return _with(x.cast("double"), lambda v: F.when(v.isNotNull(), _cdf(v)))


def _start(p: Column) -> Column:
    """The rational form, good to nine digits."""
    outer = _with(F.sqrt(-2 * F.ln(F.least(p, 1 - p))), lambda q: _horner(q, OUTER_TOP) / _horner(q, OUTER_BOTTOM))
    middle = _with((p - 0.5) * (p - 0.5), lambda r: _horner(r, MIDDLE_TOP) / _horner(r, MIDDLE_BOTTOM)) * (p - 0.5)
    return F.when(p.between(OUTER, 1 - OUTER), middle).when(p < 0.5, outer).otherwise(-outer)


def normal_quantile(p: Column) -> Column:
    """Null outside (0, 1). One corrected step from a rational start."""

    def corrected(v: Column, x: Column) -> Column:
        return _with((_cdf(x) - v) * ROOT * F.exp(x * x / 2), lambda step: x - step / (1 + x * step / 2))

    return _with(p.cast("double"), lambda v: F.when((v > 0) & (v < 1), _with(_start(v), lambda x: corrected(v, x))))
