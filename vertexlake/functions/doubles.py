"""Order-preserving integer codes of doubles, as plain arithmetic that the planner can move and compile.

The code of a finite double of at least 0 is the integer its IEEE 754 bits spell. It is put together from the exponent and
the fraction: scaling by a power of two is exact, a power of two with a whole exponent is exact, and an exponent that the
logarithm misses by one is mended by looking at the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least normal double, the largest double, and the root of the scale between subnormal numbers and integers.
NORMAL, LARGEST, SCALE = 2.0**-1022, 1.7976931348623157e308, 2.0**537
_STEPS = 1 << 52


def _bits(v: Column) -> Column:
    """The bits of a double; null unless it is finite and positive.

    The first condition looks at the whole sum, so that the compiled code works its parts out once.
    """
    w = F.when((v > 0.0) & (v <= LARGEST), v)
    guess = F.least(F.greatest(F.floor(F.log2(w)), F.lit(-1022)), F.lit(1023)).cast("int")
    over = w / F.pow(F.lit(2.0), guess)
    e = guess + (over >= 2.0).cast("int") - (over < 1.0).cast("int")
    part = F.when(over >= 2.0, over / 2.0).when(over < 1.0, over * 2.0).otherwise(over)
    normal = (e.cast("bigint") + 1023) * _STEPS + ((part - 1.0) * float(_STEPS)).cast("bigint")
    return F.when(normal.isNull(), None).when(w < NORMAL, (w * SCALE * SCALE).cast("bigint")).otherwise(normal)


def code_of(x: Column) -> Column:
    """The bits of a finite double of at least 0 as a bigint: larger value, larger code; -0.0 and 0.0 give 0.

    Null, NaN, infinite and negative values give null.
    """
    v = x.cast("double")
    return F.coalesce(_bits(v), F.when(v == 0.0, F.lit(0).cast("bigint")))


def value_of(code: Column) -> Column:
    """The double whose `code_of` is `code`."""
    c = code.cast("bigint")
    e, part = F.shiftright(c, 52).cast("int"), c.bitwiseAND(F.lit(_STEPS - 1))
    normal = (part + _STEPS).cast("double") * F.pow(F.lit(2.0), e - 1075)
    return F.when(e == 0, part.cast("double") / SCALE / SCALE).otherwise(normal)


def signed_code(x: Column) -> Column:
    """The same for doubles of either sign: a larger number has a larger code. Null and NaN give null; infinities are beyond all."""
    v = x.cast("double")
    other = F.when(F.isnan(v) | v.isNull(), None).when(v == 0.0, F.lit(0)).otherwise(F.lit(0x7FF << 52))
    return F.signum(F.when(~F.isnan(v), v)).cast("bigint") * F.coalesce(_bits(F.abs(v)), other)
