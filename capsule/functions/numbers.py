"""Number expressions: rounding on the exact binary value, dirty-number parsing, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def exact_round(x: Column, digits: int = 0) -> Column:
    """Round a double to `digits` decimals; what counts is its binary value, true ties go to the even digit.

    `bround` decides on the shortest decimal text of the double instead, so 0.205 (binary: below the tie)
    would go up. The residue of the scaling product is exact: both halves of the split `x` have few enough
    bits for a small integer factor.
    """
    if digits == 0:
        return F.rint(x) + 0.0
    scale = float(10 ** digits)
    twice = x * (2 * scale)
    split = x * 134217729.0
    hi = split - (split - x)
    residue = (hi * (2 * scale) - twice) + (x - hi) * (2 * scale)
    on_tie = (F.floor(twice) == twice) & (F.pmod(twice, F.lit(2.0)) == 1.0)
    nearest = (F.when(on_tie & (residue > 0), (twice + 1.0) / 2.0)
               .when(on_tie & (residue < 0), (twice - 1.0) / 2.0)
               .otherwise(F.rint(x * scale)))
    return F.when(on_tie & (residue == 0), F.rint(twice / 2.0)).otherwise(nearest) / scale + 0.0


def whole(x: Column) -> Column:
    """Nearest whole number, ties to even, as BIGINT."""
    return F.rint(x).cast("bigint")


def to_double(c: Column) -> Column:
    """Text to double, NULL where it is no plain number (casts alone accept suffixes such as '12d')."""
    text = c.cast("string")
    return F.when(text.rlike(NUMERIC), text.try_cast("double"))


def positive(c: Column) -> Column:
    """A positive number out of a dirty scalar, else NULL."""
    v = to_double(c)
    return F.when((v > 0) & ~F.isnan(v), v)


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Value forced into bounds; NULL stays NULL (least and greatest would pass over it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def fixed(x: Column, digits: int) -> Column:
    """Text with exactly `digits` decimals."""
    return F.format_string(f"%.{digits}f", exact_round(x, digits))


def money(x: Column) -> Column:
    return F.concat(F.lit("$"), F.when(x < 100, fixed(x, 2)).otherwise(fixed(x, 0)))


def kilograms(x: Column) -> Column:
    return F.when(x < 1, fixed(x, 2)).when(x < 100, fixed(x, 1)).otherwise(fixed(x, 0))
