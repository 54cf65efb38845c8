"""Scalar column expressions: finiteness, rounding keys, guarded arithmetic.

Missing values are NULL everywhere in this package. Inputs may still hold NaN
or infinities; ``finite_or_null`` projects those to NULL once, early, because
Spark's ``max``, ``avg`` and ``sum`` would otherwise propagate them.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: denominators at or below this count as zero in the safe metrics.
SAFE_DENOMINATOR = 1e-14

ColumnLike = Column | str


def _col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_finite(value: ColumnLike) -> Column:
    """True when the value is neither NULL, NaN nor infinite."""
    c = _col(value)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite(*values: ColumnLike) -> Column:
    """True when every value is finite."""
    return reduce(lambda a, b: a & b, (is_finite(v) for v in values))


def finite_or_null(value: ColumnLike) -> Column:
    c = _col(value)
    return F.when(is_finite(c), c)


def nan_to_null(value: ColumnLike) -> Column:
    """Drop NaN but keep infinities, so that ``min`` and ``max`` skip NaN only."""
    c = _col(value)
    return F.when(~F.isnan(c), c)


def clean(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Replace non-finite values of ``columns`` by NULL."""
    return df.withColumns({c: finite_or_null(c) for c in columns})


def half_even(value: ColumnLike, decimals: int) -> Column:
    """Round half to even by scaling, the key under which nearby points merge."""
    scale = F.lit(10.0**decimals)
    return F.rint(_col(value) * scale) / scale


def speed(u: ColumnLike = "u", v: ColumnLike = "v", w: ColumnLike = "w") -> Column:
    u, v, w = _col(u), _col(v), _col(w)
    return F.sqrt(u * u + v * v + w * w)


def guarded_ratio(numerator: Column, denominator: Column, floor: float = SAFE_DENOMINATOR) -> Column:
    """NULL unless the denominator is above ``floor``."""
    return F.when(denominator > F.lit(floor), numerator / denominator)


def ieee_ratio(numerator: Column, denominator: Column) -> Column:
    """Division of doubles where a divisor of zero gives an infinity or NaN instead of an error; zero counts as positive."""
    return F.when(denominator == 0.0, numerator * F.lit(float("inf"))).otherwise(F.try_divide(numerator, denominator))


def relative_difference(value: ColumnLike, reference: ColumnLike) -> Column:
    v, r = _col(value), _col(reference)
    return F.when(finite(v, r) & (r != 0.0), F.try_divide(v - r, r))


def log_ratio(value: ColumnLike, reference: ColumnLike) -> Column:
    """ln(value) - ln(reference), NULL unless both are positive."""
    v, r = _col(value), _col(reference)
    return F.when((v > 0.0) & (r > 0.0), F.ln(v) - F.ln(r))


def lenient_double(text: ColumnLike) -> Column:
    """Parse text to a double; blank or unreadable text gives NULL."""
    return F.trim(_col(text)).try_cast("double")


def order_label(text: ColumnLike, labels: Iterable[str] = ("N5", "N7", "N9")) -> Column:
    """Normalise ``"N5"``, ``"n5"`` or ``"5"`` to the label; anything else gives NULL."""
    bare = F.regexp_replace(F.trim(_col(text)), "^[Nn]", "")
    label = F.concat(F.lit("N"), bare)
    return F.when(label.isin(*labels), label)


def strict(condition: Column, message: str, value: Column) -> Column:
    """``value`` while ``condition`` holds, otherwise fail the job with ``message``."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))
