"""Column expressions shared by the operators."""

from fieldspark.functions.numeric import (
    finite,
    finite_or_null,
    guarded_ratio,
    half_even,
    ieee_ratio,
    is_finite,
    lenient_double,
    log_ratio,
    order_label,
    relative_difference,
    speed,
    strict,
)

__all__ = [
    "finite",
    "finite_or_null",
    "guarded_ratio",
    "half_even",
    "ieee_ratio",
    "is_finite",
    "lenient_double",
    "log_ratio",
    "order_label",
    "relative_difference",
    "speed",
    "strict",
]
