"""Column helpers shared by the operators."""

from sigloom.functions.scalars import (
    contains_all,
    float_or_null,
    float_or_zero,
    int_or_null,
    iso_text,
    moment,
    pattern_key,
    strategy_patterns,
)

__all__ = [
    "contains_all",
    "float_or_null",
    "float_or_zero",
    "int_or_null",
    "iso_text",
    "moment",
    "pattern_key",
    "strategy_patterns",
]
