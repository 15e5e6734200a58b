"""Scalar column helpers.  All of them are built-in expressions and stay in generated code."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def float_or_zero(c: ColumnOrName) -> Column:
    """The value as a double; NULL becomes 0."""
    return F.coalesce(_col(c).cast("double"), F.lit(0.0))


def float_or_null(c: ColumnOrName) -> Column:
    """The value as a double; 0 becomes NULL."""
    return F.nullif(_col(c).cast("double"), F.lit(0.0))


def int_or_null(c: ColumnOrName) -> Column:
    """The value truncated to an integer; 0 (tested before truncation) becomes NULL."""
    value = _col(c)
    return F.when(value != 0, value.cast("int"))


def iso_text(c: ColumnOrName) -> Column:
    """ISO-8601 text of a UTC time; microseconds are printed only when there are any."""
    value = _col(c)
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    precise = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(F.date_format(value, "SSSSSS") == "000000", whole).otherwise(precise)
    return F.concat(text, F.lit("+00:00"))


def pattern_key(pattern_type: ColumnOrName, timeframe: ColumnOrName) -> Column:
    """``type_timeframe``; NULL if either part is NULL."""
    return F.concat(_col(pattern_type), F.lit("_"), _col(timeframe))


def strategy_patterns(name: ColumnOrName) -> Column:
    """The required patterns listed at the head of a strategy name.

    The head is the text before the first bar; brackets and quotes are removed and the rest is cut
    at comma-space.  An empty head asks for nothing and gives an empty array.
    """
    head = F.regexp_replace(F.split_part(_col(name), F.lit("|"), F.lit(1)), r"[\[\]']", "")
    none = F.array().cast("array<string>")
    return F.when(head == "", none).otherwise(F.split(head, ", "))


def contains_all(have: ColumnOrName, need: ColumnOrName) -> Column:
    """True if every element of ``need`` is in ``have``; NULL elements in ``have`` do no harm."""
    return F.size(F.array_except(_col(need), _col(have))) == 0


def moment(df: DataFrame, column: str, as_of: datetime | Column | None) -> Column:
    """``as_of`` as a value of the type of ``column``, so that comparisons need no cast.

    A cast on the column side would keep the filter from reaching the Parquet scan.
    """
    if isinstance(as_of, Column):
        return as_of
    kind = df.schema[column].dataType
    if as_of is not None:
        return F.lit(as_of.isoformat(sep=" ")).cast(kind)
    if isinstance(kind, T.TimestampNTZType):
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())
    return F.current_timestamp()
