"""Null-safe membership tests for named value groups.

The analysis tests membership with Python's ``in``: a null value is simply
*not in* any list.  SQL ``NOT IN`` yields NULL instead and silently drops the
row, so every membership here is coalesced to a definite boolean.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _same_kind(values: Iterable, dtype: T.DataType) -> list:
    """The values Python's ``==`` could match against ``dtype``, as that type.

    ``True == 1`` and ``False == 0`` hold both ways: a number column meets a
    boolean as 1 or 0, a boolean column meets 1 and 0 (and no other number).
    """
    out = []
    for v in values:
        if isinstance(dtype, T.StringType) and isinstance(v, str):
            out.append(v)
        elif isinstance(dtype, T.BooleanType) and isinstance(v, (bool, int, float)) and v in (0, 1):
            out.append(bool(v))
        elif isinstance(dtype, T.NumericType) and isinstance(v, (bool, int, float)):
            out.append(int(v) if isinstance(v, bool) else v)
    return list(dict.fromkeys(out))


def parse_values(texts: Iterable[str], dtype: T.DataType) -> list:
    """Texts, as from a command line, as values of ``dtype``; one that does not parse raises."""
    def parse(text: str):
        if isinstance(dtype, T.BooleanType):
            return {"true": True, "false": False}[text.strip().lower()]
        if isinstance(dtype, T.IntegralType):
            return int(text)
        if isinstance(dtype, T.NumericType):
            return float(text)
        return text

    out = []
    for text in texts:
        try:
            out.append(parse(text))
        except (KeyError, ValueError):
            raise ValueError(f"{text!r} is not a value of type {dtype.simpleString()}") from None
    return out


def in_values(col: Column, values: Iterable, dtype: T.DataType | None = None) -> Column:
    """True when ``col`` equals one of ``values``, else False (never null).

    With ``dtype`` given, values of another kind (say strings against a
    boolean column) are dropped first: they can never be equal.  A ``None``
    among the values matches null, as Python's ``in`` would (the string
    ``'None'`` is an ordinary value and does not).
    """
    vals = list(values)
    matches_null = any(v is None for v in vals)
    vals = [v for v in vals if v is not None]
    if dtype is not None:
        vals = _same_kind(vals, dtype)
    else:
        vals = list(dict.fromkeys(vals))
    test = F.coalesce(col.isin(vals), F.lit(False)) if vals else F.lit(False)
    return (test | col.isNull()) if matches_null else test


def column_in_values(df: DataFrame, column: str, values: Iterable) -> Column:
    """``in_values`` for a column of ``df``, typed from its schema."""
    return in_values(F.col(column), values, df.schema[column].dataType)
