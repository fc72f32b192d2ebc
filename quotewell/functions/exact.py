"""Exact decimals beyond DECIMAL(38): texts with up to 28 places, rounded once, half to even, in Arrow batches."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Context, Decimal, InvalidOperation
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE, DIGITS = 28, 76
_CONTEXT = Context(prec=200, rounding=ROUND_HALF_EVEN)


def round_ratio(numerator: int, denominator: int) -> str | None:
    """The decimal of a ratio with 28 places, half to even; null on division by zero or over 76 digits."""
    if denominator == 0:
        return None
    if denominator < 0:
        numerator, denominator = -numerator, -denominator
    whole, rest = divmod(abs(numerator) * 10**SCALE, denominator)
    whole += 2 * rest > denominator or (2 * rest == denominator and whole & 1)
    if whole >= 10**DIGITS:
        return None
    return plain(Decimal(whole if numerator >= 0 else -whole).scaleb(-SCALE, _CONTEXT))


def plain(value: Decimal) -> str:
    """Without exponent or trailing zeros."""
    text = format(value.normalize(_CONTEXT), "f")
    return "0" if text in ("-0", "0") else text


def fraction(text: str | None) -> Fraction | None:
    try:
        return None if text is None else Fraction(Decimal(text))
    except (InvalidOperation, ValueError, OverflowError):
        return None


def _apply(op):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(map(fraction, a), map(fraction, b), strict=True):
            value = None if x is None or y is None else op(x, y)
            out.append(None if value is None else round_ratio(value.numerator, value.denominator))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")


def multiply(a: Column, b: Column) -> Column:
    return _apply(lambda x, y: x * y)(a, b)


def divide(a: Column, b: Column) -> Column:
    return _apply(lambda x, y: x / y if y else None)(a, b)


def multiply_ratio(value: Column, numerator: Column, denominator: Column) -> Column:
    """value * numerator / denominator with one rounding."""

    def run(v: pd.Series, n: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for x, y, z in zip(map(fraction, v), map(fraction, n), map(fraction, d), strict=True):
            r = None if None in (x, y, z) or not z else x * y / z
            out.append(None if r is None else round_ratio(r.numerator, r.denominator))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(value, numerator, denominator)
