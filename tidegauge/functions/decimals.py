"""Decimal places of numbers, from their text or from their bits."""

from __future__ import annotations

import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Decimals that are looked for in a double's bits.
MOST = 16


def text_decimals(raw: Column) -> Column:
    """Digits after the point of a number's text, without trailing zeros.

    An exponent counts as digits ("1.5e3" has 3); no point means 0; null stays null.
    """
    after = F.regexp_extract(F.trim(raw), r"^[+-]?[^.]*\.(.*)$", 1)
    return F.when(raw.isNotNull(), F.length(F.rtrim(after, F.lit("0"))))


def decimal_places(value: float) -> int:
    """Decimals of the shortest text that reads back as value, at most MOST; 0 if it isn't finite."""
    if value != value or value in (float("inf"), float("-inf")):
        return 0
    text = Decimal(repr(value)).normalize()
    return min(MOST, max(0, -text.as_tuple().exponent))


@F.pandas_udf(IntegerType())
def _places(values: pd.Series) -> pd.Series:
    known = {v: decimal_places(v) for v in values.dropna().unique().tolist()}
    return values.map(known).astype("Int32")


def value_decimals(value: Column) -> Column:
    """Decimals of a double's shortest text; null stays null."""
    return _places(value)


def digits(value: float) -> dict[str, int | None]:
    """Of the shortest text that reads back as value: decimals (alpha), digits from the first that isn't
    zero to the last decimal (beta), and beta again, or 0 for one tenth, a hundredth, ... (beta_star)."""
    if not math.isfinite(value) or value == 0:
        return {"alpha": None, "beta": None, "beta_star": None}
    number = Decimal(repr(abs(value))).normalize()
    alpha = max(0, -number.as_tuple().exponent)
    beta = number.adjusted() + alpha + 1
    return {"alpha": alpha, "beta": beta, "beta_star": 0 if number < 1 and number.as_tuple().digits == (1,) else beta}


@F.pandas_udf(StructType([StructField(c, IntegerType()) for c in ("alpha", "beta", "beta_star")]))
def _digits(values: pd.Series) -> pd.DataFrame:
    none = {"alpha": None, "beta": None, "beta_star": None}
    known = {v: digits(v) for v in values.dropna().unique().tolist()}
    return pd.DataFrame([known.get(v, none) for v in values.tolist()], columns=list(none), dtype="Int32")


def significant_digits(value: Column) -> Column:
    """digits of a column: a struct of nulls for null, zero and what isn't finite."""
    return _digits(value)


def bits_of_decimals(places: Column) -> Column:
    """Bits after the point that so many decimals need."""
    return F.ceil(places * math.log2(10)).cast("int")
