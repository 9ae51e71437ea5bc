"""Parts of doubles: mantissa and exponent, whole and fraction, and decimals written into the bits."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .bits import double_bits, exponent


def split_exponent(value: Column) -> Column:
    """The power of two that brings a value of at least 1 to [0.5, 1); 0 for smaller, null for odd ones."""
    e = exponent(double_bits(value)) + 1
    return F.when(F.abs(value) < 1, 0).when(F.abs(value) < float("inf"), e).cast("long")


def split_mantissa(value: Column) -> Column:
    """value / 2^split_exponent(value): exact, with the value's sign."""
    return value / F.pow(F.lit(2.0), split_exponent(value))


def whole_part(value: Column) -> Column:
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("double")


def fraction_part(value: Column) -> Column:
    """What whole_part leaves, with the value's sign."""
    return value - whole_part(value)


def with_decimal_fraction(value: float) -> float:
    """The double whose fraction bits are the value's decimals as a whole number, lowest bit first.

    Sign, exponent and the bits of the whole part stay. Values with no bit for a fraction, or with none
    left of the kept ones, stay as they are. There is no way back.
    """
    if not math.isfinite(value):
        return value
    bits = struct.unpack("<Q", struct.pack("<d", value))[0]
    keep = 12 + (bits >> 52 & 2047) - 1023
    if not 0 < keep < 64:
        return value
    fraction = np.format_float_positional(abs(value) - math.floor(abs(value)), trim="-").partition(".")[2]
    digits = int(fraction or 0)
    if digits >> 64:
        digits = (1 << 64) - 1
    reverse = int(f"{digits:064b}"[::-1], 2)
    bits = bits >> 64 - keep << 64 - keep | reverse >> keep
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


@F.pandas_udf(DoubleType())
def _decimal_fraction(v: pd.Series) -> pd.Series:
    return v.map(with_decimal_fraction)


def decimal_fraction(value: Column) -> Column:
    """with_decimal_fraction of a column; null stays null."""
    return F.when(value.isNotNull(), _decimal_fraction(F.coalesce(value, F.lit(0.0))))
