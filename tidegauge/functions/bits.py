"""The 64 bits of doubles as longs, and arithmetic that wraps.

Spark has no cast between a double and its bits, so these are Arrow-batched views of the same memory.
Sums and differences of words wrap modulo 2^64 in 32-bit halves, as ANSI mode raises on overflow.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

MANTISSA = (1 << 52) - 1


@F.pandas_udf(LongType())
def _to_bits(v: pd.Series) -> pd.Series:
    return pd.Series(np.ascontiguousarray(v.to_numpy(np.float64)).view(np.int64))


@F.pandas_udf(DoubleType())
def _to_double(b: pd.Series) -> pd.Series:
    return pd.Series(b.to_numpy(np.int64).view(np.float64))


def double_bits(value: Column) -> Column:
    """IEEE bits of a double; null stays null."""
    return F.when(value.isNotNull(), _to_bits(F.coalesce(value, F.lit(0.0))))


def bits_double(bits: Column) -> Column:
    return F.when(bits.isNotNull(), _to_double(F.coalesce(bits, F.lit(0).cast("long"))))


def exponent(bits: Column) -> Column:
    """Unbiased binary exponent."""
    return F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(2047)) - 1023


def mantissa(bits: Column) -> Column:
    return bits.bitwiseAND(F.lit(MANTISSA))


def binary_text(bits: Column) -> Column:
    """64 binary digits."""
    return F.lpad(F.bin(bits), 64, "0")


def leading_zeros(bits: Column) -> Column:
    return F.when(bits < 0, 0).when(bits == 0, 64).otherwise(64 - F.length(F.bin(bits)))


def trailing_zeros(bits: Column) -> Column:
    return F.when(bits == 0, 64).otherwise(64 - F.length(F.rtrim(binary_text(bits), F.lit("0"))))


def reverse_bits(bits: Column, width: int = 64) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(bits), width, "0")), 2, -10).cast("long")


def _wrapped(a: Column, b: Column, sign: int) -> Column:
    low = F.lit(0xFFFFFFFF)
    lows = a.bitwiseAND(low) + sign * b.bitwiseAND(low)
    highs = F.shiftright(a, 32) + sign * F.shiftright(b, 32) + F.shiftright(lows, 32)
    return F.shiftleft(highs.bitwiseAND(low), 32).bitwiseOR(lows.bitwiseAND(low))


def wrapping_add(a: Column, b: Column) -> Column:
    return _wrapped(a, b, 1)


def wrapping_sub(a: Column, b: Column) -> Column:
    return _wrapped(a, b, -1)
