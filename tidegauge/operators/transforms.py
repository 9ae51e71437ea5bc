"""Reversible transforms of series, forward and back, chunk by chunk where order matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import chunked, neighbours, running_sum, with_stats

V = F.col


def _with(series: DataFrame, value: Column, *more: Column) -> DataFrame:
    return series.select("series_id", "pos", value.alias("value"), *more)


def delta(series: DataFrame) -> DataFrame:
    """Differences to the value before; the first value stays."""
    return _with(neighbours(series), V("value") - F.coalesce("p1", F.lit(0.0)))


def delta_recover(series: DataFrame) -> DataFrame:
    """Running sums. Exact for whole numbers; sums of doubles may differ in their last digits."""
    return _with(running_sum(chunked(series), "value", "total"), V("total"))


def delta2(series: DataFrame) -> DataFrame:
    return delta(delta(series))


def delta2_recover(series: DataFrame) -> DataFrame:
    return delta_recover(delta_recover(series))


def ranged(series: DataFrame) -> DataFrame:
    """value - min, with base; a series of one value is left as it is, base 0."""
    base = F.when(F.count(F.lit(1)) > 1, F.min("value")).otherwise(F.lit(0.0))
    return _with(with_stats(series, base=base), V("value") - V("base"), V("base"))


def ranged_recover(series: DataFrame) -> DataFrame:
    return _with(series, V("value") + V("base"))


def logged(series: DataFrame) -> DataFrame:
    """ln(value + offset), offset = 1 - min. Not exact on the way back."""
    return _with(with_stats(series, offset=1 - F.min("value")), F.log(V("value") + V("offset")), V("offset"))


def logged_recover(series: DataFrame) -> DataFrame:
    return _with(series, F.exp(V("value")) - V("offset"))


def minmax(series: DataFrame) -> DataFrame:
    """To 0..1; an unvarying series to 0."""
    rows = with_stats(series, low=F.min("value"), high=F.max("value"))
    scaled = F.when(V("high") > V("low"), (V("value") - V("low")) / (V("high") - V("low"))).otherwise(0.0)
    return _with(rows, scaled, V("low"), V("high"))


def minmax_recover(series: DataFrame) -> DataFrame:
    return _with(series, V("value") * (V("high") - V("low")) + V("low"))


def zscore(series: DataFrame) -> DataFrame:
    """(value - mean) / population deviation; an unvarying series to 0."""
    rows = with_stats(series, mean=F.avg("value"), std=F.stddev_pop("value"))
    return _with(rows, F.when(V("std") > 0, (V("value") - V("mean")) * (1 / V("std"))).otherwise(0.0), V("mean"), V("std"))


def zscore_recover(series: DataFrame) -> DataFrame:
    return _with(series, V("value") * V("std") + V("mean"))


def identity(series: DataFrame) -> DataFrame:
    return _with(series, V("value"))


def precision(series: DataFrame, digits: int, rounded: bool = False) -> DataFrame:
    """value * 10^digits as a whole number: cut off, or rounded half away from zero."""
    x = V("value") * float(10**digits)
    x = x + F.when(V("value") >= 0, 0.5).otherwise(-0.5) if rounded else x
    return _with(series, x.cast("long"))


def precision_recover(series: DataFrame, digits: int) -> DataFrame:
    return _with(series, V("value").cast("double") / float(10**digits))


def less_min(series: DataFrame, low: float) -> DataFrame:
    return _with(series, V("value") - low)


def plus_min(series: DataFrame, low: float) -> DataFrame:
    return _with(series, V("value") + low)


def enum_index(series: DataFrame, enumeration: DataFrame) -> DataFrame:
    """Index of each value in its series' enumeration (series_id, enumeration array, first seen first).

    A value that isn't in it takes the nearest one's index, the first of equally near ones.
    """
    rows = series.join(enumeration.select("series_id", "enumeration"), "series_id")
    gaps = F.transform("enumeration", lambda e, k: F.struct(F.abs(e - V("value")).alias("gap"), k.alias("k")))
    exact = F.array_position(V("enumeration"), V("value"))
    return _with(rows, F.when(exact > 0, exact - 1).otherwise(F.array_min(gaps)["k"]).cast("long"))


def enum_recover(series: DataFrame, enumeration: DataFrame) -> DataFrame:
    """Values of indexes; 0 for an index that isn't there."""
    rows = series.join(enumeration.select("series_id", "enumeration"), "series_id")
    return _with(rows, F.coalesce(F.get(V("enumeration"), V("value").cast("int")), F.lit(0.0)))


def steps(series: DataFrame, falling: bool = False) -> DataFrame:
    """Differences cut to whole numbers, from the second value on; a fall's sign is turned if falling."""
    rows = neighbours(series).where("p1 is not null")
    d = V("p1") - V("value") if falling else V("value") - V("p1")
    return _with(rows, d.cast("long"))


def steps_recover(series: DataFrame, base: float, falling: bool = False) -> DataFrame:
    """The values after base (at the position before the first step)."""
    rows = running_sum(chunked(series), "value", "total")
    return _with(rows, F.lit(float(base)) + (-V("total") if falling else V("total")))


def discrete(series: DataFrame, step: float) -> DataFrame:
    """Steps from the series' minimum: (value - min) / step + 0.5, cut off."""
    return _with(with_stats(series, base=F.min("value")), ((V("value") - V("base")) / step + 0.5).cast("long"), V("base"))


def discrete_recover(series: DataFrame, step: float) -> DataFrame:
    return _with(series, V("base") + V("value") * step)
