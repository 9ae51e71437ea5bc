"""The statistical profile of each series.

Every family of features is a few aggregates over rows that know their neighbours. Windows are over
chunks of a series (see series.py), so a long series is spread over tasks. Values that aren't finite
count as rows but take no part in the statistics.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bits import double_bits, exponent, mantissa
from ..storage import write_table
from .series import KEY, chunk_size, chunked, finite, in_chunk, neighbours, running_sum, with_stats

#: Differences smaller than this are zero; bins of the value histogram; lags of the autocorrelation.
TINY, BINS, LAGS, MOST_LAG = 1e-10, 100, 10, 100


def _values(series: DataFrame) -> DataFrame:
    return series.select("series_id", "pos", F.when(finite(), F.col("value")).alias("v"))


def _finite(series: DataFrame) -> DataFrame:
    return series.where(finite()).select("series_id", "pos", F.col("value").alias("v"))


def near(series: DataFrame) -> DataFrame:
    """The finite values with the two before them, on which several families rest."""
    return neighbours(_finite(series), "v")


def _sizes(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def basic(series: DataFrame) -> DataFrame:
    """min, max, mean, median, deviation, variance, skewness, kurtosis (not excess), range, quartiles."""
    v = F.col("v")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = _values(series).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("n_finite"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std_dev"), F.var_pop(v).alias("variance"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"), q.alias("q"),
    )
    flat = F.col("std_dev") == 0
    return out.select(
        "series_id", "n", "n_finite", "min", "max", "mean", F.col("q")[1].alias("median"), "std_dev", "variance",
        F.when(flat, 0.0).otherwise(F.col("skewness")).alias("skewness"), F.when(flat, 0.0).otherwise(F.col("kurtosis") + 3).alias("kurtosis"),
        (F.col("max") - F.col("min")).alias("range"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"),
    )


def quantiles(series: DataFrame, shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact quantiles by linear interpolation at rank p * (n - 1)."""
    q = F.percentile("v", F.array(*map(F.lit, shares)))
    out = _values(series).groupBy("series_id").agg(q.alias("q"))
    return out.select("series_id", *[F.col("q")[k].alias(f"p{round(100 * p):02d}") for k, p in enumerate(shares)])


def value_props(series: DataFrame) -> DataFrame:
    """Distinct values, zeros and whole numbers, and their shares of all rows."""
    # one row a distinct value first: the counts then need no expansion
    v = F.col("v")
    by_value = _values(series).groupBy("series_id", "v").agg(F.count(F.lit(1)).alias("c"))
    out = by_value.groupBy("series_id").agg(
        F.sum("c").alias("n"), F.count(v).alias("unique_count"),
        F.sum(F.when(v == 0, F.col("c")).otherwise(0)).alias("zero_count"), F.sum(F.when(v == F.floor(v), F.col("c")).otherwise(0)).alias("integer_count"),
    )
    return out.select("series_id", *[x for name in ("unique", "zero", "integer") for x in (F.col(f"{name}_count"), _ratio(F.col(f"{name}_count"), F.col("n")).alias(f"{name}_ratio"))])


def _difference_stats(series: DataFrame, second: bool, rows: DataFrame | None) -> DataFrame:
    """Of d1 = v - p1, or d2 = d1 - (p1 - p2); p1 and p2 are the two finite values before v."""
    d1 = F.col("v") - F.col("p1")
    step = d1 - (F.col("p1") - F.col("p2")) if second else d1
    by_value = (near(series) if rows is None else rows).groupBy("series_id", step.alias("x")).agg(F.count(F.lit(1)).alias("c"))
    x, c = F.col("x"), F.col("c")
    unique = by_value.groupBy("series_id").agg(
        F.count(x).alias("unique_count"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x * c).alias("total"), F.sum(x * x * c).alias("squares"),
        F.sum(F.when(F.abs(x) < TINY, c).otherwise(0)).alias("zeros"),
    )
    unique = _sizes(series).join(unique, "series_id", "left")
    pairs = F.col("n") - (2 if second else 1)
    mean = _ratio(F.col("total"), pairs)
    spread = F.sqrt(F.greatest(F.lit(0.0), _ratio(F.col("squares"), pairs) - mean * mean))
    known = lambda c: F.coalesce(c, F.lit(0.0))
    return unique.select(
        "series_id", known(F.col("min")).alias("min"), known(F.col("max")).alias("max"), known(mean).alias("mean"), known(spread).alias("std_dev"), known(F.col("max") - F.col("min")).alias("range"),
        known(_ratio(F.col("zeros"), pairs)).alias("zero_ratio"), F.coalesce("unique_count", F.lit(0)).alias("unique_count"), known(_ratio(F.col("unique_count"), F.col("n"))).alias("unique_ratio"),
    )


def diff(series: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Statistics of the differences between neighbours; the deviation is a population's."""
    return _difference_stats(series, second=False, rows=rows)


def second_diff(series: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Statistics of the differences between neighbouring differences."""
    return _difference_stats(series, second=True, rows=rows)


def trend(series: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """monotonicity: (rises - falls) / (rises + falls); change_points: turns between them, flats aside."""
    rows = (near(series) if rows is None else rows).withColumn("t", F.nullif(F.signum(F.col("v") - F.col("p1")), F.lit(0.0)))
    moves = rows.where("t is not null").withColumn("before", F.lag("t").over(in_chunk()))
    chunks = moves.groupBy(*KEY).agg(
        F.sum("t").alias("net"), F.count("t").alias("moves"), F.count_if(F.col("t") != F.col("before")).alias("turns"), F.min_by("t", "pos").alias("first"), F.max_by("t", "pos").alias("last")
    )
    at_edge = F.lag("last").over(W.partitionBy("series_id").orderBy("chunk")) != F.col("first")
    chunks = chunks.withColumn("edge", F.coalesce(at_edge, F.lit(False)).cast("int"))
    out = chunks.groupBy("series_id").agg(F.sum("net").alias("net"), F.sum("moves").alias("moves"), F.sum(F.col("turns") + F.col("edge")).alias("change_points"))
    out = _sizes(series).join(out, "series_id", "left")
    return out.select("series_id", F.coalesce(_ratio(F.col("net"), F.col("moves")), F.lit(0.0)).alias("monotonicity"), F.coalesce("change_points", F.lit(0)).alias("change_points"))


def runs(series: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Runs of equal finite values. in_run_ratio leaves out single values; a series' last run never is one."""
    rows = (near(series) if rows is None else rows).withColumn("new", F.when(F.col("v") == F.col("p1"), 0).otherwise(1).cast("long"))
    lengths = running_sum(rows, "new", "run").groupBy("series_id", "run").agg(F.count(F.lit(1)).alias("length"))
    length = F.col("length")
    out = lengths.groupBy("series_id").agg(
        F.max("length").alias("max_run_length"), F.avg("length").alias("avg_run_length"), F.count(F.lit(1)).alias("run_count"),
        F.count_if(length > 1).alias("constant"), F.count_if(length == 1).alias("ones"), F.max_by("length", "run").alias("last"),
    )
    singles = F.col("ones") - (F.col("last") == 1).cast("int")
    out = out.join(_sizes(series), "series_id")
    return out.select("series_id", "max_run_length", "avg_run_length", "run_count", (F.col("constant") / F.col("run_count")).alias("constant_run_ratio"), (1 - singles / F.col("n")).alias("in_run_ratio"))


def bits(series: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Set bits, sign changes, range and mode of exponents (ties: the smallest), mantissa entropy."""
    rows = near(series) if rows is None else rows
    flip = F.coalesce((F.col("p1") < 0) != (F.col("v") < 0), F.lit(False))
    rows = rows.withColumn("flip", flip).withColumn("b", double_bits(F.col("v")))
    rows = rows.select("series_id", "flip", F.bit_count("b").alias("ones"), exponent(F.col("b")).alias("e"), mantissa(F.col("b")).alias("m"))
    cells = rows.groupBy("series_id", "e", "m").agg(F.count(F.lit(1)).alias("c"), F.sum("ones").alias("ones"), F.sum(F.col("flip").cast("int")).alias("flips"))
    by_exponent = cells.groupBy("series_id", "e").agg(F.sum("c").alias("c"), F.sum("ones").alias("ones"), F.sum("flips").alias("flips"))
    head = by_exponent.groupBy("series_id").agg(
        (F.sum("ones") / F.sum("c")).alias("avg_set_bits"), F.sum("flips").alias("sign_changes"),
        (F.max("e") - F.min("e")).cast("long").alias("exponent_range"), F.min_by("e", F.struct(-F.col("c"), "e")).cast("long").alias("common_exponent"),
    )
    return head.join(mantissa_entropy_of(cells), "series_id")


def mantissa_entropy_of(cells: DataFrame) -> DataFrame:
    counts = cells.groupBy("series_id", "m").agg(F.sum("c").alias("c"))
    return _entropy(counts).withColumnRenamed("entropy", "mantissa_entropy")


def mantissa_entropy(series: DataFrame) -> DataFrame:
    """Shannon entropy in bits of the low 52 bits of the values."""
    rows = _values(series).where(F.col("v").isNotNull()).select("series_id", mantissa(double_bits(F.col("v"))).alias("m"))
    return mantissa_entropy_of(rows.groupBy("series_id", "m").agg(F.count(F.lit(1)).alias("c")))


def _entropy(counts: DataFrame) -> DataFrame:
    """-sum p log2 p = log2 N - sum c log2 c / N, from counts c."""
    total = F.sum("c")
    return counts.groupBy("series_id").agg((F.log2(total) - F.sum(F.col("c") * F.log2("c")) / total).alias("entropy"))


def entropy(series: DataFrame) -> DataFrame:
    """Shannon entropy in bits of the histogram of BINS equal bins from min to max; 0 if all are equal."""
    rows = with_stats(_finite(series), low=F.min("v"), high=F.max("v"))
    bin_ = F.least(F.lit(BINS - 1), ((F.col("v") - F.col("low")) / ((F.col("high") - F.col("low")) / BINS)).cast("int"))
    rows = rows.withColumn("bin", F.when(F.col("high") > F.col("low"), bin_).otherwise(0))
    return _entropy(rows.groupBy("series_id", "bin").agg(F.count(F.lit(1)).alias("c")))


def _lag_sums(lags: int, size: int):
    """Of a chunk with the ``lags`` rows before it: for each lag, the sum of products and the pairs."""

    def run(table: pa.Table) -> pa.Table:
        pos, c = table["pos"].to_numpy(), table["c"].to_numpy()
        first = int(table["chunk"][0].as_py()) * size
        start = max(0, first - lags)
        x = np.full(int(pos.max()) - start + 1, np.nan)
        x[pos - start] = c
        known = np.where(np.isnan(x), 0.0, x)
        there = (~np.isnan(x)).astype(np.float64)
        own = first - start
        out = []
        for k in range(1, lags + 1):
            a = min(max(own, k), len(x))  # beyond the end, there are no pairs
            out.append((k, float(known[a:] @ known[a - k : a - k + len(x) - a]), float(there[a:] @ there[a - k : a - k + len(x) - a])))
        return pa.table({"series_id": pa.array([table["series_id"][0].as_py()] * lags, pa.string()), "lag": [k for k, _, _ in out], "s": [s for _, s, _ in out], "pairs": [p for _, _, p in out]})

    return run


def _correlations(series: DataFrame, lags: int) -> DataFrame:
    """series_id, n, variance, r (lag to mean product of centred values over the variance).

    A chunk gets the last ``lags`` rows of the one before and is one call, so a row is shuffled once,
    and the products of all lags are taken in memory instead of by as many window columns.
    """
    stats = _values(series).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))
    rows = _finite(series).join(stats.select("series_id", "mean"), "series_id").select("series_id", "pos", (F.col("v") - F.col("mean")).alias("c"))
    rows, size = chunked(rows), chunk_size()
    if lags > size:
        raise ValueError(f"lags go back over a chunk of {size} at most")
    late = F.col("pos") % size >= size - lags
    both = F.explode(F.when(late, F.array("chunk", F.col("chunk") + 1)).otherwise(F.array("chunk")))
    rows = rows.select("series_id", "pos", "c", both.alias("chunk"))
    sums = rows.groupBy("series_id", "chunk").applyInArrow(_lag_sums(lags, size), "series_id string, lag long, s double, pairs double")
    sums = sums.groupBy("series_id", "lag").agg(F.sum("s").alias("s"), F.sum("pairs").alias("pairs"))
    sums = sums.join(stats.select("series_id", "variance"), "series_id").where("variance > 0 and pairs > 0")
    r = F.map_from_entries(F.collect_list(F.struct("lag", F.col("s") / F.col("pairs") / F.col("variance"))))
    return stats.join(sums.groupBy("series_id").agg(r.alias("r")), "series_id", "left").select("series_id", "n", "variance", "r")


def _at(lag: int) -> Column:
    return F.try_element_at(F.col("r"), F.lit(lag).cast("long"))


def autocorrelation(series: DataFrame, lags: int = LAGS, correlations: DataFrame | None = None) -> DataFrame:
    """auto_correlation: lags 1..; null if there are not more values than lags or all are equal."""
    out = _correlations(series, lags) if correlations is None else correlations
    known = (F.col("n") > lags) & (F.col("variance") > 0)
    return out.select("series_id", F.when(known, F.array(*map(_at, range(1, lags + 1)))).alias("auto_correlation"))


def periodicity(series: DataFrame, most: int = MOST_LAG, correlations: DataFrame | None = None) -> DataFrame:
    """The first lag (from 2, to n / 2 and ``most``) at which the autocorrelation has a local maximum
    over 0.5, and its value; 0 and 0 if there is none or there are under 10 values."""
    out = _correlations(series, most) if correlations is None else correlations
    last = F.least(F.floor(F.col("n") / 2), F.lit(most))
    lags = F.sequence(F.lit(2).cast("long"), F.greatest(last - 1, F.lit(2)).cast("long"))
    at = lambda k: F.try_element_at(F.col("r"), k)
    peaks = F.filter(lags, lambda k: (k < last) & (at(k) > at(k - 1)) & (at(k) > at(k + 1)) & (at(k) > 0.5))
    peak = F.when(F.col("n") >= 10, F.get(peaks, F.lit(0)))
    return out.select("series_id", F.coalesce(peak, F.lit(0)).cast("long").alias("periodicity"), F.coalesce(at(peak), F.lit(0.0)).alias("periodic_score"))


def profile(series: DataFrame, *, percentiles: bool = False) -> DataFrame:
    """All families as one row a series: the flat features and the nested records.

    percentile_95 and percentile_5 are 0 unless percentiles is set, as the feature vector's trained
    order has always held zeros there.
    """
    nest = lambda df, name: df.select("series_id", F.struct(*[c for c in df.columns if c != "series_id"]).alias(name))
    tails = quantiles(series, (0.95, 0.05)).select("series_id", F.col("p95").alias("percentile_95"), F.col("p05").alias("percentile_5"))
    if not percentiles:
        tails = None
    # what several families rest on is computed once: a table of rows, and one of a row a series
    rows, _ = write_table(near(series), "neighbours")
    lags, _ = write_table(_correlations(series, MOST_LAG).coalesce(1), "correlations")
    parts = [
        basic(series), value_props(series), nest(diff(series, rows), "diff_stats"), nest(second_diff(series, rows), "second_diff_stats"), trend(series, rows),
        nest(runs(series, rows), "run_length"), nest(bits(series, rows), "bit_stats"), entropy(series), autocorrelation(series, correlations=lags), periodicity(series, correlations=lags),
    ]
    out = reduce(lambda a, b: a.join(b, "series_id", "left"), [*parts, *([tails] if tails is not None else [])])
    if tails is None:
        out = out.withColumns({"percentile_95": F.lit(0.0), "percentile_5": F.lit(0.0)})
    return out.withColumn("smoothness", F.col("second_diff_stats.std_dev"))


# The order of the feature vector.
VECTOR = (
    ["min", "max", "mean", "median", "std_dev", "variance", "skewness", "kurtosis", "range", "iqr", "q1", "q3"]
    + ["unique_count", "unique_ratio", "zero_count", "zero_ratio", "integer_count", "integer_ratio"]
    + [f"{d}.{f}" for d in ("diff_stats", "second_diff_stats") for f in ("min", "max", "mean", "std_dev", "range", "zero_ratio", "unique_count", "unique_ratio")]
    + ["monotonicity", "smoothness", "change_points"]
    + ["run_length.max_run_length", "run_length.avg_run_length", "run_length.run_count", "run_length.constant_run_ratio"]
    + ["bit_stats.avg_set_bits", "bit_stats.sign_changes", "bit_stats.mantissa_entropy", "bit_stats.exponent_range", "bit_stats.common_exponent"]
    + ["entropy", "percentile_95", "percentile_5"]
    + [f"auto_correlation[{k}]" for k in range(10)]
    + ["periodicity", "periodic_score"]
)


def flatten(profiles: DataFrame) -> DataFrame:
    """series_id, features: the 61 numbers, 0 where one is missing (a short series' autocorrelation)."""
    column = lambda name: F.get(F.col("auto_correlation"), F.lit(int(name[17:-1]))) if "[" in name else F.col(name)
    return profiles.select("series_id", F.array(*[F.coalesce(column(name).cast("double"), F.lit(0.0)) for name in VECTOR]).alias("features"))
