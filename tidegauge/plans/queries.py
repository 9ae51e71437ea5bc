"""The series queries. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import CODECS
from ..functions.bits import double_bits, leading_zeros, reverse_bits, trailing_zeros
from ..functions.decimals import bits_of_decimals, significant_digits, text_decimals
from ..functions.floats import decimal_fraction, fraction_part, split_exponent, split_mantissa, whole_part
from ..operators import constraints as cons
from ..operators import encoding as enc
from ..operators import profile as prof
from ..operators import transforms as xf
from ..operators.series import packed, segmented, to_series
from ..sources import sinks
from . import file_queries

Query = Callable[[SparkSession, str], DataFrame]
#: Values of a segment in the codec queries.
SMALL = 1000
#: An order in which no two lines tie that differ in a value: line numbers repeat within an order.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event values, a series an event type, in order of time."""
    return to_series(table(spark, sf_dir, "events"), ["ts", "event_id"], "value", "event_type")


def prices(spark: SparkSession, sf_dir: str, raw: bool = False) -> DataFrame:
    """order totals, a series an order status, in order of the order's key."""
    text = F.col("o_totalprice").cast("decimal(20,4)").cast("string")
    return to_series(table(spark, sf_dir, "orders"), ["o_orderkey"], "o_totalprice", "o_orderstatus", raw=text if raw else None)


def lines(column: str | Column) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return to_series(table(spark, sf_dir, "lineitem"), LINE_ORDER, column, "l_returnflag")

    return run


def sparse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(F.when(F.col("l_discount") == 0.1, F.col("l_tax")).otherwise(0.0))(spark, sf_dir)


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order keys in order: a rising series of whole numbers."""
    return to_series(table(spark, sf_dir, "orders"), ["o_orderkey"], F.col("o_orderkey").cast("double"))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a period of 12 orders, with a peak in each."""
    return keys(spark, sf_dir).withColumn("value", F.pmod("pos", F.lit(12)).cast("double"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums of doubles depend on their order."""
    return df.select(*[F.round(F.col(c) + 0.0, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def over(source: Query, operator: Callable[[DataFrame], DataFrame], digits: int = 6) -> Query:
    return lambda spark, sf_dir: rounded(operator(source(spark, sf_dir)), digits)


def correlations(series: DataFrame) -> DataFrame:
    out = prof.autocorrelation(series)
    return out.select("series_id", *[F.get("auto_correlation", F.lit(k)).alias(f"r{k + 1}") for k in range(prof.LAGS)])


def recovered(forward: Callable[[DataFrame], DataFrame], back: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda series: back(forward(series)).select("series_id", "pos", "value")


def enumerated(series: DataFrame) -> DataFrame:
    return series.transform(lambda s: xf.enum_index(s, cons.enumeration(s)))


def enum_sizes(series: DataFrame) -> DataFrame:
    """The enumeration as text, in order of first appearance."""
    return cons.enumeration(series).select("series_id", F.array_join(F.transform("enumeration", lambda v: F.format_string("%.2f", v)), " ").alias("enumeration"))


def vector(series: DataFrame) -> DataFrame:
    """The feature vector, a row a feature."""
    return prof.flatten(prof.profile(series)).select("series_id", F.posexplode("features").alias("k", "value")).withColumn("k", F.col("k").cast("long"))


def detected(series: DataFrame, use_text: bool = False) -> DataFrame:
    """All constraints of a series as one row, the enumeration as text."""
    names = ["precision", "min_value", "max_value", "monotonicity", "allow_positive", "allow_negative", "sign", "discrete_step", "zero_ratio", "sparse"]
    text = F.array_join(F.transform("enumeration", lambda v: F.format_string("%.2f", v)), " ")
    return cons.detect(series, use_text).select("series_id", text.alias("enumeration"), *names)


def precisions(series: DataFrame) -> DataFrame:
    out = cons.precision(series, use_text=True)
    return out.select("series_id", "precision", F.to_json("precision_distribution").alias("precision_distribution"))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals against constraints of the first half of each series, stated in whole numbers."""
    series = prices(spark, sf_dir, raw=True)
    rows = series.groupBy("series_id").agg(F.max("pos").alias("last"), F.lit(1).cast("int").alias("precision"), F.lit(True).alias("sign"))
    low_high = series.groupBy("series_id").agg(F.percentile("value", F.lit(0.05)).alias("min_value"), F.percentile("value", F.lit(0.95)).alias("max_value"))
    known = rows.join(low_high, "series_id").select(
        "series_id", "precision", "min_value", "max_value", F.lit(None).cast("array<double>").alias("enumeration"), F.lit(1).alias("monotonicity"), F.lit(True).alias("allow_positive"),
        F.lit(False).alias("allow_negative"), "sign", F.lit(0.0).alias("discrete_step"), F.lit(True).alias("sparse"),
    )
    return rounded(cons.validate(series, known).select("series_id", "pos", "value", "constraint_type"))


def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cons.precision_report(prices(spark, sf_dir, raw=True), use_text=True))


def decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prices(spark, sf_dir, raw=True)
    return rows.select("series_id", "pos", text_decimals(F.col("raw")).cast("long").alias("places"))


def counted_segments(series: DataFrame) -> DataFrame:
    return segmented(series, SMALL).groupBy("series_id", "segment_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def round_trips(codec: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return enc.round_trip(packed(events(spark, sf_dir), SMALL), codec).select("series_id", "segment_id", "n", "round_trip_ok")

    return run


def chosen_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = packed(events(spark, sf_dir), SMALL)
    back = enc.decode_chosen(enc.encode_chosen(segments, enc.best_combo(segments))).withColumnRenamed("values", "back")
    rows = segments.join(back.drop("n"), ["series_id", "segment_id"])
    return rows.select("series_id", "segment_id", "n", enc.same_bits("values", "back").alias("round_trip_ok"))


def float_parts(series: DataFrame) -> DataFrame:
    v = F.col("value")
    return series.select("series_id", "pos", split_mantissa(v).alias("mantissa"), split_exponent(v).alias("exponent"), whole_part(v).alias("whole"), fraction_part(v).alias("fraction"))


def decimal_fractions(series: DataFrame) -> DataFrame:
    return series.select("series_id", "pos", "value", decimal_fraction(F.col("value")).alias("rewritten"))


def bit_counts(series: DataFrame) -> DataFrame:
    b = F.col("b")
    rows = series.select("series_id", "pos", double_bits(F.col("value")).alias("b"))
    return rows.select("series_id", "pos", leading_zeros(b).cast("int").alias("leading"), trailing_zeros(b).cast("int").alias("trailing"), reverse_bits(b).alias("reversed"))


def digit_counts(series: DataFrame) -> DataFrame:
    rows = series.select("series_id", "pos", significant_digits(F.col("value")).alias("d"))
    return rows.select("series_id", "pos", "d.alpha", "d.beta", "d.beta_star", bits_of_decimals(F.col("d.alpha")).alias("fraction_bits"))


def nearest(series: DataFrame) -> DataFrame:
    """Values against a given enumeration that lacks most of them: every tenth, as they are first seen."""
    firsts = series.where("value % 10 = 5").groupBy("series_id", "value").agg(F.min("pos").alias("first"))
    pairs = F.array_sort(F.collect_list(F.struct("first", "value")))
    return xf.enum_index(series, firsts.groupBy("series_id").agg(pairs["value"].alias("enumeration")))


def falling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_series(table(spark, sf_dir, "orders"), ["o_orderkey"], -F.col("o_orderkey").cast("double"))


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line quantities less 25: of both signs."""
    return lines(F.col("l_quantity") - 25)(spark, sf_dir)


def against(name: str, **values: object) -> Callable[[DataFrame], DataFrame]:
    """Anomalies against one constraint."""
    return lambda series: cons.validate(series, cons.with_constraint(cons.unconstrained(series), name, **values)).select("series_id", "pos", "value", "constraint_type")


def relaxed(series: DataFrame) -> DataFrame:
    """Anomalies against what was detected of the unshifted half, less its range and enumeration."""
    known = cons.with_constraint(cons.detect(series.where("value > 0")), "monotonicity", monotonicity=1)
    for name in ("range", "enumeration", "discrete", "sparse", "precision"):
        known = cons.disable(known, name)
    return cons.validate(series, known).select("series_id", "pos", "value", "constraint_type")


def flags(series: DataFrame) -> DataFrame:
    known = cons.disable(cons.detect(series), "range")
    return known.select("series_id", *[cons.is_enabled(name).alias(name) for name in cons.IDS], cons.any_enabled().alias("any"))


def anomaly_lines(series: DataFrame) -> DataFrame:
    known = cons.with_constraint(cons.unconstrained(series), "sign", allow_negative=False)
    known = cons.with_constraint(known, "range", min_value=-20, max_value=20)
    return cons.anomaly_report(cons.validate(series, known))


QUERIES: dict[str, Query] = {
    "profile_basic": over(events, prof.basic),
    "profile_quantiles": over(events, prof.quantiles),
    "profile_value_props": over(lines("l_discount"), prof.value_props),
    "profile_diff": over(events, prof.diff),
    "profile_second_diff": over(events, prof.second_diff),
    "profile_trend": over(lines("l_quantity"), prof.trend),
    "profile_runs": over(lines("l_discount"), prof.runs),
    "profile_bits": over(events, prof.bits),
    "profile_entropy": over(events, prof.entropy),
    "profile_mantissa_entropy": over(lines("l_quantity"), prof.mantissa_entropy),
    "profile_autocorr": over(events, correlations),
    "profile_periodicity": over(waves, prof.periodicity),
    "profile_vector": over(events, vector),
    "xf_delta": over(events, xf.delta),
    "xf_delta_recover": over(keys, recovered(xf.delta, xf.delta_recover)),
    "xf_delta2": over(events, xf.delta2),
    "xf_delta2_recover": over(keys, recovered(xf.delta2, xf.delta2_recover)),
    "xf_ranged": over(events, xf.ranged),
    "xf_ranged_recover": over(events, recovered(xf.ranged, xf.ranged_recover)),
    "xf_log": over(events, xf.logged),
    "xf_log_recover": over(events, recovered(xf.logged, xf.logged_recover)),
    "xf_minmax": over(events, xf.minmax),
    "xf_minmax_recover": over(events, recovered(xf.minmax, xf.minmax_recover)),
    "xf_zscore": over(events, xf.zscore),
    "xf_zscore_recover": over(events, recovered(xf.zscore, xf.zscore_recover)),
    "xf_precision": over(events, lambda s: xf.precision(s, 1)),
    "xf_precision_round": over(events, lambda s: xf.precision(s, 1, rounded=True)),
    "xf_discrete": over(lines("l_quantity"), lambda s: xf.discrete(s, 1.0)),
    "xf_discrete_recover": over(lines("l_quantity"), recovered(lambda s: xf.discrete(s, 1.0), lambda s: xf.discrete_recover(s, 1.0))),
    "xf_enum_index": over(lines("l_quantity"), enumerated),
    "xf_enum_recover": over(lines("l_quantity"), lambda s: xf.enum_recover(enumerated(s), cons.enumeration(s))),
    "xf_steps": over(keys, xf.steps),
    "xf_identity": over(events, xf.identity),
    "xf_precision_recover": over(events, recovered(lambda s: xf.precision(s, 1, rounded=True), lambda s: xf.precision_recover(s, 1))),
    "xf_less_min": over(events, lambda s: xf.less_min(s, 5.0)),
    "xf_less_min_recover": over(events, recovered(lambda s: xf.less_min(s, 5.0), lambda s: xf.plus_min(s, 5.0))),
    "xf_steps_recover": over(keys, recovered(xf.steps, lambda s: xf.steps_recover(s, 100.0))),
    "xf_steps_falling": over(falling, lambda s: xf.steps(s, falling=True)),
    "xf_enum_nearest": over(lines("l_quantity"), nearest),
    "cons_range": over(prices, cons.value_range),
    "cons_precision": over(lambda spark, sf_dir: prices(spark, sf_dir, raw=True), precisions),
    "cons_enum": over(lines("l_discount"), enum_sizes),
    "cons_monotonic": over(keys, cons.monotonicity),
    "cons_sign": over(prices, cons.sign),
    "cons_discrete_min": over(lines("l_quantity"), cons.discrete_min),
    "cons_discrete_mode": over(keys, cons.discrete_mode),
    "cons_sparse": over(sparse_lines, cons.sparse),
    "cons_validate": validated,
    "cons_detect": over(lines("l_quantity"), detected),
    "cons_detect_text": over(lambda spark, sf_dir: prices(spark, sf_dir, raw=True), lambda s: detected(s, use_text=True)),
    "cons_validate_enum": over(lines("l_quantity"), against("enumeration", enumeration=[float(k) for k in range(1, 41)])),
    "cons_validate_sign": over(shifted, against("sign", allow_negative=False)),
    "cons_validate_step": over(lines("l_quantity"), against("discrete", discrete_step=2.0)),
    "cons_validate_falling": over(falling, against("monotonicity", monotonicity=1)),
    "cons_validate_relaxed": over(shifted, relaxed),
    "cons_flags": over(lines("l_quantity"), flags),
    "cons_anomalies": over(shifted, anomaly_lines),
    "precision_distribution": distribution,
    "text_decimals": decimals,
    "rle_encode": over(lines("l_discount"), enc.rle),
    "rle_decode": over(lines("l_discount"), lambda s: enc.rle_decode(enc.rle(s))),
    "freq_value": over(lines("l_quantity"), enc.value_frequencies),
    "freq_byte": over(lines("l_quantity"), enc.byte_frequencies),
    "bits_adjacent": lambda spark, sf_dir: enc.adjacent_bits(events(spark, sf_dir)),
    "bits_text": lambda spark, sf_dir: sinks.bit_dump(events(spark, sf_dir)),
    "bit_counts": lambda spark, sf_dir: bit_counts(events(spark, sf_dir)),
    "digit_counts": lambda spark, sf_dir: digit_counts(events(spark, sf_dir)),
    "bit_costs": lambda spark, sf_dir: enc.bit_costs(packed(events(spark, sf_dir), SMALL)),
    "erased_bits": lambda spark, sf_dir: enc.erased_bits(packed(events(spark, sf_dir), SMALL)),
    "float_parts": lambda spark, sf_dir: float_parts(events(spark, sf_dir)),
    "decimal_fractions": lambda spark, sf_dir: decimal_fractions(events(spark, sf_dir)),
    "segment_tumbling": over(events, counted_segments),
    "codec_ratio": lambda spark, sf_dir: enc.ratios(packed(events(spark, sf_dir), SMALL), list(CODECS)),
    "best_combo": lambda spark, sf_dir: enc.best_combo(packed(events(spark, sf_dir), SMALL)),
    "codec_roundtrip_chosen": chosen_round_trip,
    **{f"codec_roundtrip_{name}": round_trips(name) for name in CODECS},
    **file_queries.QUERIES,
}
