"""Constraints of series: detection, and validation against them.

Detection is a few aggregates a series, over rows that know their neighbours; validation joins each series' one row
of constraints back and tests a row by the first check that fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.decimals import text_decimals, value_decimals
from ..storage import write_table
from .series import neighbours, with_stats

# Ids of the constraints, and the limits of their rules.
IDS = {"precision": 0, "range": 1, "enumeration": 2, "monotonicity": 3, "sign": 4, "discrete": 5, "sparse": 6}
TINY, SAME_STEP, MOST_PRECISION, LONG_PRECISION, OUTLIERS, SPARSE = 1e-10, 10, 8, 10, 0.05, 0.9


def precision_counts(series: DataFrame, use_text: bool) -> DataFrame:
    """series_id, places, c: rows by their number of decimals."""
    places = text_decimals(F.col("raw")) if use_text else value_decimals(F.col("value"))
    return series.select("series_id", places.alias("places")).groupBy("series_id", "places").agg(F.count(F.lit(1)).alias("c"))


def precision(series: DataFrame, use_text: bool = False) -> DataFrame:
    """precision (-1: none) and precision_distribution (places to rows).

    Where the most decimals are LONG_PRECISION or more, the fewest from 15 down are taken that more
    than OUTLIERS of the rows reach.
    """
    counts = precision_counts(series, use_text).where("places is not null")
    down = W.partitionBy("series_id").orderBy(F.col("places").desc()).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy("series_id")
    # the walk down starts below 16
    within = F.when(F.col("places") <= 15, F.col("c")).otherwise(0)
    rows = counts.withColumns({"reach": F.sum(within).over(down), "total": F.sum("c").over(every)})
    enough = (F.col("reach") > F.floor(F.col("total") * OUTLIERS)) & (F.col("places") <= 15)
    out = rows.groupBy("series_id").agg(F.max("places").alias("most"), F.max(F.when(enough, F.col("places"))).alias("usual"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("places", "c")))).alias("precision_distribution"))
    chosen = F.when(F.col("most") >= LONG_PRECISION, F.coalesce("usual", F.col("most"))).otherwise(F.col("most"))
    return out.select("series_id", F.when(chosen <= MOST_PRECISION, chosen).otherwise(-1).cast("int").alias("precision"), "precision_distribution")


def value_range(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def enumeration(series: DataFrame) -> DataFrame:
    """The distinct values in order of first appearance, if at most 1 in 100 rows (or one) is distinct.

    Distinct values are counted before any are gathered: only enumerations are collected.
    """
    firsts = series.groupBy("series_id", "value").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("c"))
    sizes = firsts.groupBy("series_id").agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("n"))
    few = sizes.where(F.col("kinds") <= F.greatest(F.lit(1), F.floor(F.col("n") / 100)))
    pairs = F.array_sort(F.collect_list(F.struct("first", "value")))
    return firsts.join(few, "series_id").groupBy("series_id").agg(pairs["value"].alias("enumeration"))


def _moves(series: DataFrame) -> DataFrame:
    return neighbours(series).withColumn("d", F.col("value") - F.col("p1"))


def monotonicity(series: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """2 strictly rising (also a series of one value), 1 rising, -2 strictly falling, -1 falling, 0 none."""
    d = F.col("d")
    out = (_moves(series) if moves is None else moves).groupBy("series_id").agg(F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"), F.count(d).alias("n"))
    up, down, n = F.col("up"), F.col("down"), F.col("n")
    code = F.when(up == n, 2).when(down == n, -2).when(down == 0, 1).when(up == 0, -1).otherwise(0)
    return out.select("series_id", code.cast("int").alias("monotonicity"))


def sign(series: DataFrame, use_text: bool = False) -> DataFrame:
    """allow_positive, allow_negative, sign: whether it constrains.

    Without texts it does when a sign is missing; with texts, when any value isn't zero.
    """
    v = F.col("value")
    out = series.groupBy("series_id").agg(F.coalesce(F.bool_or(v > 0), F.lit(False)).alias("allow_positive"), F.coalesce(F.bool_or(v < 0), F.lit(False)).alias("allow_negative"))
    pos, neg = F.col("allow_positive"), F.col("allow_negative")
    return out.select("series_id", "allow_positive", "allow_negative", ((pos | neg) if use_text else ~(pos & neg)).alias("sign"))


def step_counts(series: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """series_id, step, c, n, low, high, least: sizes of moves (and the least), alike when they round to the same SAME_STEP digits."""
    size = F.abs(F.col("d"))
    rows = (_moves(series) if moves is None else moves).withColumn("step", F.when(size >= TINY, F.round(size, SAME_STEP)))
    steps = rows.groupBy("series_id", "step").agg(F.count(F.lit(1)).alias("c"), F.min("value").alias("low"), F.max("value").alias("high"))
    # a series may have as many steps as rows: summed up and joined, not a window
    every = steps.groupBy("series_id").agg(F.sum("c").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("step").alias("least"))
    return steps.drop("low", "high").join(every, "series_id")


def discrete_min(series: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """discrete_step by the smallest move: 0 unless all moves are multiples of it, or one or two are all."""
    rows = step_counts(series, moves)
    ratio = F.col("step") / F.col("least")
    odd = F.abs(ratio - F.floor(ratio + 0.5)) > TINY
    out = rows.groupBy("series_id").agg(F.max("least").alias("least"), F.count("step").alias("kinds"), F.count_if(odd).alias("odd"), F.max("n").alias("n"), F.max(F.col("high") - F.col("low")).alias("range"))
    fits = ((F.col("odd") == 0) & (F.col("kinds") > 1)) | ((F.col("kinds") <= 2) & (F.col("kinds") < F.floor(F.col("n") / 5)))
    holds = (F.col("range") > 0) & (F.col("least") > F.col("range") / 10000) & fits
    return out.select("series_id", F.when(holds, F.col("least")).otherwise(0.0).alias("discrete_step"))


def discrete_mode(series: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """discrete_step by the commonest move (ties: the smallest): 0 unless over half of the rows make it."""
    rows = step_counts(series, moves)
    best = F.max(F.when(F.col("step").isNotNull(), F.struct("c", (-F.col("step")).alias("less"))))
    out = rows.groupBy("series_id").agg(best.alias("best"), F.max("n").alias("n"))
    holds = F.col("best.c") > F.floor(F.col("n") / 2)
    return out.select("series_id", F.when(holds, -F.col("best.less")).otherwise(0.0).alias("discrete_step"))


def sparse(series: DataFrame) -> DataFrame:
    out = series.groupBy("series_id").agg((F.count_if(F.col("value") == 0) / F.count(F.lit(1))).alias("zero_ratio"))
    return out.select("series_id", "zero_ratio", (F.col("zero_ratio") >= SPARSE).alias("sparse"))


def detect(series: DataFrame, use_text: bool = False) -> DataFrame:
    """All constraints of each series as one row. use_text: series has raw, the values' texts."""
    moves, _ = write_table(_moves(series).select("series_id", "value", "d"), "moves")
    out = value_range(series)
    for part in (precision(series, use_text), enumeration(series), monotonicity(series, moves), sign(series, use_text), discrete_mode(series, moves) if use_text else discrete_min(series, moves), sparse(series)):
        out = out.join(part, "series_id", "left")
    return out.withColumns({"precision": F.coalesce("precision", F.lit(-1)), "enabled": F.array(*enabled())})


def enabled() -> list[Column]:
    return [F.col("precision") >= 0, F.col("min_value").isNotNull(), F.col("enumeration").isNotNull(), F.col("monotonicity") != 0, F.col("sign"), F.col("discrete_step") > 0, F.col("sparse")]


# A constraint's columns, and what they are where nothing is constrained.
FREE = {
    "precision": {"precision": "-1"}, "range": {"min_value": "cast(null as double)", "max_value": "cast(null as double)"}, "enumeration": {"enumeration": "cast(null as array<double>)"},
    "monotonicity": {"monotonicity": "0"}, "sign": {"allow_positive": "true", "allow_negative": "true", "sign": "false"}, "discrete": {"discrete_step": "0.0D"}, "sparse": {"zero_ratio": "0.0D", "sparse": "false"},
}


def unconstrained(series: DataFrame) -> DataFrame:
    """A row a series with no constraint enabled."""
    free = {c: F.expr(x) for columns in FREE.values() for c, x in columns.items()}
    return series.select("series_id").distinct().withColumns({**free, "enabled": F.array(*[F.lit(False)] * len(IDS))})


def _flagged(constraints: DataFrame, name: str, on: bool) -> DataFrame:
    return constraints.withColumn("enabled", F.transform("enabled", lambda flag, k: F.when(k == IDS[name], F.lit(on)).otherwise(flag)))


def enable(constraints: DataFrame, name: str) -> DataFrame:
    """The constraint (see IDS) is enabled, with the values that its columns have."""
    return _flagged(constraints, name, True)


def disable(constraints: DataFrame, name: str) -> DataFrame:
    """The constraint is no longer checked; its columns keep their values."""
    return _flagged(constraints, name, False)


def with_constraint(constraints: DataFrame, name: str, **values: object) -> DataFrame:
    """The constraint is enabled with these values of its columns (see FREE), for every series."""
    if unknown := values.keys() - FREE[name].keys():
        raise ValueError(f"{name} has no {sorted(unknown)}")
    flags = {c: F.lit(True) for c in ("sign", "sparse") if c == name}
    kinds = dict(constraints.dtypes)
    told = {c: F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v) for c, v in values.items()}
    return enable(constraints.withColumns({c: x.cast(kinds[c]) for c, x in (told | flags).items()}), name)


def is_enabled(name: str) -> Column:
    return F.get("enabled", F.lit(IDS[name]))


def any_enabled() -> Column:
    return F.exists("enabled", lambda flag: flag)


def checked(constraints: DataFrame) -> DataFrame:
    """constraints with the columns of those that aren't enabled as if nothing were constrained."""
    if "enabled" not in constraints.columns:
        return constraints
    return constraints.withColumns({c: F.when(is_enabled(name), F.col(c)).otherwise(F.expr(x)) for name, columns in FREE.items() for c, x in columns.items()})


def validate(series: DataFrame, constraints: DataFrame) -> DataFrame:
    """Anomalies: series_id, pos, value, constraint_type (see IDS), reason; at most one a row.

    Only enabled constraints are checked, where there are flags. Checks go in the order range, precision (if series has raw), enumeration, monotonicity against the
    value before, sign, discrete. A series that is constrained to be sparse and isn't gives one row more,
    with pos -1 and the share of zeros as its value.
    """
    constraints = checked(constraints)
    rows = with_stats(neighbours(series).withColumnRenamed("p1", "before").drop("p2", "chunk"), base=F.min("value"))
    names = ["precision", "min_value", "max_value", "enumeration", "monotonicity", "allow_positive", "allow_negative", "sign", "discrete_step", "sparse"]
    rows = rows.join(constraints.select("series_id", *[F.col(c).alias(f"k_{c}") for c in names]), "series_id")
    v, b, k = F.col("value"), F.col("before"), lambda c: F.col(f"k_{c}")
    places = text_decimals(F.col("raw")) if "raw" in series.columns else F.lit(None).cast("int")
    mono = k("monotonicity")
    broken = ((mono == 1) & (v < b)) | ((mono == -1) & (v > b)) | ((mono == 2) & (v <= b)) | ((mono == -2) & (v >= b))
    steps = F.abs(v - F.col("base")) / k("discrete_step")
    checks = [
        ("range", (v < k("min_value")) | (v > k("max_value")), F.format_string("out of range [%.6f, %.6f]", k("min_value"), k("max_value"))),
        ("precision", (k("precision") >= 0) & (places > k("precision")), F.format_string("%d decimals, at most %d expected", places, k("precision"))),
        ("enumeration", k("enumeration").isNotNull() & ~F.array_contains(k("enumeration"), v), F.lit("not in the enumeration")),
        ("monotonicity", broken, F.format_string("breaks monotonicity (before %.6f, now %.6f)", b, v)),
        ("sign", k("sign") & (((v > 0) & ~k("allow_positive")) | ((v < 0) & ~k("allow_negative"))), F.when(v > 0, "positive values not allowed").otherwise("negative values not allowed")),
        ("discrete", (k("discrete_step") > 0) & b.isNotNull() & (F.abs(steps - F.floor(steps + 0.5)) > 1e-9), F.format_string("not a multiple of step %.6f", k("discrete_step"))),
    ]
    kind, reason = F.lit(None).cast("int"), F.lit(None).cast("string")
    for name, fails, text in reversed(checks):
        fails = F.coalesce(fails, F.lit(False))
        kind, reason = F.when(fails, IDS[name]).otherwise(kind), F.when(fails, text).otherwise(reason)
    found = rows.select("series_id", "pos", "value", kind.alias("constraint_type"), reason.alias("reason")).where("constraint_type is not null")
    ratios = series.groupBy("series_id").agg((F.count_if(F.col("value") == 0) / F.count(F.lit(1))).alias("value"))
    thin = ratios.join(constraints.where("sparse").select("series_id"), "series_id").where(F.col("value") < SPARSE)
    thin = thin.select("series_id", F.lit(-1).cast("long").alias("pos"), "value", F.lit(IDS["sparse"]).alias("constraint_type"), F.format_string("only %.2f%% zeros, 90%% expected", F.col("value") * 100).alias("reason"))
    return found.unionByName(thin)


def report(constraints: DataFrame) -> DataFrame:
    """series_id, line: the constraints that hold, a text a line."""
    on = enabled()
    lines = [
        F.when(on[0], F.format_string("precision: %d decimals", F.col("precision"))), F.when(on[1], F.format_string("range: [%.6f, %.6f]", F.col("min_value"), F.col("max_value"))),
        F.when(on[2], F.concat(F.lit("enumeration: "), F.to_json("enumeration"))), F.when(on[3], F.format_string("monotonicity: %d", F.col("monotonicity"))),
        F.when(on[4], F.format_string("sign: positive %s, negative %s", F.col("allow_positive").cast("string"), F.col("allow_negative").cast("string"))),
        F.when(on[5], F.format_string("discrete: step %.6f", F.col("discrete_step"))), F.when(on[6], F.format_string("sparse: %.2f%% zeros", F.col("zero_ratio") * 100)),
    ]
    return constraints.select("series_id", F.explode(F.array_compact(F.array(*lines))).alias("line"))


def precision_report(series: DataFrame, use_text: bool = False) -> DataFrame:
    """series_id, places, c, percent: rows by their number of decimals, with their share."""
    counts = precision_counts(series, use_text)
    return counts.withColumn("percent", 100 * F.col("c") / F.sum("c").over(W.partitionBy("series_id")))


def anomaly_report(anomalies: DataFrame) -> DataFrame:
    """line: the anomalies as text, with the constraint's name."""
    name = F.element_at(F.create_map(*[F.lit(x) for n, k in IDS.items() for x in (k, n)]), F.col("constraint_type"))
    return anomalies.select("series_id", "pos", F.format_string("[%s] %d: %.6f (%s)", name, F.col("pos"), F.col("value"), F.col("reason")).alias("line"))
