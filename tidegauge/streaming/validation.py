"""Validation of a stream of values against stored constraints.

Each micro-batch is validated as a series is, and the last value of each series is kept as state, so that
monotonicity and discrete steps go on from one batch to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import constraints as cons

FIELDS = "series_id string, pos long, value double, constraint_type int"


def read_series(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of series_id, pos, value from Parquet files that arrive in a folder."""
    reader = spark.readStream.schema("series_id string, pos long, value double")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def broken_orders(stream: DataFrame, constraints: DataFrame) -> DataFrame:
    """series_id, pos, value, constraint_type of the values that break their series' monotonicity.

    stream has series_id, pos, value; values of a series are taken in order of pos within a micro-batch,
    and the first is held against the last of the batches before. constraints (one row a series, see
    constraints.detect) is a static table. A series without constraints gives nothing.
    """
    known = constraints.where("monotonicity != 0").select("series_id", "monotonicity")
    rows = stream.join(known, "series_id")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values("pos")
        last = state.get[0] if state.exists else None
        before = rows["value"].shift()
        before.iloc[0] = last
        v, code = rows["value"], int(rows["monotonicity"].iloc[0])
        broken = {1: v < before, -1: v > before, 2: v <= before, -2: v >= before}[code] & before.notna()
        state.update((float(v.iloc[-1]),))
        found = rows[broken]
        yield pd.DataFrame({"series_id": found["series_id"], "pos": found["pos"], "value": found["value"], "constraint_type": cons.IDS["monotonicity"]})

    grouped = rows.groupBy("series_id")
    return grouped.applyInPandasWithState(run, FIELDS, "last double", "append", GroupStateTimeout.NoTimeout)


def broken_values(stream: DataFrame, constraints: DataFrame) -> DataFrame:
    """series_id, pos, value, constraint_type by the checks that need no other value: range, enumeration,
    sign and discrete step (from the constraints' own minimum); the first that fails counts."""
    names = ["min_value", "max_value", "enumeration", "allow_positive", "allow_negative", "sign", "discrete_step"]
    rows = stream.join(constraints.select("series_id", *names), "series_id")
    v, step = F.col("value"), F.col("discrete_step")
    steps = F.abs(v - F.col("min_value")) / step
    checks = [
        ("range", (v < F.col("min_value")) | (v > F.col("max_value"))),
        ("enumeration", F.col("enumeration").isNotNull() & ~F.array_contains("enumeration", v)),
        ("sign", F.col("sign") & (((v > 0) & ~F.col("allow_positive")) | ((v < 0) & ~F.col("allow_negative")))),
        ("discrete", (step > 0) & (F.abs(steps - F.floor(steps + 0.5)) > 1e-9)),
    ]
    kind = F.lit(None).cast("int")
    for name, fails in reversed(checks):
        kind = F.when(F.coalesce(fails, F.lit(False)), cons.IDS[name]).otherwise(kind)
    return rows.select("series_id", "pos", "value", kind.alias("constraint_type")).where("constraint_type is not null")


def windowed_profile(stream: DataFrame, *, time: str = "ts", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """series_id, window start and end, n, min, max, mean and variance of each tumbling window of time.

    Values that come more than ``late`` behind the newest are left out, as their window is closed.
    """
    rows = stream.withWatermark(time, late).groupBy("series_id", F.window(time, every).alias("w"))
    v = F.col("value")
    out = rows.agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"))
    return out.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "min", "max", "mean", "variance")
