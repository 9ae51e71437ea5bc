"""Series in long form, chunks that spread a long series over tasks, and segments.

A window over a whole series would put it into one task. So ordered operators work on chunks of CHUNK
positions: windows are partitioned by (series_id, chunk), each chunk is summed up in one row (its last
values, or a sum), and what a chunk needs of those before it comes from a window over these few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import remove, write_table

#: Positions of a chunk, and values of a segment.
CHUNK, SEGMENT = 100_000, 5000
KEY = ["series_id", "chunk"]
BEFORE = (W.unboundedPreceding, -1)


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_series(df: DataFrame, order: list[str | Column], value: str | Column, key: str | Column | None = None, raw: str | Column | None = None, spread: bool = True) -> DataFrame:
    """series_id, pos (from 0), value and, if given, raw, from the rows of df in the given order.

    Rows whose value is null are dropped before positions are given. key None: one series named "all".
    A series of any length is numbered without putting it into one task, at the price of a table in the
    shared folder. spread=False uses a window a series instead, for series that are known to be short.
    Rows that tie in the order are numbered in any order.
    """
    name = F.lit("all") if key is None else _column(key).cast("string")
    by = [f"order_{k}" for k in range(len(order))]
    rows = df.select(name.alias("series_id"), _column(value).cast("double").alias("value"), *([_column(raw).alias("raw")] if raw is not None else []), *[_column(o).alias(c) for o, c in zip(order, by)])
    rows = rows.where(F.col("value").isNotNull())
    if spread:
        rows = numbered(rows, by)
    else:
        rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("series_id").orderBy(*by)) - 1)
    return rows.select("series_id", F.col("pos").cast("long").alias("pos"), "value", *["raw"] * (raw is not None))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, from 0 in each series: range-sorted, numbered within partitions, and moved by the
    rows that a series has in the partitions before (a row a series and partition). The result is a table
    in the shared folder."""
    ranged = rows.repartitionByRange("series_id", *order).sortWithinPartitions("series_id", *order)
    at = F.monotonically_increasing_id()
    # written, as bounds of ranges are drawn anew when the plan runs again
    kept = [c for c in rows.columns if c not in order]
    ranged, path = write_table(ranged.select(*kept, F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "numbered")
    parts = ranged.groupBy("series_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    start = F.coalesce(F.sum("c").over(W.partitionBy("series_id").orderBy("part").rowsBetween(*BEFORE)), F.lit(0))
    moves = parts.select("series_id", "part", (start - F.col("first")).alias("move"))
    # written once more, so that those who read a series often don't join it each time
    out, _ = write_table(ranged.join(moves, ["series_id", "part"]).withColumn("pos", F.col("at") + F.col("move")).drop("part", "at", "move"), "series")
    remove(rows.sparkSession, path)
    return out


def in_chunk() -> W:
    return W.partitionBy(*KEY).orderBy("pos")


def chunk_size() -> int:
    return CHUNK


def chunked(series: DataFrame) -> DataFrame:
    return series.withColumn("chunk", F.floor(F.col("pos") / chunk_size()))


def neighbours(rows: DataFrame, value: str = "value") -> DataFrame:
    """rows (of no null value) with chunk, p1 and p2: the value before and the one before that."""
    w = in_chunk()
    rows = chunked(rows).withColumns({"in1": F.lag(value, 1).over(w), "in2": F.lag(value, 2).over(w)})
    ends = rows.groupBy(*KEY).agg(F.max_by(F.struct(F.col(value).alias("last"), F.col("in1").alias("second")), "pos").alias("end"))
    over = W.partitionBy("series_id").orderBy("chunk")
    c1, c2 = F.lag("end.last", 1).over(over), F.coalesce(F.lag("end.second", 1).over(over), F.lag("end.last", 2).over(over))
    rows = rows.join(ends.select(*KEY, c1.alias("c1"), c2.alias("c2")), KEY)
    p1 = F.coalesce("in1", "c1")
    p2 = F.coalesce("in2", F.when(F.col("in1").isNull(), F.col("c2")).otherwise(F.col("c1")))
    return rows.withColumns({"p1": p1, "p2": p2}).drop("in1", "in2", "c1", "c2")


def running_sum(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows (with chunk) and the sum of column up to and with each row of a series."""
    w = in_chunk().rowsBetween(W.unboundedPreceding, 0)
    sums = rows.groupBy(*KEY).agg(F.sum(column).alias("s"))
    start = F.coalesce(F.sum("s").over(W.partitionBy("series_id").orderBy("chunk").rowsBetween(*BEFORE)), F.lit(0).cast(rows.schema[column].dataType))
    rows = rows.withColumn(out, F.sum(column).over(w)).join(sums.select(*KEY, start.alias("start_sum")), KEY)
    return rows.withColumn(out, F.col(out) + F.col("start_sum")).drop("start_sum")


def with_stats(series: DataFrame, **stats: Column) -> DataFrame:
    """series with aggregates of each whole series: summed up first, then joined, not a window."""
    return series.join(series.groupBy("series_id").agg(*[c.alias(n) for n, c in stats.items()]), "series_id")


def finite(value: str = "value") -> Column:
    v = F.col(value)
    return ~F.isnan(v) & (F.abs(v) != float("inf"))


def segmented(series: DataFrame, size: int = SEGMENT, keep_rest: bool = False) -> DataFrame:
    """series with segment_id; the incomplete segment at a series' end is dropped unless keep_rest."""
    rows = series.withColumn("segment_id", F.floor(F.col("pos") / size))
    if keep_rest:
        return rows
    # the last position decides, so that rows aren't counted by segment
    rows = with_stats(rows, last_pos=F.max("pos"))
    return rows.where((F.col("segment_id") + 1) * size <= F.col("last_pos") + 1).drop("last_pos")


def packed(series: DataFrame, size: int = SEGMENT, keep_rest: bool = True) -> DataFrame:
    """series_id, segment_id, n, values: a row for each segment, its values in order.

    Segments are grouped by (series_id, segment_id), so a long series is spread over tasks.
    """
    rows = series.withColumn("segment_id", F.floor(F.col("pos") / size))
    pairs = F.array_sort(F.collect_list(F.struct("pos", "value")))
    out = rows.groupBy("series_id", "segment_id").agg(pairs.alias("pairs"))
    out = out.select("series_id", "segment_id", F.size("pairs").alias("n"), F.col("pairs.value").alias("values"))
    return out if keep_rest else out.where(F.col("n") == size)


def unpacked(segments: DataFrame, size: int = SEGMENT) -> DataFrame:
    rows = segments.select("series_id", "segment_id", F.posexplode("values").alias("at", "value"))
    return rows.select("series_id", (F.col("segment_id") * size + F.col("at")).alias("pos"), "value")
