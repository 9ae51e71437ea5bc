"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1. Its integral is the source's weight; the
schedule's normalised integral F(t) is the part of the source's words wanted by time t. A document
starts at the c-th word of its source, in an order drawn from a hash of its id, and its training
position is the t where F(t) = c / target. Documents are then range-sorted by position.

Running totals are taken at two levels, so that no task holds a source: a source is cut into cells of
about ``rows_per_cell`` documents by the hash, cells are summed before anything is ordered, and only
the cells' totals (one row for ``rows_per_cell`` documents) are accumulated within a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, split_into, without

#: A schedule is a list of (time, weight) knots from time 0 to time 1, straight in between.
Schedule = list[tuple[float, float]]
CONSTANT_3_1_2: list[Schedule] = [[(0, 3), (1, 3)], [(0, 1), (1, 1)], [(0, 2), (1, 2)]]
#: The same weights in all: falling, rising, and highest half-way.
CURRICULUM_3_1_2: list[Schedule] = [[(0, 4), (1, 2)], [(0, 0.5), (1, 1.5)], [(0, 1), (0.5, 3), (1, 1)]]
ADDED = ["size", "source_size", "target", "start", "taken", "position"]


def area(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def invert(schedule: Schedule, part: Column) -> Column:
    """The time by which the schedule has handed out this part (0..1) of its integral."""
    whole, done, out = area(schedule), 0.0, F.lit(float(schedule[-1][0]))
    pieces = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        if t1 > t0 and w0 + w1 > 0:
            pieces.append((done, t0, w0, (w1 - w0) / (t1 - t0)))
        done += (t1 - t0) * (w0 + w1) / 2
    # The later pieces first, so that the first test that holds picks the piece.
    for before, t0, w0, slope in pieces:
        a = part * whole - before
        root = F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * a))
        at = t0 + F.when(w0 + root > 0, 2 * a / (w0 + root)).otherwise(0.0)
        out = at if before == 0 else F.when(a >= 0, at).otherwise(out)
    return out


def source_targets(sizes: DataFrame, share: float, cap: float, schedules: list[Schedule]) -> DataFrame:
    """Targets from one row a source (no_source, source_key, source_size), by water-filling.

    A target is least(cap * size, level * weight); the level is the one at which targets add up to
    share * all sizes. Sorted by cap * size / weight, the full sources come first, so running sums
    find it in one pass. One row a source goes through one task, which sorts and spills.
    """
    every = W.partitionBy(F.lit(0))
    order = every.orderBy("no_source", "source_key")
    k = len(schedules)
    ranked = sizes.withColumn("schedule", (F.row_number().over(order) - 1) % k)
    weight = F.element_at(F.array([F.lit(float(area(s))) for s in schedules]), F.col("schedule") + 1)
    most = F.col("source_size") * F.lit(float(cap))
    full_at = F.when(F.col("weight") > 0, most / F.col("weight"))
    ranked = ranked.withColumn("weight", weight).withColumn("full_at", full_at)
    by_full = every.orderBy(F.col("full_at").asc_nulls_last(), "no_source", "source_key")
    before = by_full.rowsBetween(W.unboundedPreceding, -1)
    after = by_full.rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    filled = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("source_size"))).over(before), F.lit(0)) * F.lit(float(cap))
    level = (total - filled) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", F.when(F.sum("weight").over(after) > 0, level))
    fits = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))
    ranked = ranked.withColumn("level", F.min(fits).over(every)["level"])
    target = F.when(F.col("weight") > 0, F.least(most, F.coalesce(F.col("level") * F.col("weight"), most)))
    return ranked.select("no_source", "source_key", "source_size", "schedule", F.coalesce(target, F.lit(0.0)).alias("target"))


def words_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def laid_out(docs: DataFrame, share: float, cap: float, schedules: list[Schedule], rows_per_cell: int, words: str | None = None) -> DataFrame:
    """docs' columns and mix_size, mix_source_size, mix_target, mix_schedule, mix_start and mix_taken."""
    cells = split_into(docs.count(), rows_per_cell)
    # null ids are told apart by their text, or what is known of it
    unnamed = F.concat(F.lit("null "), F.coalesce(F.sha2(F.col(words or "text").cast("string"), 256), F.lit("")))
    rows = docs.select(
        "*",
        (F.col(words).cast("long") if words else words_of()).alias("mix_size"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source_key"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), unnamed).cast("binary")).alias("mix_hash"),
    )
    head = F.conv(F.substring("mix_hash", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("mix_cell", F.shiftright(head * F.lit(cells).cast("long"), 32))
    key = ["no_source", "source_key"]
    summed = rows.groupBy(*key, "mix_cell").agg(F.sum("mix_size").alias("cell_size"))
    targets = source_targets(summed.groupBy(*key).agg(F.sum("cell_size").alias("source_size")), share, cap, schedules)
    targets = targets.select(*key, *[F.col(c).alias(f"mix_{c}") for c in ("source_size", "target", "schedule")])
    run = W.partitionBy(*key).orderBy("mix_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = summed.select(*key, "mix_cell", F.coalesce(F.sum("cell_size").over(run), F.lit(0)).alias("mix_cell_start"))
    rows = rows.join(starts.join(targets, key), [*key, "mix_cell"])
    inside = W.partitionBy(*key, "mix_cell").orderBy("mix_hash", "doc_id", "mix_size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("mix_start", F.col("mix_cell_start") + F.coalesce(F.sum("mix_size").over(inside), F.lit(0)))
    words, whole = F.floor("mix_target"), F.col("mix_source_size")
    passes = F.when(whole > 0, F.floor(words / whole)).otherwise(F.lit(0)).cast("long")
    last = F.greatest(F.lit(0), F.least(F.col("mix_size"), words - passes * whole - F.col("mix_start")))
    rows = rows.withColumn("mix_taken", (passes * F.col("mix_size") + last).cast("long"))
    return rows.drop(*key, "mix_hash", "mix_cell", "mix_cell_start")


def position(schedules: list[Schedule], word: Column) -> Column:
    """When the word-th word that the mix takes of a source is due."""
    out = F.lit(None).cast("double")
    for k, schedule in enumerate(schedules):
        out = F.when(F.col("mix_schedule") == k, invert(schedule, word / F.col("mix_target"))).otherwise(out)
    return F.when(F.col("mix_taken") > 0, out)


def by_position(mixed: DataFrame) -> DataFrame:
    """Rows range-sorted by training position: partition after partition is the order of training."""
    order = [F.col("mix_position").asc_nulls_last(), F.col("doc_id")]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


def plan_mix(docs: DataFrame, *, share: float = 1.5, cap: float = 2.0, schedules: list[Schedule] = CONSTANT_3_1_2, rows_per_cell: int = 2_000, words: str | None = None) -> DataFrame:
    """docs (doc_id, text, source, ...) with each document's part in the mix, by training position.

    Adds size (words), source_size, target (its source's, in words), start (the words of its source
    before it), taken (words the mix takes, repeats counted) and position (training time of its first
    word; null if none is taken). A source's taken words add up to its target, rounded down: at most
    one document of a source is taken in part, in the last pass over that source.

    Nulls: a null text has size 0; the null source is a source of its own, the last in order; a null
    doc_id is placed by a hash of the text. Repeated rows are mixed as separate documents. An empty table
    gives an empty result. Input columns named like an added one are replaced.

    words: a column of docs with each document's words, counted before; text isn't read then.
    """
    rows = laid_out(docs, share, cap, schedules, rows_per_cell, words).withColumn("mix_position", position(schedules, F.col("mix_start")))
    kept = without(docs, ADDED).columns
    return by_position(rows).select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"mix_{c}").alias(c) for c in ADDED])


def mix(docs: DataFrame, *, share: float = 1.5, cap: float = 2.0, schedules: list[Schedule] = CONSTANT_3_1_2, rows_per_cell: int = 2_000) -> DataFrame:
    """The mixed corpus: docs' own columns, a row for each time a document is trained on, by position.

    A document taken k times gives k rows. The one document of a source that is taken in part keeps
    its first words and the white space between them; a document that is not taken gives no row.
    Nulls, repeated rows and empty tables: see plan_mix. Columns starting with ``mix_`` are reserved.
    """
    rows = laid_out(docs, share, cap, schedules, rows_per_cell).where("mix_taken > 0")
    times = F.ceil(F.col("mix_taken") / F.col("mix_size")).cast("int")
    rows = rows.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), times - 1)))
    first = F.least(F.col("mix_size"), F.col("mix_taken") - F.col("mix_pass") * F.col("mix_size"))
    pieces = F.regexp_extract_all("text", F.lit(f"{SPACE}*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), first.cast("int")), "")
    rows = rows.withColumn("text", F.when(first < F.col("mix_size"), cut).otherwise(F.col("text")))
    due = F.col("mix_start") + F.col("mix_pass") * F.col("mix_source_size")
    return by_position(rows.withColumn("mix_position", position(schedules, due))).select([F.col(f"`{c}`") for c in docs.columns])
