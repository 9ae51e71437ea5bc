"""What the corpus operators share: tables, the shared folder, column names, keys, hot groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path, remove, shared_dir, write_table

__all__ = ["new_path", "remove", "shared_dir", "write_table"]

#: The six ASCII white-space characters, and a word: a longest run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns named like one of names, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


#: Rows of text that Python holds at once.
SLICE = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows: a batch of long texts takes several times its size
    as Python objects, and workers keep what they once took."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def split_into(rows: int, per_part: int) -> int:
    return max(1, -(-rows // per_part))


def held_out() -> Column:
    """True for the documents that no model may learn from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


#: Keys with at least one in so many of all rows are hot; so there are no more hot keys than this.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows joined with groups, which has one row a key; ``size`` is the rows that each key has.

    Rows of hot keys meet their groups by a broadcast, of HOT_SHARE rows at most, and stay where they
    are; only the others are shuffled by key. Both tables should be cheap to read twice. Keys aren't null.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) * HOT_SHARE >= total)
    at_once = rows.join(F.broadcast(hot), keys)
    if total < HOT_SHARE:
        return at_once  # every key is hot
    others = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti")
    return at_once.unionByName(others.join(groups.where(F.col(size) * HOT_SHARE < total), keys))
