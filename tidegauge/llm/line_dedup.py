"""Line dedup over levelled sorted runs of line hashes (see runs.py)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .runs import FANOUT, RANGE_ITEMS, Items, RunIndex, remove_repeats

SHORTEST = 10
#: Four runs are merged into one of the second level, and two more batches are held against it.
BATCHES = (1 / 6, 2 / 6, 3 / 6, 4 / 6, 5 / 6, 1.0)


def keys(text: bytes, shortest: int) -> list[tuple[int, bytes]]:
    """Place and key of the lines whose key is long enough, counted in code points."""
    out = []
    for place, line in enumerate(text.split(b"\n")):
        key = line.strip().lower()  # of bytes: ASCII white space and A-Z only
        if len(key) >= 4 * shortest or len(key) >= shortest and len(key.decode("utf-8", "surrogatepass")) >= shortest:
            out.append((place, key))
    return out


def line_hashes(shortest: int):
    def run(text: bytes) -> Items:
        import xxhash

        digests = b"".join(xxhash.xxh3_128_digest(key) for _, key in keys(text, shortest))
        both = np.frombuffer(digests, "<u8").reshape(-1, 2)
        return np.ascontiguousarray(both[:, 1]), np.ascontiguousarray(both[:, 0])

    return run


def drop_lines(shortest: int):
    def run(text: str, places: np.ndarray) -> tuple[int, int, str]:
        lines = text.split("\n")
        if not len(places):
            return len(lines), 0, text
        own = keys(text.encode("utf-8", "surrogatepass"), shortest)
        gone = {own[k][0] for k in places.tolist()}
        return len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)

    return run


def new_index(spark: SparkSession, path: str, lines: float, fanout: int = FANOUT) -> RunIndex:
    """An empty index, kept at path; ``lines`` that the first batch is expected to have."""
    return RunIndex(spark, max(1, round(lines / RANGE_ITEMS)), np.uint64, fanout, path=path)


def remove_lines(docs: DataFrame, *, shortest: int = SHORTEST, batches: tuple[float, ...] = BATCHES, index: RunIndex | None = None) -> DataFrame:
    """doc_id, n_items (lines), n_removed, kept_text of every row of docs (doc_id, text).

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Lines whose key
    has at least ``shortest`` code points stay only in the smallest doc_id that holds the key, as often
    as they are there. Other lines stay; kept lines are joined by a line feed. A null or empty text is
    one empty line. A null doc_id ranks after all others (and with 2^63 - 1), and null ids don't repeat
    each other; nor do repeated rows with one id. An empty table gives an empty result. Other columns
    are not read.

    index: documents that came before docs, whatever their ids, for deduplication batch by batch; docs
    join it. Without one, docs are split into ``batches`` that go through an index of their own.

    Lines are compared by 128 bits of a hash of the key.
    """
    return remove_repeats(docs, line_hashes(shortest), drop_lines(shortest), check=np.uint64, chars_per_item=60, batches=batches, index=index)
