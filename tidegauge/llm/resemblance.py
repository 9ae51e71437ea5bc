"""Links between texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

Candidates meet in BANDS tables keyed by ROWS minima of their shingles' hashes: a pair of similarity s
misses all tables with probability (1 - s^ROWS)^BANDS, 2e-6 at 0.8 and less above. Each table's bucket is
drawn together in a star over fingerprints, so that a text is sent once, to its component of candidates,
where its set is checked exactly. A component of any size is cut into chunks of bounded size, and each
pair of chunks is compared by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, write_table
from .substring_dedup import window_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 4
#: Shingles of a chunk: two chunks are compared at once in memory.
CHUNK = 250_000
#: Shingles whose minima are taken at once.
PART = 2048
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(shingle: int):
    """From a text, the sorted distinct hashes of its shingles; of fewer words, one of all of them."""
    hashes = window_hashes(shingle)

    def run(text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower()
        own = hashes(words)[0]
        if len(own):
            return np.unique(own)
        few = words.split()
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(few))] if few else [], np.uint64)

    return run


def band_keys(shingles: np.ndarray, seed: int = 11) -> np.ndarray:
    """A key for each band; none of an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    times, plus = np.random.default_rng(seed).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
    times |= np.uint64(1)
    least = np.min([((shingles[a : a + PART, None] ^ plus) * times).min(axis=0) for a in range(0, len(shingles), PART)], axis=0)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(ROWS, BANDS):
        key = (key ^ (key >> np.uint64(31))) * STEP + row
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join up the sets that are similar enough, through pairs that are."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    own = [at[a : a + n] for a, n in zip(starts, sizes)]
    mark, free, out = np.zeros(len(values), bool), np.ones(len(sets), bool), []
    for k in range(len(sets)):
        if not free[k]:
            continue
        free[k] = False
        front = [k]
        while front:
            x = front.pop()
            rest = np.flatnonzero(free & (sizes >= similarity * sizes[x] - 1e-6) & (similarity * sizes <= sizes[x] + 1e-6))
            if not len(rest):
                continue
            mark[own[x]] = True
            both = np.array([np.count_nonzero(mark[own[y]]) for y in rest.tolist()])
            mark[own[x]] = False
            found = rest[both >= similarity * (sizes[x] + sizes[rest] - both) - 1e-9].tolist()
            free[found] = False
            front += found
            out += [(x, y) for y in found]
    return out


def resembling(docs: DataFrame, fps: DataFrame, components, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """a, b: links between fingerprints of texts that join up all whose shingle sets are similar enough.

    docs (text), fps (text_hash, fp) of all of them; components joins up edges (a, b) to (node, root).
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = shingle_sets(shingle)
        for batch in slices(batches):
            own = [sets(t) for t in batch["text"].to_pylist()]
            keys = pa.array([band_keys(s) for s in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["text_hash"], pa.array([len(s) for s in own], pa.int64()), keys], ["text_hash", "shingles", "keys"])

    hashed = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    keys = hashed.mapInArrow(keyed, "text_hash long, shingles long, keys array<long>").where("shingles > 0")
    rows = keys.dropDuplicates(["text_hash"]).join(fps.select("text_hash", "fp").dropDuplicates(["text_hash"]), "text_hash")
    rows, _ = write_table(rows, "band-keys")
    exploded = rows.select("fp", F.explode("keys").alias("key"))
    first = exploded.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a < last").select("key", "a")
    root = components(exploded.join(first, "key").select("a", F.col("fp").alias("b")).where("a != b"))
    found = rows.join(root, rows["fp"] == root["node"]).select("text_hash", "fp", "shingles", "root")
    group = W.partitionBy("root").orderBy("text_hash")
    found = found.withColumn("own", F.floor((F.sum("shingles").over(group) - F.col("shingles")) / chunk))
    found = found.withColumn("chunks", F.max("own").over(W.partitionBy("root")) + 1)
    found, _ = write_table(found, "candidates")
    texts = hashed.join(found.select("text_hash"), "text_hash", "left_semi").dropDuplicates(["text_hash"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = shingle_sets(shingle)
        for batch in slices(batches):
            own = pa.array([sets(t).tobytes() for t in batch["text"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["text_hash"], own], ["text_hash", "members"])

    sent = found.join(texts.mapInArrow(packed, "text_hash long, members binary"), "text_hash")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    # as in simhash.links: each chunk is compared within itself along with any other one
    sent = sent.select("*", other.alias("other")).where("chunks = 1 or own != other")
    sent = sent.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "members")

    def compare(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy()
        pairs = alike([np.frombuffer(m, np.uint64) for m in table["members"].to_pylist()], similarity)
        ends = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.table({"a": fp[ends[:, 0]], "b": fp[ends[:, 1]]})

    return sent.groupBy("root", "low", "high").applyInArrow(compare, "a long, b long")
