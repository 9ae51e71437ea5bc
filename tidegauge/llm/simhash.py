"""SimHash near-dedup with covering locality-sensitive hashing.

A document's fingerprint takes the majority of each bit over its shingles' hashes. For a radius r, give
each bit a random (r + 1)-bit vector m; the 2^(r+1) - 1 masks keep, for each non-zero v, the bits whose
m isn't orthogonal to v. Whatever r bits two fingerprints differ in, some v is orthogonal to all of
those bits' vectors, so its mask leaves them out: every pair within the radius meets in some table.

Buckets hold distinct fingerprints only. A bucket is split into chunks of bounded size, each pair of
chunks is compared by one task, and only a spanning forest of its links is emitted. Components are then
joined up by alternating large-star and small-star steps over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_groups, remove, slices, split_into, write_table
from .resemblance import resembling

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a chunk: two chunks are compared at once, all against all, in memory.
CHUNK = 1024
#: Fingerprints gathered before groups are compared; edges of a file between the steps for components.
GATHER, EDGES_A_FILE = 1 << 16, 500_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], "<u8")
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, fp (the 64 bits as a long) of every row of docs (doc_id, text); null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint((t or "").encode("utf-8", "surrogatepass"), shingle, seed) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """2^(radius + 1) - 1 masks of 64 bits; any two words within the radius agree under one of them."""
    vectors = np.random.default_rng(seed).integers(1, 1 << (radius + 1), 64)
    kept = lambda v: [bin(v & int(m)).count("1") % 2 for m in vectors]
    return [sum(1 << bit for bit, keep in enumerate(kept(v)) if keep) for v in range(1, 1 << (radius + 1))]


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join up what is within the radius of each other, through the first of each part."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    free, out = np.ones(len(fps), bool), []
    for k in range(len(fps)):
        if free[k]:
            free[k] = False
            front = np.array([k])
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & free)
                free[front] = False
                out += [(k, int(x)) for x in front]
    return out


def linked(radius: int):
    """Of partitions sorted by group, the links within each group. A group has two chunks at most."""

    def flush(group: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
        left, right = [fps[two]], [fps[two + 1]]
        for a, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            own = fps[a : a + n]
            if links := forest(own, radius):
                at = np.array(links)
                left.append(own[at[:, 0]])
                right.append(own[at[:, 1]])
        pairs = [pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)]
        return pa.RecordBatch.from_arrays(pairs, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            group = np.concatenate([group, batch["g"].to_numpy()])
            fps = np.concatenate([fps, batch["fp"].to_numpy().view(np.uint64)])
            if len(group) >= GATHER and (ends := np.flatnonzero(group != group[-1])).size:
                end = int(ends[-1]) + 1  # the last group may go on in the next batch
                yield flush(group[:end], fps[:end])
                group, fps = group[end:], fps[end:]
        if len(group):
            yield flush(group, fps)

    return run


def links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that join up all within the radius.

    A bucket of n fingerprints gives (n / chunk)^2 / 2 tasks' worth of groups of 2 * chunk at most; no
    bucket is dropped or cut short.
    """
    masks = F.array([F.lit(m - (1 << 64) if m >> 63 else m) for m in covering_masks(radius)])
    rows = fps.select("fp", F.posexplode(masks).alias("table", "mask")).select("fp", "table", F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"))
    rows = rows.select("fp", F.xxhash64("table", "bucket").alias("bucket"))
    group = W.partitionBy("bucket")
    rows = rows.withColumn("there", F.count(F.lit(1)).over(group)).where("there > 1")
    own = F.floor((F.row_number().over(group.orderBy("fp")) - 1) / chunk)
    rows = rows.withColumn("own", own).withColumn("chunks", F.ceil(F.col("there") / chunk))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    # each chunk is compared within itself along with any other one; alone, with itself
    rows = rows.select("fp", "bucket", "own", "chunks", other.alias("other")).where("chunks = 1 or own != other")
    rows = rows.select("fp", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("g"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "g").sortWithinPartitions("g", "fp").mapInArrow(linked(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node with an edge (a, b) is joined to, roots included.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until the edges are stars. Minima of
    neighbourhoods are aggregated before the shuffle and joined back, so a star's centre with many
    neighbours is spread as any skewed join is.
    """
    spark = edges.sparkSession

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def stars(df: DataFrame, large: bool) -> DataFrame:
        """large: each node's larger neighbours go to its smallest one; else its smaller ones do."""
        back = df.select(F.col("b").alias("a"), F.col("a").alias("b"))
        both = df.unionByName(back) if large else df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
        rows = both.join(least, "a")
        moved = rows.where("b > a" if large else "b <= a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        if not large:
            moved = moved.unionByName(least.select("a", F.col("least").alias("b")))
        return moved.where("a != b").distinct()

    now, path = write_table(edges.where("a != b").distinct(), "links")
    before = None
    while (after := state(now)) != before:
        before = after
        # a step makes about as many edges as there were: small tables needn't be many files
        files = split_into(after[0], EDGES_A_FILE)
        new, new_path = write_table(stars(stars(now, True), False).coalesce(files), "stars")
        remove(spark, path)
        now, path = new, new_path
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, chunk: int = CHUNK, similarity: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row of docs (doc_id, text).

    Two fingerprints are linked when they differ in at most ``radius`` bits, and, with ``similarity``,
    when the sets of 5-word shingles of their texts are at least that similar; component_id is the
    smallest doc_id that can be reached over links. A text without words (null, empty) has fingerprint
    zero, which is linked like any other. Null doc_ids keep their fingerprint and component but are no
    component's id unless it has no other. Repeated rows give repeated rows. An empty table gives an
    empty result. Other columns of docs are not read.
    """
    rows, _ = write_table(fingerprints(docs, shingle=shingle, seed=seed), "fingerprints")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("docs"))
    edges = links(first.select("fp"), radius, chunk)
    if similarity is not None:
        edges = edges.unionByName(resembling(docs, rows, components, similarity=similarity))
    root = components(edges)
    groups = first.join(root, first["fp"] == root["node"], "left").select("fp", "first", "docs", F.coalesce("root", "fp").alias("root"))
    groups, _ = write_table(groups, "fingerprint-roots")
    smallest = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    placed, _ = write_table(groups.join(smallest, "root").select("fp", "docs", "component_id"), "fingerprint-components")
    placed = join_groups(rows, placed, ["fp"], "docs")
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id, all columns.

    Of repeated rows with that doc_id the one with the longest text (then the first by text) stays.
    Columns starting with ``near_`` are reserved.
    """
    stay = near_duplicates(docs, **options).where("doc_id <=> component_id").select(F.col("doc_id").alias("near_doc")).distinct()
    rows = docs.join(stay, F.coalesce(docs["doc_id"].cast("string"), F.lit("")) == F.coalesce(stay["near_doc"].cast("string"), F.lit("")), "left_semi")
    rank = F.row_number().over(W.partitionBy(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).orderBy(F.length("text").desc(), "text"))
    return rows.withColumn("near_rank", rank).where("near_rank = 1").select([F.col(f"`{c}`") for c in docs.columns])
