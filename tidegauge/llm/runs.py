"""Sorted immutable runs of item hashes, and batches merged with them.

An item is what is deduplicated within documents: a window of words, or a line. A batch of documents
is hashed and cut, by hash range, into sorted blocks. For each range, one task merges the batch's blocks
with the runs that hold the earlier batches' hashes: an item is flagged if its hash is in a run, or in
the same batch in a document with a smaller doc_id. The batch's own distinct hashes become a new run.
Runs are levelled: FANOUT runs of a level are merged into one of the next. An index is a folder of
manifests that name its runs, the latest one counts; so a batch that fails leaves the index as it was,
and another session can open it and go on. As history grows, its ranges are halved.

A hash has 64 bits that order it and more bits that verify it, from a hash of its own: as many that
among all items of the corpus two different ones agree with a probability under 2^-SURE. Blocks are stored as byte
planes of differences, compressed to little more than what is random in them.
Equal hashes within one block of a batch are combined before the shuffle, so an item that many
documents share costs one entry a block, however common it is.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, remove, slices

#: Items hashed before blocks are cut; items of a hash range; runs of a level before they are merged.
FLUSH, RANGE_ITEMS, FANOUT = 1_500_000, 1_200_000, 4
#: Two different items of a corpus agree with a probability under 2^-SURE, whatever its size.
SURE = 32
NO_ID = np.iinfo(np.int64).max
#: A hash of its text that tells rows of one doc_id apart; 0, which takes no space, where ids are enough.
TAG = np.int64
SCHEMA = "kind string, part long, rows long, block binary"

Items = tuple[np.ndarray, np.ndarray]
#: From one text: 64-bit hashes of its items, in order, and as many more bits to check them with.
HashText = Callable[[bytes], Items]


def planes(values: np.ndarray) -> bytes:
    """The lowest bytes of all values, then the next ones, and so on."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(data: bytes, kind: type, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width).reshape(width, n).T).view(kind).reshape(-1)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    head = struct.pack(f"<{len(arrays)}I", *map(len, arrays))
    return head + zstandard.compress(b"".join(map(planes, arrays)), 1)


def unpack_arrays(block: bytes, *kinds: type) -> list[np.ndarray]:
    counts, at, out = struct.unpack_from(f"<{len(kinds)}I", block), 0, []
    data = memoryview(zstandard.decompress(memoryview(block)[4 * len(kinds) :]))
    for kind, n in zip(kinds, counts):
        out.append(unplanes(data[at:], kind, n))
        at += n * np.dtype(kind).itemsize
    return out


def check_bits(items: float) -> int:
    """Bits beyond the first 64 by which so many items, in items^2 / 2 pairs, are told apart."""
    return min(64, max(8, math.ceil(2 * math.log2(max(2.0, items))) - 1 + SURE - 64))


def unsigned(bits: int) -> type:
    return np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64


def steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def sums(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=differences.dtype)


def tag_of(repeated: bool) -> Column:
    """The column for TAG; repeated: non-null ids may have several texts, as null always may."""
    own = F.xxhash64("text")
    return own if repeated else F.when(F.col("doc_id").isNull(), own).otherwise(F.lit(0).cast("long"))


def bucket_of(ids: np.ndarray, tags: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (ids.view(np.uint64) ^ tags.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """A multiple of so many ranges cuts each of them: hashes / 2^32 * ranges / 2^32, rounded down."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def rows_of(kind: str, found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    parts, rows, blocks = zip(*found) if found else ((), (), ())
    columns = [pa.array([kind] * len(parts), pa.string()), pa.array(parts, pa.int64()), pa.array(rows, pa.int64()), pa.array(blocks, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "part", "rows", "block"])


def firsts(hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries sorted by hash, in documents ids[doc]: which aren't of the smallest id of their (hash,
    check), and which entries are the first of it. Few hashes repeat, and only those are looked into."""
    same = hashes[1:] == hashes[:-1]
    again = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    late, first = np.zeros(len(hashes), bool), np.ones(len(hashes), bool)
    h, c, rank = hashes[again], checks[again], ids[doc[again]]
    order = np.lexsort((rank, c, h))
    if len(order):
        h, c, rank = h[order], c[order], rank[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
        late[again[order]] = rank > rank[np.flatnonzero(new)][np.cumsum(new) - 1]
        first[again[order]] = new
    return late, first


def flag_rows(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Flagged places, by bucket of their document: documents, tags, counts, places."""
    bucket, out = bucket_of(ids, tags, buckets), []
    order = np.lexsort((pos, tags, ids, bucket))
    bucket, ids, tags, pos = bucket[order], ids[order], tags[order], pos[order]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(edges, [*edges[1:], len(bucket)]):
        new = np.flatnonzero(np.r_[True, (ids[a + 1 : b] != ids[a : b - 1]) | (tags[a + 1 : b] != tags[a : b - 1])])
        counts = np.diff(np.r_[new, b - a]).astype(np.uint32)
        out.append((int(bucket[a]), int(b - a), pack_arrays(steps(ids[a:b][new]), tags[a:b][new], counts, steps(pos[a:b]))))
    return rows_of("flags", out)


def hash_batch(hash_text: HashText, ranges: int, buckets: int, check: type, bits: int):
    """From rows (doc, tag, text), a block for each hash range: hashes, checks, places, documents.

    Of a hash within a block, the places in its smallest document go on; those in other documents of
    the block are flagged at once.
    """

    def cut(docs: list[int], tags: list[int], found: list[Items]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(h) for h, _ in found], np.int64)
        if not sizes.sum():
            return
        hashes, checks = np.concatenate([h for h, _ in found]), np.concatenate([c for _, c in found]).astype(check) & check((1 << bits) - 1)
        found.clear()
        ids, tag = np.array(docs, np.int64), np.array(tags, TAG)
        doc = np.repeat(np.arange(len(ids), dtype=np.uint32), sizes)
        pos = (np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
        order = np.argsort(hashes)
        hashes, checks, doc, pos = hashes[order], checks[order], doc[order], pos[order]
        late, _ = firsts(hashes, checks, ids, doc)
        yield flag_rows(ids[doc[late]], tag[doc[late]], pos[late], buckets)
        hashes, checks, doc, pos = hashes[~late], checks[~late], doc[~late], pos[~late]
        share = range_of(hashes, ranges)
        bounds = np.searchsorted(share, np.arange(ranges + 1))
        out = []
        for k in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[k], bounds[k + 1]
            own, local = np.unique(doc[a:b], return_inverse=True)
            out.append((int(k), int(b - a), pack_arrays(steps(hashes[a:b]), checks[a:b], local.astype(np.uint32), pos[a:b], steps(ids[own]), tag[own])))
        yield rows_of("items", out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, tags, found, n = [], [], [], 0
        for batch in slices(batches):
            for doc, tag, text in zip(batch["doc"].to_pylist(), batch["tag"].to_pylist(), batch["text"].to_pylist()):
                items = hash_text((text or "").encode("utf-8", "surrogatepass"))
                docs.append(NO_ID if doc is None else doc)
                tags.append(tag)
                found.append(items)
                n += len(items[0])
                if n >= FLUSH:
                    yield from cut(docs, tags, found)
                    docs, tags, found, n = [], [], [], 0
        yield from cut(docs, tags, found)

    return run


def merge_range(buckets: int, check: type, keep_run: bool):
    """One hash range: the batch's blocks merged with the runs; gives flags and the batch's own run."""

    def run(table: pa.Table) -> pa.Table:
        out = table.filter(pc.equal(table["kind"], "flags")).to_batches()
        blocks = [unpack_arrays(b, np.uint64, check, np.uint32, np.uint32, np.int64, TAG) for b in table.filter(pc.equal(table["kind"], "items"))["block"].to_pylist()]
        old = [unpack_arrays(b, np.uint64, check) for b in table.filter(pc.equal(table["kind"], "run"))["block"].to_pylist()]
        if blocks:
            part = int(table["part"][0].as_py())
            del table
            # what the runs hold is document 0, before all others
            n_old = sum(len(h) for h, _ in old)
            ids = np.concatenate([[np.iinfo(np.int64).min], *(sums(b[4]) for b in blocks)])
            tags = np.concatenate([np.zeros(1, TAG), *(b[5] for b in blocks)])
            starts = np.cumsum([1, *(len(b[4]) for b in blocks[:-1])])
            hashes = np.concatenate([*(sums(h) for h, _ in old), *(sums(b[0]) for b in blocks)])
            checks = np.concatenate([*(c for _, c in old), *(b[1] for b in blocks)])
            doc = np.concatenate([np.zeros(n_old, np.uint32), *(b[2] + np.uint32(at) for b, at in zip(blocks, starts))])
            pos = np.concatenate([np.zeros(n_old, np.uint32), *(b[3] for b in blocks)])
            del blocks, old
            order = np.argsort(hashes, kind="stable")  # merges the sorted blocks
            hashes, checks, doc, pos = hashes[order], checks[order], doc[order], pos[order]
            late, first = firsts(hashes, checks, ids, doc)
            out.append(flag_rows(ids[doc[late]], tags[doc[late]], pos[late], buckets))
            if keep_run:
                # the first of a hash that the runs hold is theirs
                new = first & (doc > 0)
                out.append(rows_of("run", [(part, int(new.sum()), pack_arrays(steps(hashes[new]), checks[new]))]))
        return pa.Table.from_batches(out, rows_of("run", []).schema)

    return run


def merge_runs(check: type):
    def run(table: pa.Table) -> pa.Table:
        old = [unpack_arrays(b, np.uint64, check) for b in table["block"].to_pylist()]
        hashes, checks = np.concatenate([sums(h) for h, _ in old]), np.concatenate([c for _, c in old])
        order = np.argsort(hashes, kind="stable")
        block = pack_arrays(steps(hashes[order]), checks[order])
        return pa.Table.from_batches([rows_of("run", [(int(table["part"][0].as_py()), len(order), block)])])

    return run


def split_runs(ranges: int, check: type):
    """Each block of a run, cut by finer ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block in batch["block"].to_pylist():
                hashes, checks = unpack_arrays(block, np.uint64, check)
                hashes = sums(hashes)
                own = range_of(hashes, ranges)
                for k in np.unique(own):
                    mine = own == k
                    out.append((int(k), int(mine.sum()), pack_arrays(steps(hashes[mine]), checks[mine])))
            yield rows_of("run", out)

    return run


class RunIndex:
    """The hashes of all batches so far, in levelled runs in the shared folder.

    ``ranges`` hash ranges to begin with; ``check`` is the numpy type of the verifying bits, ``bits`` how
    many there are; both are fixed for the index. With ``path``, every batch that joins leaves a manifest
    there, by which ``RunIndex.open`` finds the index again.
    """

    def __init__(self, spark: SparkSession, ranges: int, check: type, fanout: int = FANOUT, *, bits: int | None = None, path: str | None = None):
        self.spark, self.ranges, self.check, self.fanout, self.path = spark, ranges, check, fanout, path
        self.bits = 8 * np.dtype(check).itemsize if bits is None else bits
        self.levels: list[list[str]] = []
        self.items, self.version = 0, 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> RunIndex:
        """The index as the latest whole manifest has it."""
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath().getName() for f in fs.listStatus(at)]
        whole = [n for n in found if n.startswith("manifest-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
        told = json.loads(spark.read.text(f"{path}/{max(whole)}").first()[0])
        index = cls(spark, told["ranges"], np.dtype(told["check"]).type, told["fanout"], bits=told["bits"], path=path)
        index.levels, index.items, index.version = told["levels"], told["items"], told["version"]
        return index

    def _save(self) -> None:
        if self.path:
            self.version += 1
            told = {"ranges": self.ranges, "check": np.dtype(self.check).name, "bits": self.bits, "fanout": self.fanout, "levels": self.levels, "items": self.items, "version": self.version}
            row = self.spark.createDataFrame([(json.dumps(told),)], "value string")
            row.coalesce(1).write.text(f"{self.path}/manifest-{self.version:09d}")

    def _read(self, paths: list[str], kind: str) -> DataFrame:
        return read_parts(self.spark, paths, kind)

    def _runs(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def make_room(self, items: float, range_items: int = RANGE_ITEMS) -> None:
        """Cut the ranges until, with so many items more, none is expected to hold over range_items."""
        factor = 1
        while (self.items + items) / (self.ranges * factor) > range_items:
            factor *= 2
        if factor == 1:
            return
        old = self._runs()
        cut = lambda p: write_parts(self._read([p], "run").mapInArrow(split_runs(self.ranges * factor, self.check), SCHEMA))
        self.levels = [[cut(p) for p in level] for level in self.levels]
        self.ranges *= factor
        self._save()
        remove(self.spark, *(f"{p}/kind=run" for p in old))

    def add(self, docs: DataFrame, hash_text: HashText, buckets: int, keep_run: bool = True, repeated: bool = True) -> str:
        """Flags of a batch (doc_id, text) against the runs and itself; its run joins the index.

        Returns the folder of the flags. keep_run=False: nothing will be merged with this batch.
        repeated=False: no non-null doc_id is there twice.
        """
        rows = docs.select(F.col("doc_id").cast("long").alias("doc"), tag_of(repeated).alias("tag"), "text")
        rows = rows.mapInArrow(hash_batch(hash_text, self.ranges, buckets, self.check, self.bits), SCHEMA)
        if old := self._runs():
            rows = rows.unionByName(self._read(old, "run"))
        merged = rows.groupBy("part").applyInArrow(merge_range(buckets, self.check, keep_run), SCHEMA)
        # groups of flags and of items may have one number; a group of flags only passes
        path = write_parts(merged)
        if keep_run:
            self.items += self._read([path], "run").agg(F.sum("rows")).first()[0] or 0
            late = self._push(path, 0)
            self._save()
            remove(self.spark, *(f"{p}/kind=run" for p in late))
        return path

    def _push(self, path: str, level: int) -> list[str]:
        """Returns the runs that are merged into others: they may go once a manifest leaves them out."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) < self.fanout:
            return []
        paths, self.levels[level] = self.levels[level], []
        path = write_parts(self._read(paths, "run").groupBy("part").applyInArrow(merge_runs(self.check), SCHEMA))
        return paths + self._push(path, level + 1)


def write_parts(df: DataFrame) -> str:
    """Write rows by kind, a folder each."""
    path = new_path(df.sparkSession, "runs")
    df.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return path


def read_parts(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    parts = [spark.read.schema(SCHEMA).parquet(p).where(F.col("kind") == kind).select("kind", "part", "rows", "block") for p in paths]
    return reduce(DataFrame.unionByName, parts)


def pack_texts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array([NO_ID if d is None else d for d in batch["doc"].to_pylist()], np.int64)
            bucket, out = bucket_of(ids, batch["tag"].to_numpy(), buckets), []
            for k in np.unique(bucket):
                own = batch.take(pa.array(np.flatnonzero(bucket == k)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(own)
                out.append((int(k), own.num_rows, sink.getvalue().to_pybytes()))
            yield rows_of("texts", out)

    return run


#: A text and its flagged places, to: items of the text, items removed, what is left of the text.
Rewrite = Callable[[str, np.ndarray], tuple[int, int, str]]


def rewritten(rewrite: Rewrite):
    def run(table: pa.Table) -> pa.Table:
        flags: dict[tuple[int, int], list[np.ndarray]] = {}
        rows = []
        for kind, block in zip(table["kind"].to_pylist(), table["block"].to_pylist()):
            if kind == "flags":
                ids, tags, counts, pos = unpack_arrays(block, np.int64, TAG, np.uint32, np.uint32)
                for key, places in zip(zip(sums(ids).tolist(), tags.tolist()), np.split(sums(pos), np.cumsum(counts)[:-1])):
                    flags.setdefault(key, []).append(places)
        none = np.zeros(0, np.uint32)
        for kind, block in zip(table["kind"].to_pylist(), table["block"].to_pylist()):
            if kind == "texts":
                for row in pa.ipc.open_stream(block).read_all().to_pylist():
                    places = flags.get((NO_ID if row["doc"] is None else row["doc"], row["tag"]))
                    rows.append((row["doc"], *rewrite(row["text"] or "", np.concatenate(places) if places else none)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*rows)) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_items", "n_removed", "kept_text"])

    return run


def remove_repeats(
    docs: DataFrame, hash_text: HashText, rewrite: Rewrite, *, check: type | None = None, chars_per_item: float, batches: tuple[float, ...],
    bucket_chars: int = 12_000_000, range_items: int = RANGE_ITEMS, index: RunIndex | None = None, keep_last: bool = True,
) -> DataFrame:
    """doc_id, n_items, n_removed, kept_text of every row of docs (doc_id, text).

    The documents go through a RunIndex in batches of ascending doc_id; ``batches`` are the shares of
    the rows up to the end of each batch (the last is 1), whose bounds are approximate quantiles. Null
    ids are in the last batch. Rows with a null or repeated id are told apart, and dealt to buckets, by
    64 bits of a hash of their text too.

    index: what it holds comes before all of docs; every batch joins it. Without one, an index is made
    for this call; keep_last=False then leaves out the last batch's run, which nothing reads.
    check: the type of the verifying bits, all of which are used; by default sized by check_bits.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = [F.percentile_approx("doc_id", float(share), 10_000) for share in batches[:-1]]
    chars, *bounds = docs.agg(F.sum(F.length("text")), *[c.alias(f"cut{k}") for k, c in enumerate(cuts)]).first()
    chars = chars or 0
    bounds = sorted({b for b in bounds if b is not None})
    items = chars / chars_per_item
    if index is None:
        bits = None if check else check_bits(items)
        index = RunIndex(spark, max(1, round(items / range_items)), check or unsigned(bits), bits=bits)
    else:
        keep_last = True
        index.make_room(items, range_items)
    buckets, paths = max(1, round(chars / bucket_chars)), []
    repeated = not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    for k, top in enumerate([*bounds, None]):
        part = docs
        if k:
            part = part.where(F.col("doc_id").isNull() | (F.col("doc_id") > bounds[k - 1]))
        if top is not None:
            part = part.where(F.col("doc_id") <= top)
        paths.append(index.add(part, hash_text, buckets, keep_run=keep_last or top is not None, repeated=repeated))
    texts = docs.select(F.col("doc_id").alias("doc"), tag_of(repeated).alias("tag"), "text").mapInArrow(pack_texts(buckets), SCHEMA)
    flags = read_parts(spark, paths, "flags")
    fields = "doc_id long, n_items long, n_removed long, kept_text string"
    return texts.unionByName(flags).groupBy("part").applyInArrow(rewritten(rewrite), fields)
