"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Class j holds pieces of exactly floor(capacity / j) tokens, and its sequences take j of them each: a
full sequence of a class has at most j - 1 tokens of padding. A document is cut greedily into the
largest class that still fits until less than a short tail is left; a tail of s tokens belongs to class
floor(capacity / s), where the other pieces have its length too. So a class is a length.

Every worker fills the bins of its classes by itself, from its own bucket of documents; the fewer than
j pieces left over of each class go up to a wider bucket and are filled again, until one bucket is left.
What then remains is bounded by the classes, not by the data, and goes into the fullest sequence that
has room for it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, split_into, write_table

CAPACITY, END = 2048, 1
#: Shortest class that documents are cut to; what is shorter is a tail.
SHORTEST = 32
#: Buckets that go up into one.
FANOUT = 64
#: Bits of sequence_id for the level: there are as many levels as FANOUT goes into the buckets.
LEVEL_BITS = 4
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def class_lengths(capacity: int = CAPACITY, shortest: int = SHORTEST) -> list[int]:
    return sorted({capacity // j for j in range(1, capacity // shortest + 1)}, reverse=True)


def cut_lengths(tokens: int, capacity: int = CAPACITY, shortest: int = SHORTEST) -> list[int]:
    """The lengths that a document of so many tokens is cut into, in order."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest >= shortest:
        out.append(capacity // -(-capacity // rest))
        rest -= out[-1]
    return out + [rest] * (rest > 0)


_loaded: dict[str, object] = {}


def encoder(vocabulary: str):
    """The byte-level BPE of a tokenizers file, once for each worker process.

    Its merges are in the order of their ids, so the ids serve as ranks for the faster library; tests
    hold its ids against those that ``tokenizers`` gives. Added tokens found in a text are for callers
    to allow: by ``encode_ordinary`` their strings are ordinary text.
    """
    if vocabulary not in _loaded:
        import tiktoken

        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        with open(vocabulary, encoding="utf-8") as file:
            whole = json.load(file)
        added = {token["content"]: token["id"] for token in whole["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in word): k for word, k in whole["model"]["vocab"].items() if word not in added}
        _loaded[vocabulary] = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _loaded[vocabulary]


def token_pieces(vocabulary: str, end: int, capacity: int, shortest: int, with_ids: bool, added_tokens: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        if added_tokens:
            encode = partial(encoder(vocabulary).encode, allowed_special="all")
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = np.array([*encode(text or ""), end], "<u4")
                start = 0
                for length in cut_lengths(len(ids), capacity, shortest):
                    piece = ids[start : start + length].tobytes()
                    rows.append((doc, start, length, zlib.crc32(piece), len(ids), *[piece] * with_ids))
                    start += length
            columns = list(zip(*rows)) or [()] * (5 + with_ids)
            kinds = [batch.schema.field("doc_id").type, *[pa.int64()] * 4, *[pa.binary()] * with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return run


def place_rest(capacity: int):
    """Into the fullest sequence with room for it, longest first: at most one piece less than j a class."""

    def run(rest: pa.Table) -> pa.Table:
        rest = rest.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        used: list[int] = []
        at, offsets = [], []
        for length in rest["length"].to_pylist():
            room = [k for k, u in enumerate(used) if u + length <= capacity]
            k = max(room, key=used.__getitem__) if room else len(used)
            if not room:
                used.append(0)
            at.append(k)
            offsets.append(used[k])
            used[k] += length
        rest = rest.drop_columns(["bucket"])
        return rest.append_column("sequence_id", pa.array(at, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack(docs: DataFrame, *, vocabulary: str, end: int = END, capacity: int = CAPACITY, shortest: int = SHORTEST, docs_per_bucket: int = 2_000, with_ids: bool = True, added_tokens: bool = True) -> DataFrame:
    """Pieces of docs (doc_id, text) in sequences: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, with_ids, ids (little-endian unsigned 32-bit).

    A document's ids are those of its whole text, then ``end``; null counts as empty, so every
    document has at least one id and every id is in exactly one piece. A null doc_id is kept. Repeated
    rows are packed once each. An empty table gives an empty result. Other columns are not read.
    A sequence is as long as what is in it; the trainer pads it to ``capacity``.

    The string of an added token of the vocabulary file, as <|endoftext|>, is that token, as
    ``tokenizers`` has it by default; with added_tokens=False it is ordinary text.

    sequence_id is unique, not dense: it holds level, bucket, class and number. Where they don't fit
    into 63 bits (2^30 buckets leave 2^17 sequences a class and bucket), the query fails.
    """
    spark = docs.sparkSession
    buckets = split_into(docs.count(), docs_per_bucket)
    bucket_bits, class_bits = buckets.bit_length(), capacity.bit_length()
    number_bits = 63 - LEVEL_BITS - bucket_bits - class_bits
    if number_bits < 1:
        raise ValueError(f"{buckets} buckets are too many for a sequence_id of 64 bits")
    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    pieces = docs.select("doc_id", "text").mapInArrow(token_pieces(vocabulary, end, capacity, shortest, with_ids, added_tokens), fields)
    rest = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "doc_tokens"), F.lit(buckets)).cast("long"))
    full, level = [], 0
    fit = F.floor(F.lit(capacity) / F.col("length"))
    names = [f.split()[0] for f in fields.split(", ")]
    while True:
        group = W.partitionBy("bucket", "length")
        order = ["doc_id", "start", "doc_tokens", "ids_crc32"]
        placed = rest.withColumn("nth", F.row_number().over(group.orderBy(*order)) - 1).withColumn("there", F.count(F.lit(1)).over(group))
        # later levels read this: it is written so that they don't tokenize and number again
        placed, _ = write_table(placed, f"packed-{level}")
        whole = F.col("nth") < F.floor(F.col("there") / fit) * fit
        nth = F.floor(F.col("nth") / fit)
        nth = F.when(nth < 1 << max(0, number_bits), nth).otherwise(F.raise_error(F.lit("sequences of a class and bucket don't fit into 63 bits of sequence_id")).cast("long"))
        number = F.shiftleft(F.lit(level + 1).cast("long"), bucket_bits) + F.col("bucket")
        number = F.shiftleft(F.shiftleft(number, class_bits) + F.col("length"), number_bits) + nth
        full.append(placed.where(whole).select(*names, number.alias("sequence_id"), ((F.col("nth") % fit) * F.col("length")).cast("long").alias("offset")))
        rest = placed.where(~whole).drop("nth", "there")
        if buckets == 1:
            break
        buckets, level = split_into(buckets, FANOUT), level + 1
        rest = rest.withColumn("bucket", F.floor(F.col("bucket") / FANOUT))
    last = rest.groupBy("bucket").applyInArrow(place_rest(capacity), f"{fields}, sequence_id long, offset long")
    out = full[0]
    for more in [*full[1:], last]:
        out = out.unionByName(more)
    return out
