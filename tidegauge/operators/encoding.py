"""Segments encoded and decoded by codecs, run lengths and frequencies, and the choice of a codec."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType

from ..codecs import CODECS
from ..functions.bits import double_bits, wrapping_add, wrapping_sub
from .series import neighbours, running_sum


def segment_values(values: pa.Array) -> list[np.ndarray | None]:
    """The doubles of each list; a null in a list is NaN."""
    return [None if not x.is_valid else np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) for x in values]


def list_array(found: list[np.ndarray | None]) -> pa.Array:
    """Lists of doubles bit for bit: NaN stays NaN."""
    offsets = np.cumsum([0, *(0 if x is None else len(x) for x in found)]).astype(np.int32)
    flat = np.concatenate([x for x in found if x is not None] or [np.zeros(0)])
    mask = pa.array([x is None for x in found], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float64(), from_pandas=False), mask=mask)


def encoded(values: Column, codec: str) -> Column:
    """BINARY block of an ARRAY<DOUBLE> by the codec of that name; null stays null."""
    encode = CODECS[codec].encode

    @F.arrow_udf(BinaryType())
    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else encode(x) for x in segment_values(v)], pa.binary())

    return run(values)


def decoded(block: Column, n: Column, codec: str) -> Column:
    """ARRAY<DOUBLE> of a block of n values."""
    decode = CODECS[codec].decode

    @F.arrow_udf(ArrayType(DoubleType()))
    def run(b: pa.Array, n: pa.Array) -> pa.Array:
        return list_array([None if x is None else decode(x, k) for x, k in zip(b.to_pylist(), n.to_pylist())])

    return run(block, n)


@F.arrow_udf(BooleanType())
def same_bits(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(segment_values(a), segment_values(b))
    return pa.array([x is not None and y is not None and x.tobytes() == y.tobytes() for x, y in pairs])


def encode(segments: DataFrame, codec: str) -> DataFrame:
    """series_id, segment_id, n, codec, payload of packed segments (see series.packed)."""
    return segments.select("series_id", "segment_id", "n", F.lit(codec).alias("codec"), encoded(F.col("values"), codec).alias("payload"))


def decode(blocks: DataFrame, codec: str) -> DataFrame:
    rows = blocks.where(F.col("codec") == codec)
    return rows.select("series_id", "segment_id", "n", decoded(F.col("payload"), F.col("n"), codec).alias("values"))


def round_trip(segments: DataFrame, codec: str) -> DataFrame:
    """series_id, segment_id, n, bytes, round_trip_ok: every bit of every value came back."""
    rows = segments.select("series_id", "segment_id", "n", "values", encoded(F.col("values"), codec).alias("payload"))
    rows = rows.withColumn("back", decoded(F.col("payload"), F.col("n"), codec))
    return rows.select("series_id", "segment_id", "n", F.octet_length("payload").cast("long").alias("bytes"), same_bits("values", "back").alias("round_trip_ok"))


def ratios(segments: DataFrame, codecs: list[str]) -> DataFrame:
    """codec, segments, ratio: 8 n / bytes, averaged over segments alike."""
    sizes = all_sizes(segments, [(c, 0, c) for c in codecs])
    return sizes.groupBy(F.col("combo.name").alias("codec")).agg(F.count(F.lit(1)).alias("segments"), F.avg(8 * F.col("n") / F.col("combo.bytes")).alias("ratio"))


# The transforms and codecs of the choice, in the order of the labels' numbers.
RANGED, SCALED, DELTAS, CHOICE = ["null"], ["null"], ["null", "delta"], ["huffman", "elf", "chimp128", "fpc", "zstd"]


def delta_words(values: np.ndarray, back: bool = False) -> np.ndarray:
    """Differences of the doubles' bits modulo 2^64, which come back exactly, or their running sums."""
    words = np.ascontiguousarray(values, np.float64).view(np.uint64)
    out = np.cumsum(words, dtype=np.uint64) if back else np.diff(words, prepend=np.uint64(0))
    return out.view(np.float64)


def apply_combo(values: np.ndarray, label: list[int]) -> bytes:
    """A segment by its label (ranged, scale, delta, codec): the label's four bytes, then the block."""
    if label[0] or label[1]:
        raise ValueError("only the identity keeps every bit when ranging and scaling")
    if label[2]:
        values = delta_words(values)
    return bytes(label) + CODECS[CHOICE[label[3]]].encode(values)


def undo_combo(block: bytes, n: int) -> np.ndarray:
    _, _, delta, codec = block[:4]
    values = CODECS[CHOICE[codec]].decode(block[4:], n)
    return delta_words(values, back=True) if delta else values


def all_sizes(segments: DataFrame, combos: list[tuple[str, int, str]]) -> DataFrame:
    """segments less values, with combo: name, ordinal and bytes, a row for each of (name, delta, codec).

    The tries of a segment are one call, so its values aren't sent once for each.
    """

    @F.arrow_udf(ArrayType(LongType()))
    def run(v: pa.Array) -> pa.Array:
        rows = []
        for x in segment_values(v):
            plain = [x, delta_words(x)]
            rows.append([len(CODECS[codec].encode(plain[delta])) for _, delta, codec in combos])
        return pa.array(rows, pa.list_(pa.int64()))

    names = F.array(*[F.lit(name) for name, _, _ in combos])
    rows = segments.withColumn("sizes", run("values")).drop("values")
    rows = rows.select("*", F.posexplode("sizes").alias("ordinal", "size")).drop("sizes")
    combo = F.struct(F.element_at(names, F.col("ordinal") + 1).alias("name"), "ordinal", F.col("size").alias("bytes")).alias("combo")
    return rows.select("series_id", "segment_id", "n", combo)


def best_combo(segments: DataFrame) -> DataFrame:
    """series_id, segment_id, n, ranged, scale, del, algo, bytes: the smallest; ties to the first tried."""
    combos = [(f"{d}+{a}", k, a) for k, d in enumerate(DELTAS) for a in CHOICE]
    first = F.min_by("combo", F.struct("combo.bytes", "combo.ordinal")).alias("best")
    best = all_sizes(segments, combos).groupBy("series_id", "segment_id").agg(F.first("n").alias("n"), first)
    place = F.col("best.ordinal")
    zero = F.lit(0)
    return best.select("series_id", "segment_id", "n", zero.alias("ranged"), zero.alias("scale"), F.floor(place / len(CHOICE)).cast("int").alias("del"), (place % len(CHOICE)).cast("int").alias("algo"), F.col("best.bytes").alias("bytes"))


def encode_chosen(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """Each segment by its own label (series_id, segment_id, ranged, scale, del, algo), clipped to the tables."""
    tops = {"ranged": len(RANGED), "scale": len(SCALED), "del": len(DELTAS), "algo": len(CHOICE)}
    clipped = F.array(*[F.least(F.greatest(F.round(F.col(c)).cast("int"), F.lit(0)), F.lit(n - 1)) for c, n in tops.items()])

    @F.arrow_udf(BinaryType())
    def run(v: pa.Array, label: pa.Array) -> pa.Array:
        return pa.array([apply_combo(x, k) for x, k in zip(segment_values(v), label.to_pylist())], pa.binary())

    rows = segments.join(labels.select("series_id", "segment_id", clipped.alias("label")), ["series_id", "segment_id"])
    return rows.select("series_id", "segment_id", "n", F.lit("chosen").alias("codec"), run("values", "label").alias("payload"))


def decode_chosen(blocks: DataFrame) -> DataFrame:
    @F.arrow_udf(ArrayType(DoubleType()))
    def run(b: pa.Array, n: pa.Array) -> pa.Array:
        return list_array([undo_combo(x, k) for x, k in zip(b.to_pylist(), n.to_pylist())])

    return blocks.select("series_id", "segment_id", "n", run("payload", "n").alias("values"))


def rle(series: DataFrame) -> DataFrame:
    """series_id, run (from 1), start, value, length: runs of equal values (NaN equals NaN)."""
    rows = neighbours(series).withColumn("new", F.when(F.col("value").eqNullSafe(F.col("p1")), 0).otherwise(1).cast("long"))
    rows = running_sum(rows, "new", "run")
    return rows.groupBy("series_id", "run").agg(F.min("pos").alias("start"), F.min_by("value", "pos").alias("value"), F.count(F.lit(1)).alias("length"))


def rle_decode(runs: DataFrame) -> DataFrame:
    return runs.select("series_id", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos"), "value")


def value_frequencies(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id", "value").agg(F.count(F.lit(1)).alias("c"))


def byte_frequencies(series: DataFrame) -> DataFrame:
    """series_id, byte, c, below: the eight little-endian bytes of all values, one added to each of the
    256 counts, and the counts of smaller bytes added up."""
    bits = double_bits(F.col("value"))
    split = F.array(*[F.shiftrightunsigned("b", 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(8)])
    seen = series.select("series_id", bits.alias("b")).select("series_id", F.explode(split).alias("byte"))
    seen = seen.groupBy("series_id", "byte").agg(F.count(F.lit(1)).alias("c"))
    every = seen.select("series_id").distinct().select("series_id", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("byte"))
    rows = every.join(seen, ["series_id", "byte"], "left").withColumn("c", F.coalesce("c", F.lit(0)) + 1)
    below = F.coalesce(F.sum("c").over(W.partitionBy("series_id").orderBy("byte").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.select("series_id", "byte", "c", below.alias("below"))


def adjacent_bits(series: DataFrame) -> DataFrame:
    """series_id, pos, bits and the xor, sum and difference (modulo 2^64) with the bits before."""
    rows = series.withColumn("bits", double_bits(F.col("value")))
    rows = neighbours(rows, "bits").withColumnRenamed("p1", "before").where("before is not null")
    b, now = F.col("before"), F.col("bits")
    return rows.select("series_id", "pos", "bits", now.bitwiseXOR(b).alias("bits_xor"), wrapping_add(now, b).alias("bits_add"), wrapping_sub(now, b).alias("bits_sub"))


def bit_costs(segments: DataFrame) -> DataFrame:
    """series_id, segment_id, at, xor_bits, sub_bits: what Gorilla's two forms spend on each value.

    The window that a value may reuse depends on those before it, so a segment is one call.
    """
    from ..codecs.windowed import SUB, XOR
    from ..codecs.words import leading, trailing, words_of

    def costs(words: list[int], combine) -> list[int]:
        out, lead, trail = [64] * bool(words), None, 0
        for before, now in zip(words, words[1:]):
            x = combine(now, before)
            if x == 0:
                out.append(1)
            elif lead is not None and leading(x) >= lead and trailing(x) >= trail:
                out.append(2 + 64 - lead - trail)
            else:
                lead, trail = leading(x), trailing(x)
                out.append(14 + 64 - lead - trail)
        return out

    @F.arrow_udf(ArrayType(ArrayType(LongType())))
    def run(v: pa.Array) -> pa.Array:
        rows = [[costs(words_of(x), XOR[0]), costs(words_of(x), SUB[0])] for x in segment_values(v)]
        return pa.array(rows, pa.list_(pa.list_(pa.int64())))

    rows = segments.withColumn("costs", run("values"))
    pairs = F.arrays_zip(F.get("costs", F.lit(0)).alias("xor_bits"), F.get("costs", F.lit(1)).alias("sub_bits"))
    rows = rows.select("series_id", "segment_id", F.posexplode(pairs).alias("at", "cost"))
    return rows.select("series_id", "segment_id", "at", F.col("cost.xor_bits"), F.col("cost.sub_bits"))


def erased_bits(segments: DataFrame) -> DataFrame:
    """series_id, segment_id, at, direct_xor, erased_xor: each value's bits xored with those before, as
    they are and after clearing the bits that its decimals make redundant (a segment's first stays)."""
    from ..codecs.erasing import erase
    from ..codecs.words import words_of

    def xors(words: list[int]) -> list[list[int]]:
        short = words[:1] + [erase(w)[0] for w in words[1:]]
        return [np.array([b ^ a for a, b in zip(w, w[1:])], np.uint64).view(np.int64).tolist() for w in (words, short)]

    @F.arrow_udf(ArrayType(ArrayType(LongType())))
    def run(v: pa.Array) -> pa.Array:
        return pa.array([xors(words_of(x)) for x in segment_values(v)], pa.list_(pa.list_(pa.int64())))

    rows = segments.withColumn("xors", run("values"))
    pairs = F.arrays_zip(F.get("xors", F.lit(0)).alias("direct_xor"), F.get("xors", F.lit(1)).alias("erased_xor"))
    rows = rows.select("series_id", "segment_id", F.posexplode(pairs).alias("at", "x"))
    return rows.select("series_id", "segment_id", (F.col("at") + 1).alias("at"), "x.direct_xor", "x.erased_xor")
