"""Lossless codecs for segments of doubles, by name.

A codec turns an array of doubles into bytes and back, given their number. Every bit comes back, signs
of zero and NaN payloads included.
"""

from __future__ import annotations

import lzma
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import constrained, dictionary, entropy, erasing, predictive, windowed
from .words import doubles_of, words_of


@dataclass(frozen=True)
class Codec:
    encode: Callable[[np.ndarray], bytes]
    decode: Callable[[bytes, int], np.ndarray]


def over_bytes(encode: Callable[[bytes], bytes], decode: Callable[[bytes], bytes]) -> Codec:
    """A codec over the doubles' little-endian bytes."""
    return Codec(lambda v: encode(np.ascontiguousarray(v, "<f8").tobytes()), lambda b, n: np.frombuffer(decode(b), "<f8").copy())


def over_words(encode: Callable[[list[int]], bytes], decode: Callable[[bytes, int], list[int]]) -> Codec:
    return Codec(lambda v: encode(words_of(v)), lambda b, n: doubles_of(decode(b, n)))


def library(name: str) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    """One of Arrow's compressors; the block starts with the plain size."""
    def encode(data: bytes) -> bytes:
        return len(data).to_bytes(4, "little") + pa.Codec(name).compress(data, asbytes=True)

    def decode(block: bytes) -> bytes:
        return pa.Codec(name).decompress(block[4:], int.from_bytes(block[:4], "little"), asbytes=True)

    return encode, decode


BACK_ENDS = {
    "zstd": library("zstd"),
    "lz4": library("lz4_raw"),
    "snappy": library("snappy"),
    "brotli": library("brotli"),
    "xz": (lzma.compress, lzma.decompress),
}


def with_constraints(back_end: str) -> Codec:
    encode, decode = BACK_ENDS[back_end]
    return Codec(lambda v: constrained.encode(v, encode), lambda b, n: constrained.decode(b, decode))


def gorilla(combine, restore) -> Codec:
    return over_words(lambda w: windowed.gorilla_encode(w, combine), lambda b, n: windowed.gorilla_decode(b, n, restore))


CODECS: dict[str, Codec] = {
    **{name: over_bytes(*pair) for name, pair in BACK_ENDS.items()},
    "lzw": over_bytes(dictionary.lzw_encode, dictionary.lzw_decode),
    "ans": over_bytes(entropy.ans_encode, entropy.ans_decode),
    "huffman_bytes": over_bytes(entropy.huffman_bytes_encode, entropy.huffman_bytes_decode),
    "huffman": over_words(entropy.huffman_words_encode, entropy.huffman_words_decode),
    "range": over_bytes(entropy.range_encode, entropy.range_decode),
    "lz77": over_bytes(dictionary.lz77_encode, dictionary.lz77_decode),
    "lz77_words": over_words(dictionary.lz77_words_encode, dictionary.lz77_words_decode),
    "rle": over_words(dictionary.rle_encode, dictionary.rle_decode),
    "simple8b": over_words(dictionary.simple8b_words_encode, dictionary.simple8b_words_decode),
    "gorilla": gorilla(*windowed.XOR),
    "gorilla_sub": gorilla(*windowed.SUB),
    "gorilla_add": gorilla(*windowed.ADD),
    "chimp": over_words(windowed.chimp_encode, windowed.chimp_decode),
    "chimp128": over_words(windowed.chimp128_encode, windowed.chimp128_decode),
    "fpc": over_words(predictive.fpc_encode, predictive.fpc_decode),
    "elf": over_words(erasing.elf_encode, erasing.elf_decode),
    "tsxor": over_words(windowed.tsxor_encode, windowed.tsxor_decode),
    "split": Codec(constrained.split_encode, constrained.split_decode),
    **{f"numerical_{name}": with_constraints(name) for name in BACK_ENDS},
}
