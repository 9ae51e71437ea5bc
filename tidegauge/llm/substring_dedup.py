"""Substring dedup over a log-structured index of window hashes (see runs.py)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .runs import FANOUT, RANGE_ITEMS, Items, RunIndex, check_bits, remove_repeats, unsigned

WINDOW = 13
#: Characters of a word, at a guess: sizes of ranges and hashes rest on it, results don't.
WORD_CHARS = 6
#: Four small batches make a run of the second level; what comes after is held against it.
BATCHES = (0.025, 0.05, 0.075, 0.1, 0.15, 1.0)
#: Words whose hashes a worker remembers.
REMEMBER = 400_000
MIX, MIX_CHECK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words:
    """Two 64-bit hashes of each word, remembered. One object, as a function that is sent to a worker
    keeps no variable in common with another one."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.hashes = np.zeros((2, 1024), np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBER:
            self.known.clear()
        try:
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            self.learn(set(words))
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return self.hashes[:, at]

    def learn(self, words: set[bytes]) -> None:
        import xxhash

        new, n = sorted(words.difference(self.known)), len(self.known)
        if n + len(new) > self.hashes.shape[1]:
            self.hashes = np.concatenate([self.hashes, np.zeros((2, n + len(new)), np.uint64)], axis=1)
        self.hashes[:, n : n + len(new)] = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, new)), "<u8").reshape(-1, 2).T
        self.known.update(zip(new, range(n, n + len(new))))


def window_hashes(window: int):
    """Two polynomial hashes of each window, over two 64-bit hashes of its words, finished by mixing."""
    hashes = Words()

    def finish(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def run(text: bytes) -> Items:
        words = text.split()
        n = len(words) - window + 1
        if n < 1:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        one, two = hashes(words)
        a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for k in range(window):
            a = a * MIX + one[k : n + k]
            b = b * MIX_CHECK + two[k : n + k]
        return finish(a), finish(b)

    return run


def drop_covered(window: int):
    def run(text: str, places: np.ndarray) -> tuple[int, int, str]:
        words = text.encode("utf-8", "surrogatepass").split()
        if not len(places):
            return len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass")
        edge = np.zeros(len(words) + 1, np.int32)
        np.add.at(edge, places, 1)
        np.add.at(edge, places.astype(np.int64) + window, -1)
        covered = np.cumsum(edge[:-1]) > 0
        kept = [w for w, gone in zip(words, covered.tolist()) if not gone]
        return len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")

    return run


def new_index(spark: SparkSession, path: str, words: float, fanout: int = FANOUT) -> RunIndex:
    """An empty index, kept at path, for a history that is to grow to about so many words."""
    bits = check_bits(words)
    return RunIndex(spark, max(1, round(words / RANGE_ITEMS)), unsigned(bits), fanout, bits=bits, path=path)


def remove_substrings(docs: DataFrame, *, window: int = WINDOW, batches: tuple[float, ...] = BATCHES, check: type | None = None, index: RunIndex | None = None) -> DataFrame:
    """doc_id, n_items (words), n_removed, kept_text of every row of docs (doc_id, text).

    Every word covered by a window of ``window`` consecutive words that also starts in a document with
    a smaller doc_id is removed; windows are those of the input. Kept words are joined by one space.
    Words are separated by ASCII white space. A null or empty text has no words. A null doc_id ranks
    after all others (and with 2^63 - 1), and null ids don't repeat each other; nor do repeated rows with
    one id. An empty table gives an empty result. Other columns of docs are not read.

    index: documents that came before docs, whatever their ids, for deduplication batch by batch; docs
    join it. Without one, docs are split into ``batches`` that go through an index of their own.

    Windows are compared by 64 bits of one hash and as many of another, of other hashes of the words,
    that any two different windows of the corpus agree with a probability under 2^-32 (``check`` sets
    other bits), not word by word.
    """
    return remove_repeats(docs, window_hashes(window), drop_covered(window), check=check, chars_per_item=WORD_CHARS, batches=batches, index=index, keep_last=False)
