"""Helpers over 64-bit words."""

from __future__ import annotations

import numpy as np

WORD = (1 << 64) - 1


def words_of(values: np.ndarray) -> list[int]:
    return np.ascontiguousarray(values, "<f8").view("<u8").tolist()


def doubles_of(words: list[int]) -> np.ndarray:
    return np.array(words, "<u8").view("<f8")


def leading(x: int) -> int:
    return 64 - x.bit_length()


def trailing(x: int) -> int:
    return (x & -x).bit_length() - 1 if x else 64
