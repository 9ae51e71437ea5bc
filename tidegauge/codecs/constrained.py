"""Codecs that use what is known of a series: its constraints, or the parts of its doubles.

A header states the constraints. The words that follow are, in this order of preference: indexes into
the enumeration, steps from the minimum, values scaled to integers, or the doubles' bits; a monotone
series takes differences of those. The decoded values are compared before a block is written, and one
that isn't exact is written from the bits instead.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, replace

import numpy as np

from .words import WORD, doubles_of, words_of

# Bits of the header's flags.
FLAGS = ("precision", "range", "monotonicity", "sign", "discrete", "enumeration", "sparse")
HEADER = "<BbBdddBI"


@dataclass(frozen=True)
class Constraints:
    """Of one series. precision -1: none; monotonicity 0 none, 1 / -1 monotone, 2 / -2 strictly so."""

    precision: int = -1
    min_value: float | None = None
    max_value: float | None = None
    enumeration: tuple[float, ...] = ()
    monotonicity: int = 0
    allow_positive: bool = True
    allow_negative: bool = True
    signed: bool = False
    step: float = 0.0
    sparse: bool = False

    def enabled(self) -> dict[str, bool]:
        found = (self.precision >= 0, self.min_value is not None, self.monotonicity != 0, self.signed, self.step > 0, bool(self.enumeration), self.sparse)
        return dict(zip(FLAGS, found))

    def pack(self) -> bytes:
        flags = sum(on << k for k, on in enumerate(self.enabled().values()))
        head = struct.pack(HEADER, flags, self.precision, self.monotonicity + 128, self.min_value or 0.0, self.max_value or 0.0, self.step, self.allow_positive | self.allow_negative << 1, len(self.enumeration))
        return head + struct.pack(f"<{len(self.enumeration)}d", *self.enumeration)

    @staticmethod
    def unpack(block: bytes) -> tuple[Constraints, int]:
        flags, precision, mono, low, high, step, sign, n = struct.unpack_from(HEADER, block)
        size = struct.calcsize(HEADER)
        on = {name: bool(flags >> k & 1) for k, name in enumerate(FLAGS)}
        out = Constraints(precision, low if on["range"] else None, high if on["range"] else None, struct.unpack_from(f"<{n}d", block, size), mono - 128, bool(sign & 1), bool(sign & 2), on["sign"], step, on["sparse"])
        return out, size + 8 * n


def detect(values: np.ndarray) -> Constraints:
    """What holds of one block: the rules of operators.constraints for a series without its texts."""
    from ..functions.decimals import decimal_places

    if not len(values) or not np.isfinite(values).all():
        return Constraints()
    low, high, steps = float(values.min()), float(values.max()), np.diff(values)
    places = max(map(decimal_places, np.unique(values).tolist()))
    _, first = np.unique(values, return_index=True)
    distinct = tuple(values[np.sort(first)].tolist())
    mono = 2 if (steps > 0).all() else 1 if (steps >= 0).all() else -2 if (steps < 0).all() else -1 if (steps <= 0).all() else 0
    jumps = np.unique(np.round(np.abs(steps[np.abs(steps) >= 1e-10]), 10))
    step = 0.0
    if len(jumps) and high > low and (least := float(jumps[0])) > (high - low) / 10000:
        whole = np.abs(jumps / least - np.floor(jumps / least + 0.5)) <= 1e-10
        if whole.all() and len(jumps) > 1 or len(jumps) <= 2 and len(jumps) < len(values) / 5:
            step = least
    few = len(distinct) <= max(1, len(values) // 100)
    pos, neg = bool((values > 0).any()), bool((values < 0).any())
    return Constraints(places if places <= 8 else -1, low, high, distinct if few else (), mono, pos, neg, not (pos and neg), step, bool((values == 0).mean() >= 0.9))


def to_words(values: np.ndarray, c: Constraints) -> list[int]:
    if c.enumeration:
        places = {v: k for k, v in reversed(list(enumerate(c.enumeration)))}
        table = np.array(c.enumeration)
        return [places[v] if v in places else int(np.abs(table - v).argmin()) for v in values.tolist()]
    if c.step > 0:
        words = [int((v - (c.min_value or 0.0)) / c.step + 0.5) for v in values.tolist()]
    elif c.precision >= 0:
        words = [int(v * 10**c.precision + (0.5 if v >= 0 else -0.5)) for v in values.tolist()]
    else:
        words = words_of(values)
    if c.monotonicity:
        words = [words[0], *(b - a for a, b in zip(words, words[1:]))] if words else []
    return [w & WORD for w in words]


def from_words(words: list[int], c: Constraints) -> np.ndarray:
    if c.enumeration:
        return np.array([c.enumeration[min(w, len(c.enumeration) - 1)] for w in words], np.float64)
    if c.monotonicity:
        total, words = 0, list(words)
        for k, w in enumerate(words):
            words[k] = total = (total + w) & WORD
    if c.step <= 0 and c.precision < 0:
        return doubles_of(words)
    signed = [w - (1 << 64) * (w >> 63) for w in words]
    if c.step > 0:
        scale = next((10**d for d in range(16) if abs(c.step * 10**d - round(c.step * 10**d)) < 1e-9), None)
        if scale:
            base, step = (c.min_value or 0.0) * scale, round(c.step * scale)
            if abs(base - round(base)) < 1e-6:
                return np.array([(round(base) + w * step) / scale for w in signed], np.float64)
        return np.array([(c.min_value or 0.0) + w * c.step for w in signed], np.float64)
    return np.array([w / 10**c.precision for w in signed], np.float64)


def encode(values: np.ndarray, back_end, constraints: Constraints | None = None) -> bytes:
    """Header, then the words by the back end (bytes to bytes). constraints None: detected."""
    c = detect(values) if constraints is None else constraints
    for tried in (c, replace(c, enumeration=()), replace(c, enumeration=(), step=0.0), Constraints(), ):
        try:
            words = to_words(values, tried)
            if words_of(from_words(words, tried)) == words_of(values):
                break
        except (OverflowError, ValueError):
            continue
    return tried.pack() + back_end(np.array(words, "<u8").tobytes())


def decode(block: bytes, back_end) -> np.ndarray:
    c, at = Constraints.unpack(block)
    return from_words(np.frombuffer(back_end(block[at:]), "<u8").tolist(), c)


def split_encode(values: np.ndarray) -> bytes:
    """Sign and mantissa by Chimp, exponent by simple8b, each with its length."""
    from .dictionary import simple8b_words_encode
    from .windowed import chimp_encode

    words = words_of(values)
    parts = [chimp_encode([w & ~(2047 << 52) for w in words]), simple8b_words_encode([w >> 52 & 2047 for w in words])]
    return b"".join(struct.pack("<I", len(p)) + p for p in parts)


def split_decode(block: bytes, n: int) -> np.ndarray:
    from .dictionary import simple8b_words_decode
    from .windowed import chimp_decode

    size = struct.unpack_from("<I", block)[0]
    mantissas, exponents = chimp_decode(block[4 : 4 + size], n), simple8b_words_decode(block[8 + size :], n)
    return doubles_of([m | e << 52 for m, e in zip(mantissas, exponents)])
