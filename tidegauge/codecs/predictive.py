"""FPC (Burtscher and Ratanaworabhan, 2009): two hash-table predictors, the better one xored away."""

from __future__ import annotations

from .words import WORD, leading

SLOTS = 16


class Predictors:
    """FCM predicts the value that followed this context last time, DFCM the difference."""

    def __init__(self) -> None:
        self.values, self.steps = [0] * SLOTS, [0] * SLOTS
        self.h = self.d = self.last = 0

    def guesses(self) -> tuple[int, int]:
        return self.values[self.h], (self.steps[self.d] + self.last) & WORD

    def learn(self, now: int) -> None:
        step = (now - self.last) & WORD
        self.values[self.h], self.steps[self.d] = now, step
        self.h = (self.h << 6 ^ now >> 48) % SLOTS
        self.d = (self.d << 2 ^ step >> 40) % SLOTS
        self.last = now


def fpc_encode(words: list[int]) -> bytes:
    """Four bits a value (predictor, zero bytes), two values to a byte, then the bytes that are left."""
    state, heads, rest = Predictors(), [], bytearray()
    for now in words:
        x = [now ^ g for g in state.guesses()]
        zeros = [leading(v) // 8 for v in x]
        which = int(zeros[1] > zeros[0])
        count = min(zeros[which], 7)
        heads.append(which << 3 | count)
        rest += x[which].to_bytes(8, "big")[count:]
        state.learn(now)
    heads += [0] * (len(heads) % 2)
    return bytes(a << 4 | b for a, b in zip(heads[::2], heads[1::2])) + bytes(rest)


def fpc_decode(data: bytes, n: int) -> list[int]:
    state, words, at = Predictors(), [], (n + 1) // 2
    for k in range(n):
        head = data[k // 2] >> (0 if k % 2 else 4) & 15
        size = 8 - (head & 7)
        now = state.guesses()[head >> 3] ^ int.from_bytes(data[at : at + size], "big")
        at += size
        words.append(now)
        state.learn(now)
    return words
