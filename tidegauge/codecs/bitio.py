"""Bits written most significant first, and read back."""

from __future__ import annotations

FLUSH = 1 << 12


class BitWriter:
    def __init__(self) -> None:
        self.done, self.acc, self.n = bytearray(), 0, 0

    def write(self, value: int, bits: int) -> None:
        self.acc = self.acc << bits | value
        self.n += bits
        if self.n >= FLUSH:
            left = self.n % 8
            self.done += (self.acc >> left).to_bytes(self.n // 8, "big")
            self.acc &= (1 << left) - 1
            self.n = left

    def getvalue(self) -> bytes:
        pad = -self.n % 8
        return bytes(self.done) + (self.acc << pad).to_bytes((self.n + pad) // 8, "big")


class BitReader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def read(self, bits: int) -> int:
        end = self.at + bits
        last = (end + 7) >> 3
        if last > len(self.data):
            raise ValueError("the block is cut short")
        word = int.from_bytes(self.data[self.at >> 3 : last], "big")
        self.at = end
        return word >> (last * 8 - end) & ((1 << bits) - 1)
