"""ELF (Li et al., 2023): mantissa bits that the number of decimals makes redundant are set to zero.

A value with a decimal places keeps log2(10^a) bits after the point; rounding what is left up at the
a-th decimal gives the value back. What the decoder would do is tried before a value is erased, so a
value that wouldn't come back is kept as it is.
"""

from __future__ import annotations

import math
import struct
from decimal import ROUND_UP, Decimal

from .bitio import BitReader, BitWriter
from .words import leading, trailing

#: Decimals that four bits can tell; erasing fewer bits than this isn't worth its flag.
MOST_DECIMALS, WORTH = 15, 4


def decimals(value: float) -> int | None:
    """Decimal places of the shortest text that reads back as value."""
    if not math.isfinite(value):
        return None
    return max(0, -Decimal(repr(value)).as_tuple().exponent)


def to_bits(value: float) -> int:
    return struct.unpack("<Q", struct.pack("<d", value))[0]


def to_double(word: int) -> float:
    return struct.unpack("<d", struct.pack("<Q", word))[0]


def erase(word: int) -> tuple[int, int | None]:
    """The word with its redundant bits cleared, and its decimals; decimals None: nothing was cleared."""
    value = to_double(word)
    places = decimals(value)
    if value == 0 or places is None or places > MOST_DECIMALS:
        return word, None
    spare = 52 - math.ceil(places * math.log2(10)) - ((word >> 52 & 2047) - 1023)
    if spare <= WORTH or spare > 52:
        return word, None
    short = word >> spare << spare
    if short == word or restore(short, places) != word:
        return word, None
    return short, places


def restore(short: int, places: int) -> int:
    """Away from zero to the next number with so many decimals."""
    value = Decimal(to_double(short))
    return to_bits(float(value.quantize(Decimal(1).scaleb(-places), rounding=ROUND_UP)))


# Rounded numbers of leading zeros that three bits stand for.
ROUNDED = (0, 8, 12, 16, 18, 20, 22, 24)


def elf_encode(words: list[int]) -> bytes:
    """Flags: 0 erased, decimals as before; 11 erased, new decimals; 10 whole. Then the xor with the
    value before: 01 equal; 00 within the last window; 10 and 11 a new window of up to 16 or 64 bits."""
    out, places_before, lead, trail, before = BitWriter(), None, None, 0, 0
    for word in words:
        now, places = erase(word)
        if places is None:
            out.write(0b10, 2)
        elif places == places_before:
            out.write(0, 1)
        else:
            out.write(0b11 << 4 | places, 6)
            places_before = places
        x, before = now ^ before, now
        if x == 0:
            out.write(0b01, 2)
            continue
        code = max(k for k, r in enumerate(ROUNDED) if r <= leading(x))
        tz = trailing(x)
        if lead is not None and ROUNDED[code] >= lead and tz >= trail and tz - trail + ROUNDED[code] - lead < 12:
            out.write(0b00, 2)
        else:
            lead, trail = ROUNDED[code], tz
            size = 64 - lead - trail
            if size <= 16:
                out.write((0b10 << 3 | code) << 4 | size - 1, 9)
            else:
                out.write((0b11 << 3 | code) << 6 | size - 1, 11)
        out.write(x >> trail, 64 - lead - trail)
    return out.getvalue()


def elf_decode(data: bytes, n: int) -> list[int]:
    bits, words, places, lead, trail, before = BitReader(data), [], 0, 0, 0, 0
    for _ in range(n):
        erased = True
        if bits.read(1):
            erased = bool(bits.read(1))
            if erased:
                places = bits.read(4)
        kind = bits.read(2)
        if kind != 1:
            if kind >= 2:
                lead = ROUNDED[bits.read(3)]
                trail = 64 - lead - (bits.read(4 if kind == 2 else 6) + 1)
            before ^= bits.read(64 - lead - trail) << trail
        words.append(restore(before, places) if erased else before)
    return words
