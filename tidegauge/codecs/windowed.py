"""Codecs that code each word against the one before: Gorilla (xor, difference, sum) and Chimp.

Gorilla: Pelkonen et al., 2015. Chimp and Chimp128: Liakos et al., 2022. Every block is stored with its
number of values, so no end mark is needed and NaN is data like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from .bitio import BitReader, BitWriter
from .words import WORD, leading, trailing

Combine = Callable[[int, int], int]


def gorilla_encode(words: list[int], combine: Combine) -> bytes:
    out, lead, trail = BitWriter(), None, 0
    for k, now in enumerate(words):
        if k == 0:
            out.write(now, 64)
            continue
        x = combine(now, words[k - 1])
        if x == 0:
            out.write(0, 1)
            continue
        lz, tz = leading(x), trailing(x)
        if lead is not None and lz >= lead and tz >= trail:
            out.write(0b10, 2)
            out.write(x >> trail, 64 - lead - trail)
        else:
            lead, trail = min(lz, 63), tz
            out.write(0b11 << 12 | lead << 6 | (64 - lead - trail) & 63, 14)
            out.write(x >> trail, 64 - lead - trail)
    return out.getvalue()


def gorilla_decode(data: bytes, n: int, restore: Combine) -> list[int]:
    bits, words, lead, trail = BitReader(data), [], 0, 0
    for k in range(n):
        if k == 0:
            words.append(bits.read(64))
        elif not bits.read(1):
            words.append(restore(0, words[-1]))
        else:
            if bits.read(1):
                lead = bits.read(6)
                trail = 64 - lead - (bits.read(6) or 64)
            words.append(restore(bits.read(64 - lead - trail) << trail, words[-1]))
    return words


# What is coded from (now, before), and how now comes back from (coded, before).
XOR = (lambda a, b: a ^ b, lambda x, b: x ^ b)
SUB = (lambda a, b: (a - b) & WORD, lambda x, b: (x + b) & WORD)
ADD = (lambda a, b: (a + b) & WORD, lambda x, b: (x - b) & WORD)


def chimp_encode(words: list[int]) -> bytes:
    out, last = BitWriter(), 0
    for k, now in enumerate(words):
        if k == 0:
            out.write(now, 64)
            continue
        x = now ^ words[k - 1]
        lead, tz = min(leading(x), 15) & ~1, trailing(x)
        if x == 0:
            out.write(0b00, 2)
        elif tz > 6:
            size = 64 - lead - tz
            out.write(0b01 << 9 | (lead // 2) << 6 | size & 63, 11)
            out.write(x >> tz, size)
        elif lead == last:
            out.write(0b10, 2)
            out.write(x, 64 - lead)
        else:
            out.write(0b11 << 3 | lead // 2, 5)
            out.write(x, 64 - lead)
        last = lead
    return out.getvalue()


def chimp_decode(data: bytes, n: int) -> list[int]:
    bits, words, last = BitReader(data), [], 0
    for k in range(n):
        if k == 0:
            words.append(bits.read(64))
            continue
        kind, x = bits.read(2), 0
        if kind == 0:
            last = 14
        elif kind == 1:
            last = bits.read(3) * 2
            size = bits.read(6) or 64
            x = bits.read(size) << (64 - last - size)
        else:
            if kind == 3:
                last = bits.read(3) * 2
            x = bits.read(64 - last)
        words.append(words[-1] ^ x)
    return words


#: Earlier values that Chimp128 looks at, and the low bits by which it finds one of them.
PREVIOUS, LOW_BITS = 128, 14
# The rounded numbers of leading zeros that three bits stand for.
ROUNDED = (0, 8, 12, 16, 18, 20, 22, 24)


def rounded(lead: int) -> int:
    return max(k for k, r in enumerate(ROUNDED) if r <= lead)


def chimp128_encode(words: list[int]) -> bytes:
    out, index, last = BitWriter(), {}, None
    low = (1 << LOW_BITS) - 1
    for k, now in enumerate(words):
        at = index.get(now & low)
        index[now & low] = k
        if k == 0:
            out.write(now, 64)
            continue
        near = at is not None and k - at <= PREVIOUS and trailing(now ^ words[at]) >= LOW_BITS
        x = now ^ words[at] if near else now ^ words[k - 1]
        slot = at % PREVIOUS if near else (k - 1) % PREVIOUS
        if x == 0:
            out.write(slot, 9)
            last = None
            continue
        code = rounded(leading(x))
        size = 64 - ROUNDED[code]
        if near:
            tz = trailing(x)
            out.write(((0b01 << 7 | slot) << 3 | code) << 6 | size - tz, 18)
            out.write(x >> tz, size - tz)
            last = None
        elif code == last:
            out.write(0b10, 2)
            out.write(x, size)
        else:
            out.write(0b11 << 3 | code, 5)
            out.write(x, size)
            last = code
    return out.getvalue()


def chimp128_decode(data: bytes, n: int) -> list[int]:
    bits, words, last = BitReader(data), [], 0

    def earlier(slot: int) -> int:
        """The latest value stored in the slot."""
        k = len(words) - 1
        return words[k - (k - slot) % PREVIOUS]

    for k in range(n):
        if k == 0:
            words.append(bits.read(64))
            continue
        kind = bits.read(2)
        if kind == 0:
            words.append(earlier(bits.read(7)))
        elif kind == 1:
            base = earlier(bits.read(7))
            code = bits.read(3)
            size = bits.read(6)
            words.append(base ^ bits.read(size) << (64 - ROUNDED[code] - size))
        else:
            if kind == 3:
                last = bits.read(3)
            words.append(words[-1] ^ bits.read(64 - ROUNDED[last]))
    return words


#: Words that tsxor looks back on.
WINDOW = 127


def tsxor_encode(words: list[int]) -> bytes:
    """A byte for a word seen lately; else its xor with the closest one, trimmed to bytes; else the word."""
    out = bytearray()
    for k, now in enumerate(words):
        recent = words[max(0, k - WINDOW) : k]
        best = (1, -1, 0, 0)  # zero bytes, place from the newest, length, trailing zero bytes
        for back, old in enumerate(reversed(recent)):
            x = now ^ old
            if x == 0:
                best = (9, back, 0, 0)
                break
            tz = trailing(x) // 8
            length = 8 - leading(x) // 8 - tz
            if 8 - length > best[0]:
                best = (8 - length, back, length, tz)
        zeros, back, length, tz = best
        if zeros == 9:
            out.append(back)
        elif back >= 0:
            out += bytes([0x80 | back, length << 4 | tz]) + (now ^ recent[-1 - back] & WORD).__rshift__(8 * tz).to_bytes(length, "big")
        else:
            out += b"\xff" + now.to_bytes(8, "big")
    return bytes(out)


def tsxor_decode(data: bytes, n: int) -> list[int]:
    words, at = [], 0
    for _ in range(n):
        head, at = data[at], at + 1
        if head == 0xFF:
            words.append(int.from_bytes(data[at : at + 8], "big"))
            at += 8
        elif head < 0x80:
            words.append(words[-1 - head])
        else:
            length, tz = data[at] >> 4, data[at] & 15
            words.append(words[-1 - (head & 0x7F)] ^ int.from_bytes(data[at + 1 : at + 1 + length], "big") << 8 * tz)
            at += 1 + length
    return words
