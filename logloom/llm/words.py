"""Words of many texts at once, as 64-bit numbers, by array operations on the UTF-8 bytes.

A word is a run of bytes of one class, A-Z folded to a-z. Its number is a polynomial of
random byte values with an odd base, scrambled; equal words have equal numbers in every
task, and two different ones collide with a chance of about 2**-64.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_class(separators: bytes) -> np.ndarray:
    """True for each byte that belongs to a word, given the bytes between words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


# Everything but space and tab to carriage return.
SPACED = byte_class(b" \t\n\v\f\r")
# Letters, digits and everything beyond ASCII.
ALPHANUMERIC = byte_class(bytes(b for b in range(128) if not chr(b).isalnum()))


@lru_cache(maxsize=1)
def _bytes_mixed() -> np.ndarray:
    values = scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    values[65:91] = values[97:123]
    return values


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column in a row, and where each begins (one more than texts); null is empty."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _segments(raw: np.ndarray, offsets: np.ndarray, in_word: np.ndarray):
    """Bounds of pieces of about SEGMENT bytes that cut no word."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + SEGMENT)
        while end < n:
            # The last place in the piece where no word goes on: a text's start or a separator.
            start = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            apart = np.flatnonzero(~in_word[raw[max(at, end - 4096) : end]])
            if start > at:
                end = max(start, max(at, end - 4096) + int(apart[-1]) + 1 if len(apart) else 0)
                break
            if len(apart):
                end = max(at, end - 4096) + int(apart[-1]) + 1
                break
            end = min(n, end + SEGMENT)
        yield at, end
        at = end


def word_spans(raw: np.ndarray, offsets: np.ndarray, in_word: np.ndarray, prefixes: tuple[int, ...] = ()):
    """Of each word: number, first byte, byte after its last; and where each text's words begin.

    With ``prefixes`` the number is a column of a table; the further columns hold the
    numbers of the word's first bytes, so many each, 0 where it has no more than these.
    """
    numbers, firsts, lasts = [], [], []
    mixed = _bytes_mixed()
    for at, end in _segments(raw, offsets, in_word):
        part = raw[at:end]
        inside = in_word[part]
        fresh = np.ones(len(part) + 1, bool)
        fresh[1:-1] = ~inside[:-1]
        starts = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        fresh[starts] = True
        first = np.flatnonzero(inside & fresh[:-1])
        over = fresh[1:].copy()
        over[:-1] |= ~inside[1:]
        last = np.flatnonzero(inside & over) + 1
        power, inverse = _powers(max(SEGMENT + 1, 1 << len(part).bit_length()))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(mixed[part] * power[: len(part)], out=total[1:])
        number = scramble((total[last] - total[first]) * inverse[first])
        if prefixes:
            parts = [number]
            for size in prefixes:
                part_of = scramble((total[np.minimum(first + size, last)] - total[first]) * inverse[first] + np.uint64(size))
                parts.append(np.where(last - first > size, part_of, np.uint64(0)))
            number = np.stack(parts, 1)
        numbers.append(number)
        firsts.append(first + at)
        lasts.append(last + at)
    if not numbers:
        none = np.zeros(0, np.int64)
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    first = np.concatenate(firsts)
    return np.concatenate(numbers), first, np.concatenate(lasts), np.searchsorted(first, offsets)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spelled(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The words at these places, A-Z in lower case, as an Arrow array."""
    sizes = last - first
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = LOWER[raw[np.arange(ends[-1]) + np.repeat(first - ends[:-1], sizes)]]
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def shingles(numbers: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the runs of ``size`` words of one text; a shorter text is one run, an empty one none."""
    n = len(numbers)
    if n == 0:
        return numbers
    wide = min(size, n)
    total = np.zeros(n - wide + 1, np.uint64)
    for i in range(wide):
        total = total * np.uint64(_BASE) + numbers[i : n - wide + 1 + i]
    return scramble(total + np.uint64(wide))


def text_blocks(offsets: np.ndarray, size: int):
    """Ranges of texts of about ``size`` bytes together; a longer text is a block of its own."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end
        at = end


def code_points(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many code points of ``raw`` begin before each of the byte ``places``."""
    begins = (raw & 0xC0) != 0x80
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(begins, out=total[1:])
    return total[places]
