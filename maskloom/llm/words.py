"""Word positions and 64-bit hashes of words and word windows, in numpy.

A word is a maximal run of bytes other than space and the control characters 9 to 13,
in the UTF-8 form of a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@dataclass
class Words:
    """The words of several texts: word ``i`` is ``data[start[i]:end[i]]`` and belongs to
    text ``t`` when ``first[t] <= i < first[t + 1]``."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def read_words(texts: list[bytes | None]) -> Words:
    """Words of the texts; a null text has none."""
    data = b"\n".join(x or b"" for x in texts) + b"\n"
    codes = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[codes]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=np.int8(1)))
    start, end = edge[0::2], edge[1::2]
    # hash of a word: sum of byte values times powers, read off a running sum
    with np.errstate(over="ignore"):
        power = np.full(len(codes), _ODD, dtype=np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[codes] * power, dtype=np.uint64)])
        back = np.full(len(codes), _INVERSE, dtype=np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        value = mixed((total[end] - total[start]) * back[start])
    ends = np.cumsum([len(x or b"") + 1 for x in texts])
    first = np.concatenate([[0], np.searchsorted(start, ends)]) if len(texts) else np.zeros(1, np.int64)
    return Words(data, start, end, first, value)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, and whether they lie in one text."""
    n = len(words.hash)
    value = np.zeros(n, np.uint64)
    room = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(n) >= size
    if n >= size:
        with np.errstate(over="ignore"):
            power = np.full(n, _ODD, dtype=np.uint64)
            power[:1] = 1
            np.multiply.accumulate(power, out=power)
            back = np.full(n, _INVERSE, dtype=np.uint64)
            back[:1] = 1
            np.multiply.accumulate(back, out=back)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * power, dtype=np.uint64)])
            value[: n - size + 1] = mixed((total[size:] - total[:-size]) * back[: n - size + 1])
    return value, room
