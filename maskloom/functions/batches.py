"""Token arrays in Arrow batches: lists as flat values and lengths, digests of many short keys.

Spark runs a lambda over an array element by element, uncompiled; for work on every token of a
corpus these helpers take a whole batch of rows at once, inside an Arrow function of a narrow stage.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of all lists behind each other, how many each has, and which lists are null."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), lengths, column.is_null().to_numpy(zero_copy_only=False)


def lists(values: np.ndarray | pa.Array, lengths: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The opposite of ``flat``."""
    offsets = pa.array(ends(lengths), pa.int32())
    mask = pa.array(null) if null is not None and null.any() else None
    return pa.ListArray.from_arrays(offsets, values if isinstance(values, pa.Array) else pa.array(values), mask=mask)


def ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def places(lengths: np.ndarray) -> np.ndarray:
    """The place of each value in its list."""
    return np.arange(lengths.sum()) - np.repeat(ends(lengths)[:-1], lengths)


#: rows of a batch that are worked on at a time
SLICE_ROWS = 256


def in_slices(rows: pa.Array, work: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``work`` on a few rows at a time, so that what it holds on the way stays small."""
    parts = [work(rows.slice(low, SLICE_ROWS)) for low in range(0, len(rows), SLICE_ROWS)]
    return pa.concat_arrays(parts) if parts else work(rows)


def joined(rows: pa.Array) -> pa.Array:
    """The numbers of each list as one string, blanks between them; null numbers are left out."""
    values, lengths, null = flat(rows)
    if values.null_count:
        there = values.is_valid().to_numpy(zero_copy_only=False)
        values, lengths = values.drop_null(), np.diff(ends(there)[ends(lengths)])
    # a number is written once, however often it occurs; the words of a list lie behind each other
    coded = values.dictionary_encode()
    words = pc.binary_join_element_wise(coded.dictionary.cast(pa.string()), "", " ").take(coded.indices)
    starts = np.frombuffer(words.buffers()[1], np.int32)[ends(lengths)] if len(words) else np.zeros(len(rows) + 1, np.int32)
    texts = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(starts), words.buffers()[2]])
    texts = pc.binary_slice(texts, 0, -1).cast(pa.string())
    return pc.if_else(pa.array(null), None, texts) if null.any() else texts


def firsts(hit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The place of the first hit in each list, -1 where there is none."""
    found = np.full(len(lengths), -1)
    at = np.flatnonzero(hit)[::-1]
    owner = np.searchsorted(ends(lengths), at, "right") - 1
    # of several assignments to a list the last one stays
    found[owner] = at - ends(lengths)[owner]
    return found


def code_points(texts: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts behind each other and how many each has. With ``table`` its
    entries instead, by lead byte: an ASCII character is its lead byte."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    wide = data >= 0x80
    if wide.any():
        lead = (data & 0xC0) != 0x80
        lengths = np.diff(ends(lead)[offsets])
        if table is not None:
            return table[data[lead]], lengths
        return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.int32), lengths
    return data.astype(np.int32) if table is None else table[data], np.diff(offsets)


_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_AT_ONCE = 1 << 14


def _md5_blocks(m: np.ndarray) -> np.ndarray:
    """MD5 of messages of one block each; ``m`` has a row for each of the 16 words."""
    used = m.any(axis=1)
    a, b, c, d = (np.full(m.shape[1], x, np.uint32) for x in _START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        f += _SINES[i]
        if used[_WORDS[i]]:
            f += m[_WORDS[i]]
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=t)
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return np.stack([x + np.uint32(y) for x, y in zip((a, b, c, d), _START)])


def digests(keys: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """MD5 of ``key|0``, ``key|1`` and so on, ``lengths`` of them for each key: a row for each of
    the four groups of eight hex digits, as numbers."""
    own = [k.encode() + b"|" for k in keys.to_pylist()]
    heads = np.frombuffer(b"".join(k[:56].ljust(56, b"\0") for k in own), np.uint8).reshape(-1, 56)
    sizes = np.array([len(k) for k in own], np.int64)
    row, number = np.repeat(np.arange(len(own)), lengths), places(lengths)
    out = np.empty((4, len(row)), np.uint32)
    for low in range(0, len(row), _AT_ONCE):
        r, n = row[low : low + _AT_ONCE], number[low : low + _AT_ONCE]
        digits = np.ones(len(n), np.int64)
        power = 10
        while power <= n.max():
            digits += n >= power
            power *= 10
        size = sizes[r] + digits
        if size.max() > 55:
            # longer than a block
            found = [hashlib.md5(own[i] + str(j).encode()).digest() for i, j in zip(r.tolist(), n.tolist())]
            out[:, low : low + len(r)] = np.frombuffer(b"".join(found), ">u4").reshape(-1, 4).T
            continue
        message = np.zeros((len(r), 64), np.uint8)
        message[:, :56] = heads[r]
        at, rest = np.arange(len(r)), n
        for place in range(int(digits.max())):
            held = digits > place
            message[at[held], (size - 1 - place)[held]] = 48 + rest[held] % 10
            rest = rest // 10
        message[at, size] = 0x80
        message.view("<u4")[:, 14] = size * 8
        out[:, low : low + len(r)] = _md5_blocks(np.ascontiguousarray(message.view("<u4").T)).byteswap()
    return out
