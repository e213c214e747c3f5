"""Similarity fingerprints of word lists, an Arrow batch at a time.

A feature costs one MD5; hashed one by one in Python it takes microseconds. Here the features of many texts are columns of bytes, and every step of
MD5 is one operation on thousands of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import floor, sin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Features hashed together; their columns stay in the processor's cache.
STEP = 1 << 14
#: The longest message that fits one block of MD5; longer ones are hashed one by one.
ONE_BLOCK = 55

_SUMS = [np.uint32(floor(2**32 * abs(sin(i + 1)))) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_WORDS = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_KEPT = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_CLOSED = np.array([0x80, 0x8000, 0x800000, 0x80000000, 0], np.uint32)
_LAST = np.uint64(2**64 - 1)


def _blocks(texts: pa.StringArray) -> tuple[list[np.ndarray | None], np.ndarray]:
    """The sixteen words of every text's padded block (None: zero for all), and the texts' lengths in bytes."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    used = int(ends[-1] - ends[0])
    data = np.zeros((used + 11) // 4 * 4, np.uint8)
    if used:
        data[:used] = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    at = np.empty(len(data) - 4, np.uint32)  # the four bytes from every place on
    for k in range(4):
        at[k::4] = data[k : k + len(data) - 4].view(np.uint32)
    start, size = ends[:-1] - ends[0], np.diff(ends)
    words: list[np.ndarray | None] = [None] * 16
    for j in range(min(int(size.max()), ONE_BLOCK) // 4 + 1):
        left = size - 4 * j
        held = left.clip(0, 4)
        words[j] = at[np.minimum(start + 4 * j, len(at) - 1)] & _KEPT[held] | np.where(left >= 0, _CLOSED[held], np.uint32(0))
    words[14] = (size * 8).astype(np.uint32)
    return words, size


def md5_halves(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """First and last eight bytes of every text's MD5, as big-endian numbers."""
    if not len(texts):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    words, size = _blocks(texts)
    a, b, c, d = (np.full(len(texts), x) for x in _START)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        a += _SUMS[i]
        word = words[_WORDS[i]]
        if word is not None:
            a += word
        turn = _TURNS[kind][i % 4]
        np.right_shift(a, 32 - turn, out=turned)
        a <<= turn
        a |= turned
        a += b
        a, b, c, d = d, a, b, c
    a, b, c, d = ((x + start).byteswap().astype(np.uint64) for x, start in zip((a, b, c, d), _START))
    high, low = a << np.uint64(32) | b, c << np.uint64(32) | d
    for i in np.flatnonzero(size > ONE_BLOCK):
        digest = hashlib.md5(texts[int(i)].as_py().encode(), usedforsecurity=False).digest()
        high[i], low[i] = int.from_bytes(digest[:8]), int.from_bytes(digest[8:])
    return high, low


def _features(lists: pa.ListArray, sizes: np.ndarray, offsets: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and MD5 halves of all features: the words at `offsets` from every place; of a list too short for that, all its words."""
    reach, flat = max(offsets), lists.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    last = np.cumsum(sizes)
    if reach == 0:  # single words repeat, so each is hashed once
        coded = flat.dictionary_encode()
        halves = [md5_halves(coded.dictionary.slice(at, STEP)) for at in range(0, len(coded.dictionary), STEP)]
        place = coded.indices.to_numpy(zero_copy_only=False)
        if halves:
            high, low = (np.concatenate(h) for h in zip(*halves))
            yield row, high[place], low[place]
    else:
        for at in range(0, max(len(flat) - reach, 0), STEP):
            count = min(STEP, len(flat) - reach - at)
            grams = pc.binary_join_element_wise(*(flat.slice(at + o, count) for o in offsets), " ")
            own = row[at : at + count]
            whole = np.arange(at, at + count) + reach < last[own]
            high, low = md5_halves(grams)
            yield own[whole], high[whole], low[whole]
    short = np.flatnonzero(sizes <= reach)
    short = short[lists.is_valid().to_numpy(zero_copy_only=False)[short]]
    for at in range(0, len(short), STEP):
        own = short[at : at + STEP]
        yield own, *md5_halves(pc.binary_join(lists.take(pa.array(own)), " "))


def fingerprints(lists: pa.ListArray, offsets: tuple[int, ...]) -> pa.StringArray:
    """Sixteen hex digits per list of words; null for null."""
    lists = lists.cast(pa.list_(pa.string()))  # Spark's lists may hold elements marked as not null
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    high_of, low_of = np.full(len(sizes) * 16, _LAST), np.full(len(sizes) * 16, _LAST)
    filled = np.zeros(len(sizes) * 16, bool)
    for row, high, low in _features(lists, sizes, offsets):
        slot = row * 16 + (high >> np.uint64(60)).astype(np.int64)
        before = high_of[slot]
        np.minimum.at(high_of, slot, high)
        best = high == high_of[slot]
        low_of[slot[best & (high < before)]] = _LAST
        np.minimum.at(low_of, slot[best], low[best])
        filled[slot] = True
    low_of, filled = low_of.reshape(-1, 16), filled.reshape(-1, 16)
    spare = np.take_along_axis(low_of, filled.argmax(axis=1)[:, None], axis=1) >> np.arange(60, -1, -4, dtype=np.uint64)
    digits = np.where(filled, low_of, spare) & np.uint64(15)
    chars = np.frombuffer(b"0123456789abcdef", np.uint8)[digits.astype(np.intp)]
    found = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(sizes), [None, pa.py_buffer(chars.tobytes())]).cast(pa.binary()).cast(pa.string())
    return pc.if_else(lists.is_valid(), found, pa.scalar(None, pa.string()))
