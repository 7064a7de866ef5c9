"""Words of byte texts as arrays: places, hashes and endings, without Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
# Longest run of bytes handled at once, unless a word is longer.
PIECE = 4 << 20


def hashed_words(data: np.ndarray, offsets: np.ndarray):
    """Text number, 64 and 32 bits of hash, last two bytes and length of every word.

    Words are runs without ASCII white space, in ASCII lower case. The two hashes
    together tell words apart: eight bytes at a time go through odd multipliers.
    """
    n = len(data)
    buffer = np.zeros(n + 8, np.uint8)
    buffer[:n] = LOWER[data]
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.append(False, word[:-1]) if n else word
    after = np.append(word[1:], False) if n else word
    starts = np.flatnonzero(word & (~before | edge[:n]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    length = ends - starts
    eight = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=buffer, strides=(1,))
    a = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    live, at = np.arange(len(starts)), 0
    while len(live):
        rest = length[live] - at
        part = eight[starts[live] + at] & MASKS[np.minimum(rest, 8)]
        x = (a[live] ^ part) * np.uint64(0xC2B2AE3D27D4EB4F)
        a[live] = x ^ (x >> np.uint64(29))
        y = (b[live] ^ (part + np.uint64(at))) * np.uint64(0x165667B19E3779F9)
        b[live] = y ^ (y >> np.uint64(32))
        live, at = live[rest > 8], at + 8
    a *= np.uint64(0x9FB21C651E98DF25)
    a ^= a >> np.uint64(32)
    last = buffer[ends - 1].astype(np.int64) if len(ends) else length
    second = buffer[np.maximum(ends - 2, starts)].astype(np.int64) if len(ends) else length
    return text, a.view(np.int64), (b >> np.uint64(32)).astype(np.uint32).view(np.int32), last * 256 + second, length


def runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool, bool]]:
    """The texts, or a long single one in runs cut at white space; with first and last marked."""
    if len(offsets) != 2 or len(data) <= PIECE:
        yield data, offsets, True, True
        return
    begin = 0
    while begin < len(data):
        end = min(begin + PIECE, len(data))
        while end < len(data):
            gap = np.flatnonzero(SPACE[data[end : end + PIECE]])
            end = end + int(gap[0]) if len(gap) else min(end + PIECE, len(data))
            if len(gap):
                break
        yield data[begin:end], np.array([0, end - begin]), begin == 0, end == len(data)
        begin = end
