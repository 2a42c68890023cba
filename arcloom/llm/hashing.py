"""Word and shingle hashes of Arrow text columns, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text array (null: empty) and the offsets of its rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def is_blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z in lower case), and the offsets of each row's words.

    The bytes are taken in segments cut between words, so memory follows the segment and not the longest text."""
    hashes, rows, begin, n = [], [], 0, len(data)
    while begin < n:
        end = min(begin + SEGMENT, n)
        while end < n and not is_blank(data[end - 1 : end])[0] and at[np.searchsorted(at, end)] != end:
            stop = int(at[np.searchsorted(at, end)])
            near = np.flatnonzero(is_blank(data[end : min(stop, end + 65536)]))
            end = end + int(near[0]) + 1 if len(near) else min(stop, end + 65536)
        part = data[begin:end]
        part = part + ((part >= 65) & (part <= 90)).astype(np.uint8) * np.uint8(32)
        ink = ~is_blank(part)
        first = ink.copy()
        first[1:] &= ~ink[:-1]
        cuts = at[np.searchsorted(at, begin) : np.searchsorted(at, end)] - begin
        first[cuts] |= ink[cuts]
        starts = np.flatnonzero(first)
        if len(starts):
            own = part[ink]
            heads = np.flatnonzero(first[ink])
            sizes = np.diff(np.append(heads, len(own)))
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), BASE)]))
            place = np.arange(len(own)) - np.repeat(heads, sizes)
            hashes.append(mixed(np.add.reduceat(BYTE[own] * powers[place], heads) ^ (sizes.astype(np.uint64) * PLACE[63])))
            rows.append(np.searchsorted(at, starts + begin, side="right") - 1)
        begin = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(rows), np.arange(len(at)))


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes; fewer words than width give one shingle, no words none."""
    words, edge = word_hashes(data, at)
    n = max(0, len(words) - width + 1)
    whole = np.full(n, PLACE[width + 32])
    for j in range(width):
        whole += words[j : j + n] * PLACE[j]
    whole = mixed(whole)
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            out.append(mixed(np.array([(words[a:b] * PLACE[: b - a]).sum()], dtype=np.uint64) + PLACE[b - a + 32 : b - a + 33]))
        else:
            out.append(words[:0])
    return out
