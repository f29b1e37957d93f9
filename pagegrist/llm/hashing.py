"""Vectorised 64-bit hashing of words and shingles on UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(2**62, 2**63)) | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes hashed at a time; bounds the memory of a batch whatever the length of its texts.
CHUNK = 1 << 19
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(CHUNK + 1, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _space(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (run without ASCII white space), and the n + 1 word offsets of the texts.

    A-Z count as a-z where lower holds. Texts do not run into each other.
    """
    found, starts_at = [], []
    table = _BYTE.copy()
    if lower:
        table[65:91] = table[97:123]
    power, inverse = _powers()
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    at, end = 0, len(data)
    while at < end:
        stop = min(end, at + CHUNK)
        if stop < end:  # cut where a word ends; a word longer than a chunk is hashed in parts
            gap = np.flatnonzero(_space(data[at + 1 : stop]) | edge[at + 1 : stop])
            if len(gap):
                stop = at + 1 + int(gap[-1])
            elif _space(data[at : at + 1])[0]:
                stop = at + 1
            else:
                stop, h = _long_word(data, edge, at, end), 0
                for x in range(at, stop, CHUNK):
                    part = table[data[x : min(stop, x + CHUNK)]]
                    h = (h + int((part * power[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, x - at, 2**64)) % 2**64
                found.append(np.array([h], np.uint64))
                starts_at.append(np.array([at], np.int64))
                at = stop
                continue
        part = data[at:stop]
        word = ~_space(part)
        begin = word.copy()
        begin[1:] &= ~word[:-1] | edge[at + 1 : stop]
        over = word.copy()
        over[:-1] &= ~word[1:] | edge[at + 1 : stop]
        s, e = np.flatnonzero(begin), np.flatnonzero(over) + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * power[: len(part)], out=total[1:])
        found.append((total[e] - total[s]) * inverse[s])
        starts_at.append(s + at)
        at = stop
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = np.concatenate(starts_at)
    return mix(np.concatenate(found)), np.searchsorted(starts, offsets)


def _long_word(data: np.ndarray, edge: np.ndarray, at: int, end: int) -> int:
    for x in range(at + 1, end, CHUNK):
        gap = np.flatnonzero(_space(data[x : x + CHUNK]) | edge[x : min(end, x + CHUNK)])
        if len(gap):
            return x + int(gap[0])
    return end


_PLACE = [np.uint64(int(x) | 1) for x in _RNG.integers(2**62, 2**63, 8)]


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of each run of so many words, in text order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += words[k : k + n] * _PLACE[k]
    return mix(out, 1)


def short_hash(words: np.ndarray) -> np.ndarray:
    """One shingle of a text with fewer words than a shingle has; none of a text without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return mix(np.array([(words * np.array(_PLACE[: len(words)])).sum(dtype=np.uint64)], np.uint64), 2 + len(words))


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The sorted distinct shingles of a text."""
    return np.unique(shingle_hashes(words, size)) if len(words) >= size else short_hash(words)


def text_shingle_set(text: str, size: int = 5) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    words, _ = word_hashes(data, np.array([0, len(data)], np.int64))
    return shingle_set(words, size)
