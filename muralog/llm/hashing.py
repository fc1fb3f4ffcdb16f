"""Word hashes of whole texts straight from their bytes, with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Texts are hashed in blocks of about this many bytes, cut at white space.
BLOCK_BYTES = 1 << 21

SPACE, WORD, MARK = 0, 1, 2
# White space is \t to \r and the blank; everything else is part of a word.
WORDS = np.full(256, WORD, np.uint8)
WORDS[[9, 10, 11, 12, 13, 32]] = SPACE
# The same, but runs of ASCII punctuation are words of their own.
WORDS_AND_MARKS = WORDS.copy()
WORDS_AND_MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = MARK

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it can be divided by
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        with np.errstate(over="ignore"):
            known = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, BLOCK_BYTES + 4096) - 1, base)]), dtype=np.uint64)
        _powers[int(base)] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finishing steps of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings without NULLs one after another, and where each text ends."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def words_of(texts: pa.Array, classes: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end (bytes) of each lower-cased (A-Z) word, and the number of words up to each text's end."""
    data, ends = text_bytes(texts)
    found = []
    begin = 0
    while begin < len(data):
        end = min(len(data), begin + BLOCK_BYTES)
        while end < len(data):  # go on to white space, so that no word is cut
            spaces = np.flatnonzero(classes[data[end:end + BLOCK_BYTES]] == SPACE)
            if len(spaces):
                end += int(spaces[0])
                break
            end = min(len(data), end + BLOCK_BYTES)
        found.append(_block(data[begin:end], ends - begin, classes, begin))
        begin = end
    hashes, starts, stops = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return hashes, starts, stops, np.searchsorted(starts, ends, side="left")


def _block(data: np.ndarray, ends: np.ndarray, classes: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = classes[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[ends[(ends > 0) & (ends < len(data))]] = True  # a word does not go on in the next text
    edges = np.flatnonzero(edge)
    words = kind[edges[:-1]] != SPACE
    starts, stops = edges[:-1][words], edges[1:][words]
    with np.errstate(over="ignore"):
        running = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(data)), out=running[1:])
        # Divided by the power at the word's start, so that a word hashes alike everywhere.
        hashes = mix((running[stops] - running[starts]) * _power_table(_INVERSE, len(data))[starts])
    return hashes, starts + at, stops + at


def shingle_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each `length` consecutive words; a shingle may run over the end of a text."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    n = len(words) - length + 1
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for i in range(1, length):
            out = out * _BASE + words[i:i + n]
        return mix(out)
