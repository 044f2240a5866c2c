"""Words of many texts at once, as arrays.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D, as ``bytes.split()`` has it. Texts are cut,
numbered and hashed in bulk, so that no object is made for a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: A random number for each byte value, and an odd one whose powers tell places in a word apart.
_BYTE = np.random.default_rng(20240917).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9FB21C651E98DF25)
MIX = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * SPREAD
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """The words of some texts one after another."""

    #: Bytes of all words, each followed by one space.
    spaced: np.ndarray
    #: Where each word begins in ``spaced``, and the end.
    starts: np.ndarray
    #: Number of words of each text.
    counts: np.ndarray

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, equal for equal words, and the words by number, each with its space."""
        wide = len(self.spaced) >= 1 << 31
        kind, offsets = (pa.large_binary(), self.starts) if wide else (pa.binary(), self.starts.astype(np.int32))
        coded = pa.Array.from_buffers(kind, len(self.starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(self.spaced)]).dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each word, and the hash of each number's word."""
        number, words = self.coded()
        return number, hashes(words)


def cut(texts: list[bytes]) -> Words:
    """The words of the texts."""
    joined = b"\n".join([*texts, b""])
    b = np.frombuffer(joined, np.uint8)
    inside = (b > 0x20) | ((b != 0x20) & (b - np.uint8(0x09) > 4))  # unsigned: smaller bytes wrap around
    if not inside.any():
        return Words(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(len(texts), np.int64))
    after = np.zeros(len(b), bool)  # the first byte behind a word
    after[1:] = inside[:-1] & ~inside[1:]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = np.flatnonzero(begins)
    held = inside | after
    spaced = np.where(inside, b, np.uint8(0x20))[held]
    ends = np.flatnonzero(spaced == 0x20) + 1  # words hold no spaces
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(spaced, np.concatenate([[0], ends]), np.diff(np.searchsorted(first, bounds)))


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the elements of a binary array."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    wide = pa.types.is_large_binary(words.type)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    lengths = np.diff(at)
    power = np.empty(int(lengths.max()) + 1, np.uint64)
    power[0] = 1
    np.multiply.accumulate(np.concatenate([power[:1], np.full(len(power) - 1, _BASE)]), out=power)
    inside = np.arange(len(b)) - np.repeat(at[:-1], lengths)
    out = np.add.reduceat(_BYTE[b] * power[inside], at[:-1]) if len(b) else np.zeros(n, np.uint64)
    return mixed(np.where(lengths > 0, out, 0) * MIX + lengths.astype(np.uint64))
