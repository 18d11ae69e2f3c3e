"""Packed number arrays and hashed words, for operators that move many numbers in few rows."""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard

_CACHE = 400_000
_level = zstandard.ZstdCompressor(level=1)
_open = zstandard.ZstdDecompressor()


def pack(a: np.ndarray, sorted_keys: bool = False) -> bytes:
    """An unsigned integer array as compressed byte planes; sorted keys are stored as differences."""
    if sorted_keys and len(a):
        a = np.concatenate([a[:1], np.diff(a)])
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize)
    return _level.compress(np.ascontiguousarray(raw.T).tobytes()) if len(a) else b""


def unpack(data: bytes | None, dtype: str, sorted_keys: bool = False) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(_open.decompress(data), np.uint8).reshape(size, -1)
    a = np.ascontiguousarray(raw.T).reshape(-1).view(dtype)
    return np.cumsum(a, dtype=dtype) if sorted_keys else a


class _Hashes(dict):
    """Word to 64-bit hash, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of a text: A-Z lower-cased, split at 0x20 and 0x09-0x0D."""
    parts = text.lower().split() if text else []
    return np.fromiter(map(_hashes.__getitem__, parts), np.uint64, len(parts))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of products become evenly spread keys."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
