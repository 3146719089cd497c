"""Hashed indicator features of a text."""

from __future__ import annotations

import numpy as np

BITS = 18
#: Words whose hashes a task remembers before it starts anew.
REMEMBERED = 150_000
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - BITS)


class Words(dict):
    """64-bit hash of a word; remembers a bounded number."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


def hashes(memo: Words, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def words_of(text: str) -> list[bytes]:
    """Words of [^ \\x09-\\x0D]+, A-Z lower-cased."""
    return text.encode().lower().split()


def ngrams(text: str, memo: Words) -> np.ndarray:
    """Distinct indices below 2**BITS of words, pairs of words, and 3 bytes in sequence."""
    w = hashes(memo, words_of(text))
    raw = np.frombuffer(text.encode(), np.uint8)
    parts = [(w * A) >> _SHIFT]
    if w.size > 1:
        parts.append(((w[:-1] * A + w[1:]) * B) >> _SHIFT)
    if raw.size > 2:
        seen = np.zeros(1 << 24, bool) if raw.size > 1 << 20 else None
        code = raw[:-2].astype(np.uint32) << 16 | raw[1:-1].astype(np.uint32) << 8 | raw[2:]
        if seen is None:
            code = np.unique(code)
        else:
            seen[code] = True
            code = np.flatnonzero(seen)
        parts.append((code.astype(np.uint64) * B * A) >> _SHIFT)
    return np.unique(np.concatenate(parts)).astype(np.int32)
