"""Vectorised 64-bit mixing and a minimal perfect hash over 64-bit keys."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit finaliser of ``x`` (uint64), another for each seed."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True) + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)
        x ^= x >> U64(29)
        x *= U64(0xA0761D6478BD642F)
        x ^= x >> U64(32)
    return x


class PerfectHash:
    """Minimal perfect hash: levels of bit arrays; a key stands at the first level where it is alone in its slot.

    ``words`` holds all levels' bits in 64-bit words, ``ranks`` the set bits before each word. About 3.5 bits a key.
    """

    GAMMA, LEVELS = 1.6, 256  # a level leaves under half of its keys, so distinct ones are done within some 70

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct uint64; repeated ones, which no level could tell apart, raise."""
        left, sizes, parts = keys, [], []
        while len(left):
            if len(sizes) == cls.LEVELS:
                raise ValueError(f"{len(left)} of {len(keys)} keys are not told apart in {cls.LEVELS} levels: are some the same?")
            size = max(64, -(-int(len(left) * cls.GAMMA) // 64) * 64)
            slot = (mix(left, len(sizes)) % U64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[slot]]
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; a key that was not built in gets some slot or -1: compare fingerprints."""
        out, at = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(at):
                break
            bit = (mix(keys[at], level) % U64(size)).astype(np.int64) + self.starts[level]
            word, shift = bit >> 6, (bit & 63).astype(U64)
            hit = (self.words[word] >> shift) & U64(1) == 1
            w, s = word[hit], shift[hit]
            out[at[hit]] = self.ranks[w] + np.bitwise_count(self.words[w] & ((U64(1) << s) - U64(1)))
            at = at[~hit]
        return out
