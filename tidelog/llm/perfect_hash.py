"""Minimal perfect hashing of 64-bit keys, level by level, in shards.

In a level every key marks a bit; keys that have their bit alone are placed, the
others go on to the next, smaller level. A key's number is how many bits are set
before its own, so n keys get the numbers 0 to n - 1. Shards are built by
themselves and lie one behind the other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEVELS = 48
GAMMA = 2  # bits of a level for each of its keys
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A hash of keys for a level (-1: the one that deals to shards)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((level + 2) * _STEP & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def lot(keys: np.ndarray) -> np.ndarray:
    """A number below 65,536 by which keys are dealt to shards."""
    return (mixed(keys, -1) >> np.uint64(48)).astype(np.int32)


def shard_of(lots: np.ndarray, shards: int) -> np.ndarray:
    return lots.astype(np.int64) * shards >> 16


def build(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """Bits of each level, all levels' bits, and the keys in the order of their
    numbers. Keys are distinct."""
    sizes, words, ordered, left = [], [], [], keys
    for level in range(LEVELS):
        if not len(left):
            break
        size = 64 * (GAMMA * len(left) // 64 + 1)
        at = (mixed(left, level) % np.uint64(size)).astype(np.int64)
        held = np.bincount(at, minlength=size) == 1
        alone = held[at]
        ordered.append(left[alone][np.argsort(at[alone])])
        words.append(np.packbits(held, bitorder="little").tobytes())
        sizes.append(size)
        left = left[~alone]
    if len(left):
        raise ValueError("keys are not distinct")
    return sizes, b"".join(words), np.concatenate([keys[:0], *ordered])


@dataclass
class PerfectHash:
    """Shards put together: numbers for the keys of some of all shards."""

    shards: int
    begins: np.ndarray  # first bit of a level, by level and shard
    sizes: np.ndarray  # its bits, 0 where there is none
    words: np.ndarray
    before: np.ndarray  # bits set before each word
    keys: np.ndarray

    @classmethod
    def of(cls, shards: int, rows: list) -> PerfectHash:
        """From (shard, sizes, bits, keys) of each shard."""
        begins = np.zeros((LEVELS, shards), np.int64)
        sizes = np.zeros((LEVELS, shards), np.int64)
        words, keys, at = [], [], 0
        for shard, levels, bits, ordered in sorted(rows, key=lambda r: r[0]):
            for level, size in enumerate(levels):
                begins[level, shard], sizes[level, shard] = at, size
                at += size
            words.append(np.frombuffer(bits, np.uint64))
            keys.append(np.frombuffer(ordered, np.int64))
        words = np.concatenate([np.zeros(0, np.uint64), *words])
        ones = np.bitwise_count(words).astype(np.int64)
        return cls(
            shards, begins, sizes, words, np.cumsum(ones) - ones, np.concatenate([np.zeros(0, np.int64), *keys])
        )

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers, -1 for keys that were not hashed."""
        out = np.full(len(keys), -1, np.int64)
        left, shard = np.arange(len(keys)), shard_of(lot(keys), self.shards)
        for level in range(LEVELS):
            size = self.sizes[level, shard[left]]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            at = (mixed(keys[left], level) % size.astype(np.uint64)).astype(np.int64)
            at += self.begins[level, shard[left]]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            found = (word >> bit) & np.uint64(1) == 1
            below = word[found] & ((np.uint64(1) << bit[found]) - np.uint64(1))
            out[left[found]] = self.before[at[found] >> 6] + np.bitwise_count(below)
            left = left[~found]
        known = np.flatnonzero(out >= 0)
        out[known[self.keys[out[known]] != keys[known]]] = -1
        return out
