"""Word shingles of many texts at once, as numpy arrays over Arrow lists of word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import words_of

#: Words of a shingle.
SHINGLE = 5
#: Words of the texts that are worked on together.
CHUNK = 600_000


def word_hashes(text) -> F.Column:
    """Array of 64-bit hashes of the words of ``text``, hashed by the JVM."""
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads its input over all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd factors for the places of a shingle.
FACTORS = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def chunks(column: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, flat word hashes, offsets) of runs of rows of about CHUNK words."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        to = min(to, n)
        yield at, to, values[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def shingles(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, owner, first) of all shingles of a chunk, in order.

    A text of fewer words than a shingle has one, of all its words; a text without words has none.
    """
    sizes = np.diff(offsets)
    counts = np.where(sizes > 0, np.maximum(sizes - SHINGLE + 1, 1), 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    padded = np.concatenate((words, np.zeros(SHINGLE, np.uint64)))
    out = np.zeros(len(first), np.uint64)
    end = offsets[1:][owner]
    short = sizes[owner] < SHINGLE
    for j in range(SHINGLE):
        part = padded[first + j]
        if short.any():
            part = np.where(short & (first + j >= end), np.uint64(0), part)
        out += part * FACTORS[j]
    return mixed(out), owner, first


def counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, how often) of the distinct shingles of each text."""
    keyed = mixed(hashes + mixed(owner.astype(np.uint64) + np.uint64(1)))
    _, at, often = np.unique(keyed, return_index=True, return_counts=True)
    return hashes[at], owner[at], often


def atoms(hashes: np.ndarray, owner: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(atom, owner): one 32-bit number for each occurrence, so that overlap of sets is overlap of multisets."""
    many = np.repeat(np.arange(len(hashes)), often)
    nth = np.arange(len(many)) - np.repeat(np.cumsum(often) - often, often)
    return (mixed(hashes[many] + mixed(nth.astype(np.uint64))) >> np.uint64(32)).astype(np.uint32).view(np.int32), owner[many]
