"""Vectorised word and shingle hashing over Arrow string columns.

Texts are read as UTF-8 bytes in place. A word is a run of bytes other than space and 0x09-0x0D; these bytes
never occur inside a multi-byte character, so byte runs and character runs agree. Word hashes are polynomial
hashes modulo 2**64 over a random byte table, finished by a mixing step; two different words share a hash with
a probability of about 2**-64."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=U)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of the texts of one column: text i has words bounds[i] up to bounds[i + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; null counts as empty."""
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, fold: bool) -> Words:
    """fold: A-Z count as a-z."""
    data, offsets = text_bytes(column)
    return runs(data, offsets, ~SPACES[data], fold)


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: bool = False) -> Words:
    """Runs of bytes where `inside` holds, with their hashes; a run never crosses a text's end."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, U))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n)
    values = (_FOLDED if fold else _TABLE)[data]
    values *= up[:n]
    values[~inside] = 0
    sums = np.add.reduceat(values, starts) if len(starts) else np.zeros(0, U)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), mix(sums * down[starts]))


_STEPS = mix(np.arange(1, 65, dtype=U)) | U(1)
_WHOLE = U(0xD6E8FEB86659FD93)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words in one text, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    for i in range(k):
        total += hashes[i : i + n] * _STEPS[i]
    return mix(total)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles, case-folded over A-Z; fewer words: the whole sequence as one; none: empty."""
    found = words(column, fold=True)
    for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True):
        own = found.hashes[a:b]
        if len(own) >= k:
            yield np.unique(windows(own, k))
        elif len(own):
            yield mix(np.array([(own * _STEPS[: len(own)]).sum(dtype=U) ^ (_WHOLE + U(len(own)))], U))
        else:
            yield own
