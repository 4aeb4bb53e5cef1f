"""Similarities of many pairs of strings at once: NumPy over all pairs of a batch, step by step of the longest string."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Cells of a table that a step works on: pairs of like lengths are taken together up to that.
CELLS = 1 << 18
#: From this length on, letters that take more than a hundredth of the reference string don't start a match.
LONG, SHARE = 200, 100


class Strings:
    """Distinct strings as code points: string i is codes[starts[i] : starts[i] + lengths[i]]."""

    def __init__(self, strings: Sequence[str]):
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if len(strings) else np.zeros(0, np.int64)
        self.codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)

    def padded(self, starts: np.ndarray, lengths: np.ndarray, filler: int) -> np.ndarray:
        """A row for each part of the strings, with a filler behind it."""
        at = np.arange(lengths.max(initial=0))
        inside = at < lengths[:, None]
        out = np.full(inside.shape, filler, np.uint32)
        out[inside] = self.codes[(starts[:, None] + at)[inside]]
        return out


def lowered(strings: Sequence[str]) -> list[str]:
    """All in lower case, in one call: a line end stands between two and has no case."""
    if any("\n" in s for s in strings):
        return [s.lower() for s in strings]
    return "\n".join(strings).lower().split("\n") if len(strings) else []


def _chunks(a: np.ndarray, b: np.ndarray):
    """Positions of pairs of like lengths whose table has about CELLS cells."""
    order = np.lexsort((b, a))
    start = 0
    while start < len(order):
        end, width = start, 1
        size = min(len(order) - start, CELLS)
        width = np.maximum.accumulate(b[order[start : start + size]] + 1)
        fits = np.searchsorted(width * np.arange(1, size + 1), CELLS, "right")
        end = start + max(1, int(fits))
        yield order[start:end]
        start = end


def _popular(s: Strings) -> np.ndarray:
    """For each place of long strings whether its letter is too frequent to start a match."""
    out = np.zeros(len(s.codes), bool)
    for i in np.flatnonzero(s.lengths >= LONG):  # strings, not pairs
        own = s.codes[s.starts[i] : s.starts[i] + s.lengths[i]]
        _, which, counts = np.unique(own, return_inverse=True, return_counts=True)
        out[s.starts[i] : s.starts[i] + s.lengths[i]] = counts[which] > s.lengths[i] // SHARE + 1
    return out


def _longest(x: np.ndarray, y: np.ndarray, usable: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of code points the start in x, the start in y and the length of the longest common run: of several the one that ends first in x, then in y. usable: places of y that count."""
    best = np.zeros(len(x), np.int32)
    i_end, j_end = np.zeros(len(x), np.int32), np.zeros(len(x), np.int32)
    run = np.zeros((len(x), y.shape[1] + 1), np.int32)
    rows = np.arange(len(x))
    for i in range(x.shape[1]):
        same = x[:, i, None] == y
        if usable is not None:
            same &= usable
        longer = run[:, :-1] + 1
        longer *= same
        run[:, 1:] = longer
        j = longer.argmax(axis=1)
        top = longer[rows, j]
        better = top > best
        best[better], i_end[better], j_end[better] = top[better], i + 1, j[better] + 1
    return i_end - best, j_end - best, best


def _extended(s: Strings, t: Strings, part: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> None:
    """Lengthens matches (i, j, k) at both ends by equal letters, in place: what too frequent letters have kept short."""
    a, alo, ahi, b, blo, bhi = part.T
    for back in (True, False):
        live = np.arange(len(k))
        while len(live):
            x, y = (i[live] - 1, j[live] - 1) if back else (i[live] + k[live], j[live] + k[live])
            inside = (x >= alo[live]) & (y >= blo[live]) if back else (x < ahi[live]) & (y < bhi[live])
            live, x, y = live[inside], x[inside], y[inside]
            same = s.codes[s.starts[a[live]] + x] == t.codes[t.starts[b[live]] + y]
            live = live[same]
            k[live] += 1
            if back:
                i[live] -= 1
                j[live] -= 1


def matched(s: Strings, t: Strings, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters in matching runs of each pair (s[a], t[b]): the longest common run, and so on to its left and right."""
    total = np.zeros(len(a), np.int64)
    popular = _popular(t)
    zero = np.zeros(len(a), np.int64)
    pair, parts = np.arange(len(a)), np.stack([a, zero, s.lengths[a], b, zero, t.lengths[b]], axis=1)
    while len(parts):
        next_pair, next_parts = [], []
        for some in _chunks(parts[:, 2] - parts[:, 1], parts[:, 5] - parts[:, 4]):
            part, of = parts[some], pair[some]
            sa, sb = s.starts[part[:, 0]] + part[:, 1], t.starts[part[:, 3]] + part[:, 4]
            la, lb = part[:, 2] - part[:, 1], part[:, 5] - part[:, 4]
            x, y = s.padded(sa, la, 0xFFFFFFFE), t.padded(sb, lb, 0xFFFFFFFF)
            long = t.lengths[part[:, 3]] >= LONG
            usable = None
            if long.any():
                at = np.arange(y.shape[1])
                inside = at < lb[:, None]
                usable = np.ones(y.shape, bool)
                usable[inside] = ~popular[(sb[:, None] + at)[inside]]
            i, j, k = (v.astype(np.int64) for v in _longest(x, y, usable))
            i += part[:, 1]
            j += part[:, 4]
            if usable is not None:
                _extended(s, t, part, i, j, k)
            np.add.at(total, of, k)
            for lo in (True, False):
                sides = np.stack([part[:, 0], part[:, 1], i, part[:, 3], part[:, 4], j] if lo else [part[:, 0], i + k, part[:, 2], part[:, 3], j + k, part[:, 5]], axis=1)
                live = (k > 0) & (sides[:, 1] < sides[:, 2]) & (sides[:, 4] < sides[:, 5])
                next_parts.append(sides[live])
                next_pair.append(of[live])
        parts, pair = np.concatenate(next_parts), np.concatenate(next_pair)
    return total


def ratios(s: Strings, t: Strings, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ratcliff/Obershelp similarity of pairs (s[a], t[b]); t holds the reference strings, and the order matters. Two empty strings are alike."""
    sizes = s.lengths[a] + t.lengths[b]
    return np.where(sizes == 0, 1.0, 2.0 * matched(s, t, a, b) / np.maximum(sizes, 1))


def levenshteins(s: Strings, t: Strings, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One less the edit distance as a share of the longer string."""
    la, lb = s.lengths[a], t.lengths[b]
    distance = np.zeros(len(a), np.int64)
    for some in _chunks(la, lb):
        x, y = s.padded(s.starts[a[some]], la[some], 0xFFFFFFFE), t.padded(t.starts[b[some]], lb[some], 0xFFFFFFFF)
        at = np.arange(y.shape[1] + 1, dtype=np.int32)
        row = np.repeat(at[None, :], len(some), axis=0)
        found = lb[some].astype(np.int32)
        for i in range(x.shape[1]):
            new = np.empty_like(row)
            new[:, 0] = i + 1
            new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (x[:, i, None] != y))
            row = np.minimum.accumulate(new - at, axis=1) + at
            ended = la[some] == i + 1
            found[ended] = row[ended, lb[some][ended]]
        distance[some] = found
    longest = np.maximum(la, lb)
    return np.where(longest == 0, 1.0, 1 - distance / np.maximum(longest, 1))
