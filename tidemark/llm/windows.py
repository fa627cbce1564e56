"""Windows of a sequence, parsed at content-defined triggers.

A rolling hash is taken of every gram of a sequence. Each window of fixed length has as its trigger the gram inside
it with the least hash (the leftmost of equals), so equal windows have equal triggers at equal distances, wherever
they are. Neighbouring windows with one trigger make a phrase: the stretch from the first such window's start
to the last one's end. Every window belongs to exactly one phrase, and windows that are equal belong to phrases
with equal trigger hashes: what a phrase repeats is found among the few that share its trigger.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np

#: Positions taken at once; longer sequences are cut into overlapping parts, whatever their length; phrases stay whole.
PART = 1 << 18
_POSITION_BITS = 20
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U = np.uint64


@cache
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    base = _BASE[which] | 1
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, _U(b))
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


@cache
def byte_values(which: int) -> np.ndarray:
    """A random 64-bit number for every byte."""
    return np.random.default_rng(100 + which).integers(0, 1 << 64, 256, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


class Rolling:
    """Hashes of any stretch of ``values`` (64-bit numbers, one a symbol)."""

    def __init__(self, values: np.ndarray, which: int):
        self.up, self.down = _powers(which, PART * 2)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(values * self.up[: len(values)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


class Phrases(NamedTuple):
    """Of each phrase: the first and last start of its windows, its trigger's place, and the hashes of trigger and
    content (two, of independent numbers: with the trigger's, a phrase is known by 192 bits)."""

    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    trigger: np.ndarray
    content: np.ndarray
    content2: np.ndarray


@dataclass(frozen=True)
class Parser:
    """Windows of ``window`` symbols, triggers of ``gram`` symbols. A phrase's content is what its windows span, and
    at least ``reach`` symbols from its trigger on, as far as the sequence goes."""

    window: int
    gram: int
    reach: int = 0

    def phrases(self, values: tuple[np.ndarray, np.ndarray]) -> Phrases:
        """``values``: two independent random numbers for each symbol."""
        n = len(values[0])
        parts = [self._part(values, at, min(n, at + PART + self.window - 1)) for at in range(0, max(n - self.window + 1, 0), PART)]
        if not parts:
            none = np.zeros(0, np.int64)
            return Phrases(*[none] * 6)
        found = Phrases(*map(np.concatenate, zip(*parts, strict=True)))
        return self._joined(values, found) if len(parts) > 1 else found

    def _joined(self, values: tuple[np.ndarray, np.ndarray], p: Phrases) -> Phrases:
        """Phrases that a part's end has cut in two, whole again: neighbours with one trigger's place are one phrase."""
        heads = np.concatenate([[0], np.flatnonzero(np.diff(p.at)) + 1])
        tails = np.concatenate([heads[1:], [len(p.at)]]) - 1
        whole = Phrases(p.first[heads], p.last[tails], p.at[heads], p.trigger[heads], p.content[heads], p.content2[heads])
        for k in np.flatnonzero(heads != tails):  # one for each part's end at most
            one, first = slice(k, k + 1), whole.first[k]
            stretch = [v[first : max(whole.last[k] + self.window, whole.at[k] + self.reach)] for v in values]
            rolls = [Rolling(v, i) for i, v in enumerate(stretch)]
            whole.content[one], whole.content2[one] = self._contents(rolls, whole.first[one] - first, whole.last[one] - first, whole.at[one] - first)
        return whole

    def _part(self, values: tuple[np.ndarray, np.ndarray], lo: int, hi: int) -> Phrases:
        rolls = [Rolling(v[lo : hi + self.reach], i) for i, v in enumerate(values)]
        hashes = rolls[0].grams(self.gram)[: hi - lo - self.gram + 1]
        reach = self.window - self.gram + 1  # grams in a window
        places = np.arange(len(hashes), dtype=np.uint64)
        keys = (hashes >> _U(_POSITION_BITS) << _U(_POSITION_BITS)) | places
        at = (_sliding_minimum(keys, reach) & _U((1 << _POSITION_BITS) - 1)).astype(np.int64)
        change = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate([[0], change])
        last = np.concatenate([change, [len(at)]]) - 1
        place = at[first]
        return Phrases(first + lo, last + lo, place + lo, hashes[place].view(np.int64), *self._contents(rolls, first, last, place))

    def _contents(self, rolls: list[Rolling], first: np.ndarray, last: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of a phrase's symbols, of its trigger's place in it and of the number of its windows."""
        end = np.minimum(np.maximum(last + self.window, place + self.reach), len(rolls[0].sums) - 1)
        shape = _mix(((place - first).astype(np.uint64) << _U(32)) | (last - first).astype(np.uint64))
        return (rolls[1].of(first, end) + shape).view(np.int64), (rolls[0].of(first, end) + shape).view(np.int64)


def _sliding_minimum(keys: np.ndarray, reach: int) -> np.ndarray:
    """The least of every ``reach`` neighbours: running minima forwards and backwards inside blocks of ``reach``."""
    n = len(keys) - reach + 1
    padded = np.full(-(-len(keys) // reach) * reach, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[reach - 1 : reach - 1 + n])


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Maximal stretches covered by windows starting in ``[start, end)`` made into ``[start, end)`` themselves: sorted rows of two."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    s, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > reach[:-1]])
    lo = s[new]
    hi = np.concatenate([reach[np.flatnonzero(new)[1:] - 1], reach[-1:]])
    return np.minimum(np.stack([lo, hi], axis=1), n)
