"""The digits of the suffix sort: windows of a text, dealt to runs by the smallest gram inside."""

from __future__ import annotations

import numpy as np

from .common import ship

ship(__name__)
WIDTH, GRAM = 100, 32
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the low bits of polynomial hashes over all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


class Hashes:
    """Hashes of any stretch of ``data`` from running sums of byte values times powers of a base."""

    tables: dict[int, np.ndarray] = {}

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        table = np.random.default_rng(which + 1).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        power, self.inverse = _powers(_BASE[which], len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = table[data]
        values *= power[:-1]
        np.cumsum(values, out=self.sums[1:])

    def of(self, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        h = self.sums[stop] - self.sums[start]
        h *= self.inverse[start]
        return mixed(h)


def leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` values the offset of its leftmost smallest one."""
    n = len(h) - width + 1
    value, place, have = h, np.zeros(len(h), np.uint8), 1
    while have < width:
        step = min(have, width - have)
        m = len(value) - step
        left, right = value[:m], value[step:]
        smaller = right < left
        place = np.where(smaller, place[step:] + np.uint8(step), place[:m])
        value = np.minimum(left, right)
        have += step
    return place[:n]


def runs(data: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of windows of ``width`` bytes in concatenated texts that end at ``ends``.

    A run is consecutive windows with the same anchor: the leftmost of the smallest gram hashes in
    the window, which depends on the window's bytes alone. Columns: ``doc`` (index of the text),
    ``at`` (first window, from the text's start), ``n`` (windows), ``h1`` (hash of the anchor gram),
    ``h2`` (hash of all bytes of the run, and where the anchor stands).
    """
    empty = {c: np.empty(0, k) for c, k in (("doc", np.int64), ("at", np.int64), ("n", np.int64),
                                             ("h1", np.int64), ("h2", np.int64))}
    if len(data) < width:
        return empty
    hashes = Hashes(data)
    grams = hashes.of(slice(0, len(data) - gram + 1), slice(gram, None))
    anchor = np.arange(len(data) - width + 1) + leftmost_minima(grams, width - gram + 1)
    begins = np.concatenate([[0], ends[:-1]])
    doc = np.repeat(np.arange(len(ends)), np.maximum(0, ends - begins - width + 1))
    valid = np.concatenate([np.arange(b, e - width + 1) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)
                            if e - b >= width] or [np.empty(0, np.int64)])
    if not len(valid):
        return empty
    anchor = anchor[valid]
    change = np.ones(len(valid), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(change)
    n = np.diff(np.append(first, len(valid)))
    start, doc = valid[first], doc[first]
    stretch = hashes.of(start, start + n + width - 1)
    stretch ^= (n * 131 + anchor[first] - start).astype(np.uint64) * _MIX
    return {"doc": doc, "at": start - begins[doc], "n": n, "h1": grams[anchor[first]].view(np.int64),
            "h2": mixed(stretch).view(np.int64)}
