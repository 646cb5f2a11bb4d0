"""Content-defined anchors of byte texts, for operator 8's candidate search.

Every window of ``WINDOW`` bytes has an anchor: the place of its smallest hash of ``GRAM`` bytes (all of them, if
several are equal). The choice depends on the window's bytes alone, so equal windows have anchors at equal places.
An anchor's segment is all that a window which holds it can reach, within its document.
"""

from __future__ import annotations

import numpy as np

WINDOW, GRAM = 50, 16
REACH = WINDOW - GRAM
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(v: np.ndarray) -> np.ndarray:
    v = v ^ (v >> np.uint64(32))
    v *= np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xA0761D6478BD642F)
    v ^= v >> np.uint64(32)
    return v


def running(f, v: np.ndarray, size: int) -> np.ndarray:
    """f over v[i : i + size], for every i where that fits."""
    have, out = 1, v
    while have < size:
        step = min(have, size - have)
        out = f(out[: len(out) - step], out[step:])
        have += step
    return out


class Anchored:
    """Anchors of several documents at once: place, key (of the GRAM bytes), segment [left, right), its hash."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        self.flat = flat = np.frombuffer(b"".join(texts), np.uint8)
        n = len(flat)
        self.start = start = np.cumsum(size) - size
        self.place = np.zeros(0, np.int64)
        if n < WINDOW:
            self.doc, self.left, self.right, self.key, self.segment = (self.place,) * 5
            return
        # prefix sums of bytes times falling powers: the hash of any stretch is a difference times a power
        up = np.full(n + 1, BASE, np.uint64)
        up[0] = 1
        up = np.cumprod(up, dtype=np.uint64)
        down = np.full(n, BACK, np.uint64)
        down[0] = 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * np.cumprod(down, dtype=np.uint64), dtype=np.uint64, out=sums[1:])
        stretch = lambda a, b: (sums[b] - sums[a]) * up[a]
        gram = mixed((sums[GRAM:] - sums[:-GRAM]) * up[: n - GRAM + 1])
        low = running(np.minimum, gram, REACH + 1)
        # windows that cross a document's end do not count: their minimum is set to 0, under which no hash lies
        for s in start[1:]:
            low[max(0, s - WINDOW + 1) : s] = 0
        padded = np.concatenate([np.zeros(REACH, np.uint64), low, np.zeros(REACH, np.uint64)])
        self.place = np.flatnonzero(running(np.maximum, padded, REACH + 1) == gram)
        self.doc = np.searchsorted(start, self.place, "right") - 1
        # an empty document starts where its successor does
        first, end = start[self.doc], start[self.doc] + size[self.doc]
        self.left, self.right = np.maximum(first, self.place - REACH), np.minimum(end, self.place + WINDOW)
        self.key = gram[self.place].view(np.int64)
        shape = ((self.place - self.left) * 64 + self.right - self.place).astype(np.uint64)
        self.segment = mixed(stretch(self.left, self.right) ^ mixed(shape + np.uint64(1))).view(np.int64)
