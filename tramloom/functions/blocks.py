"""Common blocks of many pairs of texts at once.

The similarity of two texts is the share of their letters in common blocks: the longest common stretch (of equals the
first in the one text, then in the other), then the same on either side of it. All pairs take each step together: a
round finds the longest stretch of every piece that is left, by one running count for each letter of the first text.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: From this length of its second text on, the standard library leaves out frequent letters, and so do we.
AUTOJUNK = 200
CELLS, PAIRS = 1_000_000, 100_000


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts one after another, where each begins, and its length."""
    length = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    flat = flat.astype(np.int16 if flat.max(initial=0) < 1 << 15 else np.int32)  # half the bytes for most scripts
    return flat, np.cumsum(length) - length, length


def _padded(flat: np.ndarray, start: np.ndarray, length: np.ndarray, pad: int) -> np.ndarray:
    """A column a piece, a row a place; ``pad`` behind its end."""
    place = np.arange(int(length.max(initial=0)))[:, None]
    return np.where(place < length, flat[np.minimum(start + place, len(flat) - 1)], flat.dtype.type(pad))


def longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, start in a, start in b) of the longest common stretch of each column."""
    wide, n = b.shape
    bits, kind = (7, np.int16) if len(a) < 127 else (16, np.int32)
    base = 1 << bits
    run, new = np.zeros((wide + 1, n), kind), np.zeros((wide + 1, n), kind)
    # of each place in b the best so far: its length, then how early it starts in a
    best, code = np.zeros((wide, n), kind), np.empty((wide, n), kind)
    equal = np.empty((wide, n), bool)
    for i in range(len(a)):
        np.equal(b, a[i], out=equal)
        np.add(run[:-1], 1, out=new[1:])
        np.multiply(new[1:], equal, out=new[1:])
        run, new = new, run
        np.multiply(run[1:], kind(base + 1), out=code)
        code += kind(base - 2 - i)
        np.maximum(best, code, out=best)
    j = best.argmax(0)
    top = best[j, np.arange(n)]
    length = (top >> bits).astype(np.int64)
    first = (base - 1) - (top & kind(base - 1)).astype(np.int64)
    return length, first, j + 1 - length


def common_at(fa: np.ndarray, sa: np.ndarray, la: np.ndarray, fb: np.ndarray, sb: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Letters in common blocks of each pair of stretches, given by start and length; under 200 letters in the second and
    under 30,000 in the first."""
    total = np.zeros(len(sa), np.int64)
    for begin in range(0, len(sa), PAIRS):
        pair = begin + np.flatnonzero((la[begin : begin + PAIRS] > 0) & (lb[begin : begin + PAIRS] > 0))
        x, y, p, q = sa[pair], sb[pair], la[pair], lb[pair]
        while len(pair):
            order = np.lexsort((q, p))
            pair, x, y, p, q = (v[order] for v in (pair, x, y, p, q))
            left, at = [], 0
            while at < len(pair):
                # pieces of like length share arrays of bounded size
                end = int(np.searchsorted(p, p[at] + 2 + p[at] // 8, "right"))
                end = min(end, at + max(1, CELLS // int(q[at:end].max() + 1)))
                s, t, u, v = x[at:end], y[at:end], p[at:end], q[at:end]
                k, i, j = longest(_padded(fa, s, u, -1), _padded(fb, t, v, -2))
                np.add.at(total, pair[at:end], k)
                for m, n, c, d in ((s, t, i, j), (s + i + k, t + j + k, u - i - k, v - j - k)):
                    ok = (k > 0) & (c > 0) & (d > 0)
                    left.append((pair[at:end][ok], m[ok], n[ok], c[ok].astype(np.int64), d[ok].astype(np.int64)))
                at = end
            pair, x, y, p, q = (np.concatenate(v) for v in zip(*left))
    return total


def common(a: list[str], b: list[str]) -> np.ndarray:
    """Letters in common blocks of each pair."""
    (fa, sa, la), (fb, sb, lb) = letters(a), letters(b)
    long_ = (lb >= AUTOJUNK) | (la >= 30_000)
    total = common_at(fa, sa, np.where(long_, 0, la), fb, sb, np.where(long_, 0, lb))
    for i in np.flatnonzero(long_).tolist():
        total[i] = sum(x.size for x in SequenceMatcher(None, a[i], b[i]).get_matching_blocks())
    return total


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Share of both texts in common blocks, from 0 to 100; 0 if one is blank. Equal pairs are worked out once."""
    number: dict[tuple[str, str], int] = {}
    which = np.array([number.setdefault(p, len(number)) for p in zip(a, b)], np.int64)
    if not number:
        return np.zeros(0)
    xs, ys = map(list, zip(*number))
    size = np.array([len(x) + len(y) for x, y in number], np.float64)
    blank = np.array([not x.strip() or not y.strip() for x, y in number])
    out = 100.0 * (2.0 * common(xs, ys) / np.maximum(size, 1))
    out[blank] = 0.0
    return out[which]
