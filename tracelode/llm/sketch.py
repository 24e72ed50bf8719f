"""SetSketch registers of shingle sets.

Every element gives each of the m registers one value in (0, 1); in ascending order they fall into the intervals
[j/m, (j+1)/m), and the order in which an element visits the registers is a permutation of its own. A register keeps the
minimum, and the exponential quantile of the minimum is cut to a step of a geometric scale: K = floor(1 - log_b(x)). Minima
of unions are minima of minima, so sketches merge. An element is followed only as far as it can still lower a register.
"""

from __future__ import annotations

import numpy as np

from . import wordhash

REGISTERS, BASE = 128, 1.02
BANDS = 32


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 [sets, REGISTERS]; the registers of an empty set are 0."""
    m, n = REGISTERS, len(sets)
    low = np.full(n * m, 1.0)
    sizes = np.array([len(x) for x in sets])
    h = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), sizes)
    first = wordhash.mix64(h + np.uint64(0x51ED2701))
    at, step = (first & np.uint64(m - 1)).astype(np.int64), ((first >> np.uint64(20)) & np.uint64(m - 1) | np.uint64(1)).astype(np.int64)
    for j in range(m):
        if not len(h):
            break
        u = (wordhash.mix64(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)) * 2.0**-53
        np.minimum.at(low, row * m + (at + j * step) % m, (j + u) / m)
        going = (low.reshape(n, m).max(axis=1) > (j + 1) / m)[row]
        if not going.all():
            h, row, at, step = h[going], row[going], at[going], step[going]
    x = -np.log1p(-np.minimum(low, 1 - 2.0**-53))
    k = np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)) + 4096  # the offset makes all values positive
    k = np.clip(k, 1, 65535).astype(np.uint16).reshape(n, m)
    k[sizes == 0] = 0
    return k


def band_keys(k: np.ndarray) -> np.ndarray:
    """int64 [sets, BANDS]: a hash of the band's number and its register values."""
    v = k.reshape(len(k), BANDS, -1).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), v.shape[:2]).copy()
    for i in range(v.shape[2]):
        out = wordhash.mix64(out * np.uint64(0xA0761D6478BD642F) + v[:, :, i])
    return out.view(np.int64)


def _p(x):
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


_GRID = np.linspace(0, 1, 101)


def _reaches(up, down, total, ratio, least, doubt):
    """For counts of greater and less registers and a size ratio: is the best similarity from `least` on plausible enough?"""
    u, v = (ratio / (1 + ratio))[:, None], (1 / (1 + ratio))[:, None]
    most = np.minimum(u / v, v / u)  # no two sets are more similar than their sizes allow
    j = np.minimum(_GRID, most)
    up, down = up[:, None], down[:, None]
    pu, pd = np.maximum(_p(np.maximum(u - v * j, 0)), 1e-12), np.maximum(_p(np.maximum(v - u * j, 0)), 1e-12)
    like = up * np.log(pu) + down * np.log(pd) + (total - up - down) * np.log(np.maximum(1 - pu - pd, 1e-12))
    high = np.where((j >= least) | (j >= most), like, -np.inf).max(1)
    return high >= like.max(1) - doubt


def may_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float = 0.75, doubt: float = 14.0) -> np.ndarray:
    """Whether the similarity of two sets of known sizes may be `least` or more, by the joint likelihood of how many
    registers are greater, less and equal. A pair is given up only if some similarity explains its registers exp(doubt) times
    better than any from `least` on; 14 makes that wrong for about one pair in ten million. Pairs whose sizes differ too much are given up for certain."""
    na, nb = np.asarray(na, float), np.asarray(nb, float)
    ok = np.minimum(na, nb) >= least * np.maximum(na, nb) - 1e-9
    up, down = (a > b).sum(1), (a < b).sum(1)
    # Equal counts at nearly equal size ratios are judged once.
    step = np.round(np.log2(na / nb) * 64).astype(np.int64)
    kinds, where = np.unique(np.stack([up, down, step], 1), axis=0, return_inverse=True)
    return ok & _reaches(kinds[:, 0], kinds[:, 1], a.shape[1], 2.0 ** (kinds[:, 2] / 64), least, doubt)[where.ravel()]
