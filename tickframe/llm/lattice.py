"""E8 lattice hashing of unit vectors: projections, nearest lattice points, neighbouring cells."""

from __future__ import annotations

import itertools

import numpy as np


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row of ``x`` (n x 8), doubled so that all coordinates are whole numbers.

    E8 is D8 (whole coordinates, even sum) together with D8 shifted by a half.
    """
    whole, half = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.rint(2 * np.where(nearer[:, None], half, whole)).astype(np.int64)


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates of even sum: round, and on an odd sum move the worst coordinate."""
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return r


def minimal_vectors() -> np.ndarray:
    """The 240 shortest E8 vectors, doubled: the steps to the neighbouring cells."""
    pairs = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-2, 2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            pairs.append(v)
    halves = [v for v in itertools.product((-1, 1), repeat=8) if sum(c < 0 for c in v) % 2 == 0]
    return np.array(pairs + halves, np.int64)


class LatticeHash:
    """``tables`` hash tables of ``blocks`` E8 points each; a cell is named by one 64-bit key."""

    def __init__(self, dim: int, tables: int, blocks: int, probes: int, scale: float, seed: int):
        rng = np.random.default_rng(seed)
        self.tables, self.blocks, self.probes, self.scale = tables, blocks, probes, scale
        self.planes = rng.standard_normal((tables * blocks, dim, 8))
        self.shift = rng.uniform(0, 2, (tables * blocks, 8))
        self.mix = rng.integers(1, 1 << 62, (tables * blocks, 8), dtype=np.int64) | 1
        self.steps = minimal_vectors()

    def keys(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``home`` (n x tables) and ``near`` (n x tables x probes): the keys of each vector's own cells
        and of the neighbouring cells closest to it."""
        n = len(unit)
        home = np.zeros((n, self.tables), np.int64)
        near = np.zeros((n, self.tables, self.probes), np.int64)
        for t in range(self.tables):
            best_gap, parts = [], []
            for b in range(self.blocks):
                k = t * self.blocks + b
                x = unit @ self.planes[k] * self.scale + self.shift[k]
                point = decode_e8(x)
                part = (point * self.mix[k]).sum(1)  # wraps: a linear hash of the lattice point
                gain = (2 * x - point) @ self.steps.T  # larger: the step's cell lies closer
                top = np.argpartition(-gain, self.probes, axis=1)[:, :self.probes]
                best_gap.append(np.take_along_axis(gain, top, 1))
                parts.append((self.steps[top] * self.mix[k]).sum(2))
                home[:, t] += part
            gap, step = np.concatenate(best_gap, 1), np.concatenate(parts, 1)
            top = np.argsort(-gap, axis=1, kind="stable")[:, :self.probes]
            near[:, t] = home[:, t, None] + np.take_along_axis(step, top, 1)
        tag = np.arange(1, self.tables + 1, dtype=np.int64) * np.int64(0x9E3779B97F4A7C1)
        return _scramble(home + tag), _scramble(near + tag[:, None])


def _scramble(k: np.ndarray) -> np.ndarray:
    u = k.astype(np.uint64)
    u ^= u >> np.uint64(31)
    u *= np.uint64(0xBF58476D1CE4E5B9)
    u ^= u >> np.uint64(27)
    return u.astype(np.int64)
