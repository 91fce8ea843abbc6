"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The pivots of V - sI = L D L' have as many negative eigenvalues as V has eigenvalues below
s (Sylvester). Bisection on these counts isolates the eigenvalue of a wanted number;
Rayleigh quotient iteration from there converges cubically; counts on both sides of the
value reached certify that it is the one with that number. Vectors are kept orthogonal
to those found before, so that equal eigenvalues get an orthonormal basis.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(float).eps)
#: Pivot bound of Bunch and Kaufman, which keeps the growth of entries smallest.
_ALPHA = (1 + 17**0.5) / 8


def negatives(matrix: np.ndarray) -> int:
    """Number of negative eigenvalues, from the pivots (of one or two rows) of its LDL' factors."""
    a = np.array(matrix, float)
    n, k, found = len(a), 0, 0

    def swap(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        below = np.abs(a[k + 1 :, k])
        largest = float(below.max(initial=0.0))
        if largest == 0.0:  # the row stands alone
            found += a[k, k] < 0
            k += 1
            continue
        r = k + 1 + int(below.argmax())
        two = False
        if abs(a[k, k]) < _ALPHA * largest:
            other = np.abs(a[r, k:])
            other[r - k] = 0.0
            widest = float(other.max())
            if abs(a[k, k]) * widest < _ALPHA * largest**2:
                if abs(a[r, r]) >= _ALPHA * widest:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    two = True
        if two:
            pivot, side = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= side @ np.linalg.solve(pivot, side.T)
            found += 1  # such a pivot has one eigenvalue of either sign
            k += 2
        else:
            side = a[k + 1 :, k].copy()
            a[k + 1 :, k + 1 :] -= np.outer(side, side / a[k, k])
            found += a[k, k] < 0
            k += 1
    return int(found)


class Slices:
    """How many eigenvalues lie at or above a shift; every count narrows later searches."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix, self.d = matrix, len(matrix)
        bound = float(np.abs(matrix).sum(axis=1).max(initial=0.0)) * (1 + 8 * _EPS)
        self.norm = bound
        self.counts = {-2 * bound: self.d, 2 * bound: 0} if bound else {}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = self.d - negatives(self.matrix - shift * np.eye(self.d))
        return self.counts[shift]

    def around(self, k: int) -> tuple[float, float]:
        """Closest shifts known below and above eigenvalue k (from 1, falling)."""
        low = max(s for s, c in self.counts.items() if c >= k)
        return low, min(s for s, c in self.counts.items() if c < k and s > low)

    def isolated(self, k: int) -> bool:
        low, high = self.around(k)
        return self.counts[low] == k and self.counts[high] == k - 1


def _iterate(matrix: np.ndarray, shift: float, x: np.ndarray, basis: np.ndarray, floor: float) -> tuple[float, np.ndarray, float]:
    """Value, unit vector and residual by two inverse iterations and Rayleigh quotients from there."""
    eye = np.eye(len(matrix))
    best: tuple[float, float, np.ndarray] | None = None
    for step in range(30):
        try:
            y = np.linalg.solve(matrix - shift * eye, x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(matrix - (shift + floor) * eye, x)
        y /= np.abs(y).max()
        for _ in range(2):  # twice is enough
            y -= basis.T @ (basis @ y)
        x = y / np.linalg.norm(y)
        value = float(x @ matrix @ x)
        residual = float(np.linalg.norm(matrix @ x - value * x))
        if best is None or residual < best[0]:
            best = (residual, value, x)
        elif step > 3:
            break  # at the floor of rounding
        if step >= 1:
            shift = value
    return best[1], best[2], best[0]


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit vectors as rows."""
    slices = Slices(matrix)
    d = slices.d
    count = min(count, d)
    if not slices.norm:
        return np.zeros(count), np.eye(d)[:count]
    floor = d * _EPS * slices.norm
    random = np.random.default_rng(1)
    values, basis = np.zeros(0), np.zeros((0, d))
    for k in range(1, count + 1):
        while True:
            low, high = slices.around(k)
            narrow = high - low <= 2 * floor
            if narrow or slices.isolated(k):
                start = random.standard_normal(d)
                start -= basis.T @ (basis @ start)
                value, vector, residual = _iterate(matrix, (low + high) / 2, start / np.linalg.norm(start), basis, floor)
                room = max(floor, 2 * residual)
                if narrow or (residual < 1e-6 * slices.norm and low - room <= value <= high + room):
                    # Counts on both sides: eigenvalue k lies within ``room`` of the value.
                    if slices.above(value - room) >= k > slices.above(value + room):
                        break
                    if narrow:
                        raise ArithmeticError(f"eigenvalue {k} could not be certified")
            slices.above((low + high) / 2)
        values = np.append(values, value)
        basis = np.vstack([basis, vector])
    return values, basis
