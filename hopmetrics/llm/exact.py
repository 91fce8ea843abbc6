"""Exact products of integer matrices by float64 BLAS, and other whole-number helpers.

A matrix of 64-bit integers is split into limbs of so few bits that every dot product of
two limb matrices stays below 2^53, where float64 holds all integers. The limb products
are recombined by shifts in int64, whose wrap-around is exact modulo 2^64: the result is
right wherever the true one fits into 64 bits. What may not fit is worked out with
Python's integers instead (``object`` arrays).
"""

from __future__ import annotations

import numpy as np

LONG = 2**63 - 1
#: Integers from this magnitude on are refused by the operators on vectors.
WIDEST = 2**52


def largest(x: np.ndarray) -> int:
    """Largest magnitude in an integer array."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def scaled(v: np.ndarray, factor: int = 1024) -> np.ndarray:
    """floor(factor * v) as int64, from float64; the factor is a power of two."""
    x = np.floor(v * float(factor))
    if x.size and not np.abs(x).max() < WIDEST:
        raise ValueError(f"a component times {factor} reaches 2^52: its square has no place in a long")
    return x.astype(np.int64)


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 matrices l0, l1, ... with x = l0 + l1 * 2^bits + ..., entries within 2^(bits - 1)."""
    half = 1 << (bits - 1)
    out = []
    while True:
        low = ((x + half) & ((1 << bits) - 1)) - half
        out.append(low.astype(np.float64))
        x = (x - low) >> bits
        if not x.any():
            return out


def matmul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of int64 matrices, modulo 2^64; entries of a and b are under 2^62."""
    inner = max(1, a.shape[1])
    # inner * 2^(bits - 1) * 2^(bits - 1) <= 2^52
    bits = (52 - (inner - 1).bit_length()) // 2 + 1
    total = np.zeros((a.shape[0], b.shape[1]), np.int64)
    right = limbs(b, bits)
    for i, left in enumerate(limbs(a, bits)):
        for j, low in enumerate(right):
            shift = bits * (i + j)
            if shift < 64:
                total += (left @ low).astype(np.int64) << shift
    return total


def gram(y: np.ndarray) -> np.ndarray:
    """y.T @ y of an int64 matrix, in Python integers."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    if not len(y):
        return total
    square = max(1, largest(y)) ** 2
    if square > LONG:
        wide = y.astype(object)
        return wide.T.dot(wide)
    step = min(len(y), LONG // square)  # sums of so many products fit into a long
    for at in range(0, len(y), step):
        part = y[at : at + step]
        total += matmul(np.ascontiguousarray(part.T), part).astype(object)
    return total


def halves(values: list[int]) -> tuple[list[int], list[int]]:
    """High and low parts that sum up in longs: value = high * 2^32 + low."""
    return [v >> 32 for v in values], [v & 0xFFFFFFFF for v in values]


def whole(high: int, low: int) -> int:
    return (int(high) << 32) + int(low)
