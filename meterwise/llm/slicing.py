"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

By Sylvester's law the factors L D Lᵀ of V - s I have as many positive pivots as V has eigenvalues
above s. Halving intervals by these counts isolates every wanted eigenvalue. Rayleigh quotient
iteration, whose solves use the same factors, converges from inside its interval cubically, and two
more counts, just below and just above the value found, prove its number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

_EPS = np.finfo(float).eps
_ALPHA = (1 + math.sqrt(17)) / 8
# Eigenvalues closer than this share of the matrix norm are found together, as one subspace.
TOGETHER = 1e-10
# An eigenpair has settled when its residual is below so many units of rounding.
_SETTLED = 1024


class Factors:
    """P (V - s I) Pᵀ = L D Lᵀ with complete pivoting; D has blocks of one or two rows."""

    def __init__(self, matrix: np.ndarray, shift: float):
        size = len(matrix)
        a = matrix - shift * np.eye(size)
        self.order, self.lower, self.blocks = np.arange(size), np.eye(size), []
        tiny = _EPS * max(float(np.abs(a).max(initial=0.0)), np.finfo(float).tiny)
        k = 0
        while k < size:
            rest = np.abs(a[k:, k:])
            d = int(np.argmax(np.diagonal(rest)))
            p, q = divmod(int(np.argmax(rest)), size - k)
            if rest[d, d] >= _ALPHA * rest[p, q]:
                self._swap(a, k, k + d)
                pivot = a[k, k] if abs(a[k, k]) > tiny else math.copysign(tiny, a[k, k])
                column = a[k + 1 :, k] / pivot
                a[k + 1 :, k + 1 :] -= np.outer(column * pivot, column)
                self.lower[k + 1 :, k] = column
                self.blocks.append((k, np.array([[pivot]])))
                k += 1
            else:
                p, q = min(p, q), max(p, q)
                self._swap(a, k, k + p)
                self._swap(a, k + 1, k + q)
                block = a[k : k + 2, k : k + 2].copy()
                under = a[k + 2 :, k : k + 2]
                columns = under @ np.linalg.inv(block)
                a[k + 2 :, k + 2 :] -= columns @ under.T
                self.lower[k + 2 :, k : k + 2] = columns
                self.blocks.append((k, block))
                k += 2

    def _swap(self, a: np.ndarray, i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            self.lower[[i, j], :i] = self.lower[[j, i], :i]
            self.order[[i, j]] = self.order[[j, i]]

    def positive(self) -> int:
        """How many eigenvalues lie above the shift. A block of two has one on either side."""
        return sum(1 if len(b) == 2 else int(b[0, 0] > 0) for _, b in self.blocks)

    def solve(self, right: np.ndarray) -> np.ndarray:
        y = right[self.order].copy()
        for k in range(len(y)):
            y[k + 1 :] -= np.multiply.outer(self.lower[k + 1 :, k], y[k])
        for k, block in self.blocks:
            y[k : k + len(block)] = np.linalg.solve(block, y[k : k + len(block)])
        for k in range(len(y) - 1, -1, -1):
            y[k] -= self.lower[k + 1 :, k] @ y[k + 1 :]
        out = np.empty_like(y)
        out[self.order] = y
        return out


@dataclass(frozen=True)
class Slice:
    """Eigenvalues numbered `above + 1` to `upto` by falling size lie between low and high."""

    low: float
    high: float
    above: int
    upto: int


def slices(matrix: np.ndarray, wanted: int, floor: float) -> list[Slice]:
    """Intervals that hold one wanted eigenvalue each, or several closer than TOGETHER."""
    bound = float(np.abs(matrix).sum(axis=1).max(initial=0.0)) * (1 + 1e-12)
    if bound <= floor:
        return []
    todo = [Slice(floor, bound, 0, Factors(matrix, floor).positive())]
    done = []
    while todo:
        s = todo.pop()
        if s.upto <= s.above or s.above >= wanted:
            continue
        if s.upto - s.above == 1 or s.high - s.low <= TOGETHER * bound:
            done.append(s)
            continue
        middle = (s.low + s.high) / 2
        count = Factors(matrix, middle).positive()
        todo += [Slice(s.low, middle, count, s.upto), Slice(middle, s.high, s.above, count)]
    return sorted(done, key=lambda s: s.above)


def _start(size: int, count: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((size, count))


def _without(vector: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in found:
            vector = vector - (other @ vector) * other
    return vector / np.linalg.norm(vector)


def _one(matrix: np.ndarray, s: Slice, bound: float, near: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """The eigenpair of a slice with one eigenvalue."""
    low, high = s.low, s.high
    while True:
        shift = (low + high) / 2
        factors = Factors(matrix, shift)
        vector = _without(_start(len(matrix), 1)[:, 0], near)
        for _ in range(2):
            vector = _without(factors.solve(vector), near)
        value, best = float(vector @ matrix @ vector), math.inf
        while low < value <= high:
            residual = float(np.linalg.norm(matrix @ vector - value * vector))
            if residual < best:
                best, kept = residual, (value, vector)
            if residual > best or best <= 16 * _EPS * bound:
                break
            vector = _without(Factors(matrix, value).solve(vector), near)
            value = float(vector @ matrix @ vector)
        # the residual falls from step to step; only a settled one is worth a proof
        if best <= _SETTLED * _EPS * bound:
            margin = 4 * _SETTLED * _EPS * bound
            value, vector = kept
            if (
                Factors(matrix, value - margin).positive() >= s.upto
                and Factors(matrix, value + margin).positive() <= s.above
            ):
                return value, vector
        # left its interval, or settled on another eigenvalue: halve and begin again
        if high - low <= 4 * _EPS * bound:
            return min(max(value, low), high), vector
        if factors.positive() >= s.upto:
            low = shift
        else:
            high = shift


def _several(matrix: np.ndarray, s: Slice, near: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """The eigenpairs of a slice too narrow to part: inverse iteration on a block, then its own axes."""
    factors = Factors(matrix, (s.low + s.high) / 2)
    block = _start(len(matrix), s.upto - s.above)
    for _ in range(4):
        for other in near:
            block = block - np.outer(other, other @ block)
        block, _ = np.linalg.qr(factors.solve(block))
    for other in near:
        block = block - np.outer(other, other @ block)
    block, _ = np.linalg.qr(block)
    values, axes = np.linalg.eigh(block.T @ matrix @ block)
    return [(float(v), block @ axes[:, i]) for i, v in sorted(enumerate(values), key=lambda x: -x[1])]


def leading(matrix: np.ndarray, wanted: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Up to `wanted` largest eigenvalues above `floor`, falling, and their unit vectors as columns.

    The entry of largest size of every vector is positive.
    """
    bound = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    pairs: list[tuple[float, np.ndarray]] = []
    for s in slices(matrix, wanted, floor):
        near = [v for e, v in pairs if e - s.high <= 1e-3 * bound]
        pairs += [_one(matrix, s, bound, near)] if s.upto - s.above == 1 else _several(matrix, s, near)
    pairs = pairs[:wanted]
    vectors = [v * math.copysign(1.0, v[np.argmax(np.abs(v))]) for _, v in pairs]
    return np.array([e for e, _ in pairs]), np.array(vectors).T.reshape(len(matrix), len(pairs))
