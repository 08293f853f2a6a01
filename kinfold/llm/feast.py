"""Leading eigenvectors of a symmetric matrix by contour integration (FEAST).

The spectrum is cut into intervals by inertia counts: as many eigenvalues lie above a shift as the factored shifted matrix has
positive pivots. For each interval, solves of the complex shifted matrix at the Gauss points of a circle
around it sum up to a filter that keeps the eigenvectors inside; Rayleigh-Ritz takes them out of the filtered subspace. An
interval is done only when as many are found as its inertia counts say.

The matrix is a covariance, so its size is the square of a vector's length, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np

POINTS = 8
ROUNDS = 40
#: Eigenvalues closer than this part of the norm are not told apart by an interval's end.
CLOSE = 1e-9


class Inertia:
    """Counts of eigenvalues above any shift. The matrix is made tridiagonal by reflections once; the signs of the pivots of
    the shifted tridiagonal's triangular factor then tell the count (Sylvester's law)."""

    def __init__(self, matrix: np.ndarray):
        left = matrix.astype(float)
        for k in range(len(left) - 2):
            mirror = left[k + 1 :, k].copy()
            mirror[0] += np.copysign(np.linalg.norm(mirror), mirror[0])
            if not (size := np.linalg.norm(mirror)):
                continue
            mirror /= size
            left[k + 1 :] -= 2 * np.outer(mirror, mirror @ left[k + 1 :])
            left[:, k + 1 :] -= 2 * np.outer(left[:, k + 1 :] @ mirror, mirror)
        self.diagonal, self.beside = np.diag(left).tolist(), [0.0, *(np.diag(left, 1) ** 2).tolist()]
        self.least = np.finfo(float).tiny / np.finfo(float).eps

    def above(self, shift: float) -> int:
        above, pivot = 0, 1.0
        for entry, beside in zip(self.diagonal, self.beside, strict=True):
            pivot = entry - shift - beside / pivot
            pivot = pivot if abs(pivot) > self.least else -self.least
            above += pivot > 0
        return above


def _filtered(matrix: np.ndarray, low: float, high: float, vectors: np.ndarray) -> np.ndarray:
    """The contour integral of the resolvent around [low, high], applied to vectors; the lower half circle is conjugate."""
    middle, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(vectors)
    for point, weight in zip(*np.polynomial.legendre.leggauss(POINTS), strict=True):
        turn = radius * np.exp(1j * np.pi / 2 * (point + 1))
        solved = np.linalg.solve((middle + turn) * np.eye(len(matrix)) - matrix, vectors.astype(complex))
        out += weight / 2 * (turn * solved).real
    return out


def in_interval(matrix: np.ndarray, low: float, high: float, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` eigenvalues of (low, high] and their vectors, by falling value."""
    size, norm = len(matrix), np.linalg.norm(matrix)
    columns = min(size, 2 * wanted + 4)
    while True:
        vectors = np.random.default_rng(0).standard_normal((size, columns))
        last = np.inf
        for _ in range(ROUNDS):
            basis, _ = np.linalg.qr(_filtered(matrix, low, high, vectors))
            values, turns = np.linalg.eigh(basis.T @ matrix @ basis)
            vectors = basis @ turns
            inside = np.flatnonzero((values > low) & (values <= high))
            errors = np.linalg.norm(matrix @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0)
            worst = errors.max(initial=0.0)
            # Rounds go on as long as they gain; what is left then is rounding.
            if len(inside) == wanted and worst <= 1e-10 * norm and worst >= last / 2:
                order = inside[np.argsort(-values[inside], kind="stable")]
                return values[order], vectors[:, order]
            last = worst
        if columns == size:
            raise RuntimeError(f"{wanted} eigenvalues between {low} and {high}, {len(inside)} found")
        columns = min(size, 2 * columns)


def _place(inertia: Inertia, norm: float, k: int, high: float) -> float:
    """Where the ``k``-th eigenvalue from above lies, by bisection on inertia counts."""
    low = -norm * (1 + CLOSE)
    while high - low > CLOSE / 4 * norm:
        middle = (low + high) / 2
        low, high = (middle, high) if inertia.above(middle) >= k else (low, middle)
    return (low + high) / 2


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues (all, if fewer) by falling value, and their unit vectors as columns.

    Each vector's entry of largest size is positive. Of equal eigenvalues, any orthonormal vectors will do.
    """
    size, norm = len(matrix), np.linalg.norm(matrix)
    count = min(count, size)
    if not count or not norm:
        return np.zeros(count), np.eye(size)[:, :count]
    gap, inertia = CLOSE * 1000 * norm, Inertia(matrix)
    # As far down as a gap below the last one wanted; what is closer than the gap shares an interval.
    places = [_place(inertia, norm, 1, norm * (1 + CLOSE))]
    while len(places) < size and (len(places) <= count or places[-2] - places[-1] <= gap):
        places.append(_place(inertia, norm, len(places) + 1, places[-1] + CLOSE * norm))
    below = np.array([*(places[k] - places[k + 1] for k in range(len(places) - 1)), norm])
    lasts = [k for k in range(len(places)) if below[k] > gap]
    values, vectors, first, high = [], [], 0, places[0] + max(min(below[lasts[0]], norm), gap) / 2
    for last in lasts:
        if first >= count:
            break
        low = places[last] - below[last] / 2
        wanted = inertia.above(low) - inertia.above(high)
        own, turned = in_interval(matrix, low, high, wanted)
        values.append(own)
        vectors.append(turned)
        first, high = last + 1, low
    value, vector = np.concatenate(values)[:count], np.hstack(vectors)[:, :count]
    sign = np.sign(vector[np.argmax(np.abs(vector), axis=0), np.arange(vector.shape[1])])
    return value, vector * sign
