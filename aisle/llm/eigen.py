"""Leading eigenpairs of a symmetric matrix: tridiagonal form, bisection by Sturm counts, inverse iteration.

The matrix is a covariance over dimensions, so its size does not grow with the rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Eigenvalues closer than this share of the norm form a cluster, whose vectors are made orthogonal to each other.
CLUSTER = 1e-3
#: Solves of an inverse iteration; one or two are enough unless the start happens to miss the vector.
SOLVES = 6


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, side diagonal and Householder vectors of a symmetric matrix."""
    a = np.array(matrix, float)
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        scale = np.abs(x).max()
        v = np.zeros(n - k - 1)
        if scale > 0 and np.abs(x[1:]).max() > 0:
            v = x / scale
            v[0] += np.copysign(np.sqrt(v @ v), v[0])
            v /= np.sqrt(v @ v)
            block = a[k + 1 :, k + 1 :]
            p = 2 * (block @ v)
            w = p - (v @ p) * v
            block -= np.outer(v, w) + np.outer(w, v)
            a[k + 1 :, k] = x - 2 * v * (v @ x)
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(diagonal: np.ndarray, side: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are smaller than each value: negative terms of its Sturm sequence."""
    least = EPS * EPS * max(float((side * side).max(initial=0.0)), 1e-280)
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for d, s in zip(diagonal[1:], side, strict=True):
        q = np.where(np.abs(q) < least, -least, q)
        q = d - at - s * s / q
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, side: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection until neighbouring doubles are reached."""
    n = len(diagonal)
    reach = np.abs(np.append(side, 0)) + np.abs(np.append(0, side))
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    width = max(abs(low[0]), abs(high[0]), 1e-300)
    low, high = low - 2 * EPS * width, high + 2 * EPS * width
    wanted = n - 1 - np.arange(k)
    for _ in range(200):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        right = below(diagonal, side, middle) <= wanted
        low, high = np.where(right, middle, low), np.where(right, high, middle)
    return low + (high - low) / 2


def _solve(diagonal: np.ndarray, side: np.ndarray, shift: float, b: np.ndarray, norm: float) -> np.ndarray:
    """Solve (T - shift) x = b by elimination with row exchanges; a zero pivot becomes a tiny one."""
    n = len(diagonal)
    tiny = EPS * norm
    b = b.copy()
    main, up, far = np.zeros(n), np.zeros(n), np.zeros(n)
    p, q = diagonal[0] - shift, side[0] if n > 1 else 0.0
    for i in range(n - 1):
        low, right, right2 = side[i], diagonal[i + 1] - shift, side[i + 1] if i + 2 < n else 0.0
        if abs(low) > abs(p):
            main[i], up[i], far[i] = low, right, right2
            b[i], b[i + 1] = b[i + 1], b[i]
            factor = p / low
            p, q = q - factor * right, -factor * right2
        else:
            p = p if abs(p) > tiny else tiny
            main[i], up[i], far[i] = p, q, 0.0
            factor = low / p
            p, q = right - factor * q, right2
        b[i + 1] -= factor * b[i]
    main[n - 1] = p if abs(p) > tiny else tiny
    x = np.zeros(n + 2)
    for i in range(n - 1, -1, -1):
        value = b[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (far[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = value / main[i]
    return x[:n]


def vectors(diagonal: np.ndarray, side: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit vector for each of the falling ``values``, by inverse iteration, as columns."""
    n = len(diagonal)
    norm = max(float((np.abs(diagonal) + np.abs(np.append(side, 0)) + np.abs(np.append(0, side))).max()), 1e-300)
    rng = np.random.default_rng(7)
    found = np.zeros((n, len(values)))
    start, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            start = k
        # Equal eigenvalues are pulled apart a little, so that their solves differ.
        shift = min(value, shift - 10 * EPS * norm) if k > start else value
        x = rng.standard_normal(n)
        x /= np.sqrt(x @ x)
        for _ in range(SOLVES):
            before = x
            x = _solve(diagonal, side, shift, x / np.abs(x).max(), norm)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= found[:, start:k] @ (found[:, start:k].T @ x)
            x /= np.sqrt(x @ x)
            if 1 - abs(before @ x) < 4 * EPS:
                break
        found[:, k] = x
    return found


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit vectors as columns; the largest entry of each is positive."""
    if not np.any(matrix):
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, side, reflectors = tridiagonal(matrix)
    values = leading_values(diagonal, side, k)
    x = vectors(diagonal, side, values)
    for step in range(len(reflectors) - 1, -1, -1):
        v = reflectors[step]
        x[step + 1 :] -= 2 * np.outer(v, v @ x[step + 1 :])
    x *= np.sign(x[np.abs(x).argmax(0), np.arange(k)])
    return values, x
