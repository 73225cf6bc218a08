"""Eigenvectors of a symmetric matrix by contour integration, interval by interval, with inertia counts."""

from __future__ import annotations

import numpy as np

#: Nodes of the quadrature on the upper half of the circle, refinements of a subspace, and residual relative to the largest eigenvalue.
NODES, ROUNDS, RESIDUAL = 8, 24, 1e-13
#: Eigenvalues of an interval, unless a cluster holds more.
FEW, MANY = 4, 10
#: Eigenvalues under this share of the largest are rounding.
NOTHING = 1e-12


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and next diagonal of a tridiagonal matrix of the same inertia at every shift (reflections)."""
    a, n = np.array(a, np.float64), len(a)
    beside = np.zeros(max(0, n - 1))
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        beside[k] = -np.copysign(size, v[0])
        if size == 0:
            continue
        v[0] -= beside[k]
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
    if n > 1:
        beside[n - 2] = a[n - 1, n - 2]
    return np.diag(a).copy(), beside


def above(tri: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie above each shift: the positive pivots of the shifted matrix."""
    d, e = tri
    least = np.finfo(float).tiny
    pivot, count = d[0] - shifts, np.zeros(len(shifts), np.int64)
    for i in range(len(d)):
        if i:
            pivot = d[i] - shifts - e[i - 1] ** 2 / np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot > 0
    return count


def intervals(matrix: np.ndarray, most: int) -> list[tuple[float, float, int]]:
    """(low, high, how many): intervals, from the top, that hold the ``most`` largest eigenvalues above rounding.

    Every edge lies in the middle of a gap, the widest after FEW to MANY eigenvalues; where these are a cluster without
    gaps, the next one after it.
    """
    tri, size = tridiagonal(matrix), float(np.abs(matrix).sum(axis=1).max())
    if size == 0:
        return []
    floor = NOTHING * size
    wanted = min(most, int(above(tri, np.array([floor]))[0]))
    if not wanted:
        return []
    n = len(matrix)
    low, high = np.full(n, -size), np.full(n, size * (1 + 1e-12))
    for _ in range(44):  # the i-th largest lies in (low, high]
        middle = (low + high) / 2
        up = above(tri, middle) > np.arange(n)
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    gaps = np.append(low[:-1] - high[1:], size)  # below the i-th
    edge = np.append((low[:-1] + high[1:]) / 2, low[-1] - size)
    out, top, done = [], high[0] + max(gaps[:MANY].max() / 2, floor), 0
    while done < wanted:
        near = np.arange(min(done + FEW, n) - 1, min(done + MANY, n))
        at = near[np.argmax(gaps[near])]
        if gaps[at] < 1e-9 * size:
            at = int(near[-1] + np.argmax(gaps[near[-1] :] >= 1e-9 * size))
        out.append((float(edge[at]), float(top), int(at + 1 - done)))
        top, done = edge[at], at + 1
    return out


def in_interval(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between both, and their unit eigenvectors as columns; fewer or more is an error.

    The solves at complex shifts on the circle around the interval, weighted, are a projection that leaves of a
    subspace what belongs to the interval; its Ritz pairs are taken, and the subspace is projected again until they are exact.
    """
    n, size = len(matrix), float(np.abs(matrix).sum(axis=1).max())
    x, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(1j * np.pi / 2 * (1 + x))
    middle, radius = (low + high) / 2, (high - low) / 2
    shifted = [(middle + radius * t) * np.eye(n) - matrix for t in turns]
    width = min(n, max(count + 4, count * 3 // 2 + 2))
    while True:
        basis, best, found = np.random.default_rng(count).normal(size=(n, width)), np.inf, None
        for _ in range(ROUNDS):
            basis = sum(w / 2 * radius * np.real(t * np.linalg.solve(s, basis)) for w, t, s in zip(weights, turns, shifted, strict=True))
            u, s, _ = np.linalg.svd(basis, full_matrices=False)
            u = u[:, s > 1e-9 * s[0]]
            values, turn = np.linalg.eigh(u.T @ matrix @ u)
            basis = u @ turn
            inside = (values > low) & (values < high)
            if inside.sum() == count:
                wrong = np.linalg.norm(matrix @ basis[:, inside] - basis[:, inside] * values[inside], axis=0).max(initial=0) / size
                if wrong < best:
                    best, found = wrong, (values[inside], basis[:, inside])
                elif best < RESIDUAL:
                    break
        if found is not None and best < 100 * RESIDUAL:
            return found
        if width == n:
            raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, but not all were found")
        width = min(n, width * 2)


def together(matrix: np.ndarray, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest Ritz pairs of all intervals' vectors, largest first; a vector's largest entry is positive."""
    u, _ = np.linalg.qr(vectors)
    values, turn = np.linalg.eigh(u.T @ matrix @ u)
    values, vectors = values[::-1][:most], (u @ turn)[:, ::-1][:, :most]
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[largest, np.arange(len(values))])
