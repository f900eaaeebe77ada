"""Singular values and right singular vectors of a small square matrix: Householder bidiagonalisation, dqds, twisted factorisations.

Everything here is as large as the dimension of the vectors, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a and superdiagonal b of U' r W, and W (orthogonal), by Householder reflections from both sides."""
    m = np.array(r, float)
    d = m.shape[1]
    w = np.eye(d)

    def reflector(x):
        v = x.copy()
        size = np.linalg.norm(x)
        if size == 0:
            return None
        v[0] += np.copysign(size, x[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflector(m[k:, k])
        if v is not None:
            m[k:, k:] -= 2 * np.outer(v, v @ m[k:, k:])
        if k < d - 2:
            v = reflector(m[k, k + 1:])
            if v is not None:
                m[k:, k + 1:] -= 2 * np.outer(m[k:, k + 1:] @ v, v)
                w[:, k + 1:] -= 2 * np.outer(w[:, k + 1:] @ v, v)
    return np.diagonal(m).copy(), np.diagonal(m, 1).copy(), w


def _step(q: np.ndarray, e: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One differential quotient-difference step with shift tau; None if the shift was beyond the smallest value."""
    n = len(q)
    q2, e2 = np.empty(n), np.empty(n - 1)
    d = low = q[0] - tau
    for i in range(n - 1):
        if d < 0:
            return None
        q2[i] = d + e[i]
        if q2[i] == 0:
            e2[i], d = 0.0, q[i + 1] - tau
        else:
            t = q[i + 1] / q2[i]
            e2[i] = e[i] * t
            d = d * t - tau
        low = min(low, d)
    if not d >= 0:          # negative or not a number
        return None
    q2[-1] = d
    return q2, e2, low


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the upper bidiagonal matrix (a, b), falling, each to high relative accuracy."""
    found: list[float] = []
    work = [(np.asarray(a, float) ** 2, np.asarray(b, float) ** 2, 0.0)]
    while work:
        q, e, sigma = work.pop()
        guess = None
        while len(q):
            n = len(q)
            if n == 1:
                found.append(sigma + q[0])
                break
            cut = np.flatnonzero(e <= EPS * EPS * (sigma + np.minimum(q[:-1], q[1:])))
            if len(cut):
                k = int(cut[-1])
                work.append((q[:k + 1], e[:k], sigma))
                q, e, guess = q[k + 1:], e[k + 1:], None
                continue
            if n == 2:
                t = 0.5 * ((q[0] - q[1]) + e[0])                     # eigenvalues of [[q0, sqrt(q0 e0)], [., q1 + e0]]
                big = 0.5 * (q[0] + q[1] + e[0]) + np.sqrt(t * t + q[1] * e[0])
                found += [sigma + big, sigma + (q[0] / big * q[1] if big > 0 else 0.0)]
                break
            if 1.5 * q[0] < q[-1]:                                     # grade the other way round: the small end belongs at the bottom
                q, e = _reversed(q, e)
            if guess is None:
                tau = 0.0
            else:
                gap = max(q[-2] + e[-1] - q[-1], 0.0)                 # the lowest 2 x 2 block gives a value that is near and mostly not beyond
                near = q[-1] - q[-1] * e[-1] / max(gap, TINY) if gap > 0 else 0.25 * guess
                tau = max(0.0, min(near * (1 - 8 * EPS), guess))
            for tau in (tau, 0.25 * tau, 0.0):
                step = _step(q, e, tau)
                if step is not None:
                    break
            q, e, guess = step
            sigma += tau
    return np.sort(np.array(found))[::-1]


def _reversed(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same values with the order of the bidiagonal's rows and columns turned round."""
    return q[::-1].copy(), e[::-1].copy()


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Eigenvector of B'B for an eigenvalue: a factorisation from the top and one from the bottom, joined where the residual is least."""
    n = len(a)
    if n == 1:
        return np.ones(1)
    scale = max(float((a * a).max()), TINY)
    d = np.maximum(a * a, scale * EPS * EPS)
    root = np.copysign(np.sqrt(d), a)
    l = b / root[:-1]                                                  # B'B = L D L'
    up, upper, s = np.empty(n), np.empty(n - 1), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        up[i] = d[i] + s[i]
        if up[i] == 0:
            up[i] = EPS * scale * EPS
        upper[i] = d[i] * l[i] / up[i]
        s[i + 1] = upper[i] * l[i] * s[i] - value
    down, p = np.empty(n - 1), np.empty(n)
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        f = d[i] * l[i] * l[i] + p[i + 1]
        if f == 0:
            f = EPS * scale * EPS
        t = d[i] / f
        down[i] = l[i] * t
        p[i] = p[i + 1] * t - value
    gamma = s + p + value
    k = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -upper[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -down[i] * z[i]
        if abs(z[i + 1]) > 1e150:
            z /= abs(z[i + 1])
    if not np.isfinite(z).all():
        return np.full(n, 1 / np.sqrt(n))
    return z / np.linalg.norm(z)


def right_vectors(a: np.ndarray, b: np.ndarray, close: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Falling squared singular values of the bidiagonal matrix and its right singular vectors as columns.

    Blocks that a negligible b separates are solved apart.  Vectors of values that agree to `close` are made orthogonal to each other; where a twisted
    factorisation finds the same direction again, inverse iteration from another start finds the rest of the common space.
    """
    n = len(a)
    size = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    ends = [*(int(i) + 1 for i in np.flatnonzero(np.abs(b) <= EPS * size)), n]
    values, columns, start = [], [], 0
    for end in ends:
        qa, qb = a[start:end], b[start:end - 1]
        t = np.diag(qa) + np.diag(qb, 1)
        t = t.T @ t
        mine: list[tuple[float, np.ndarray]] = []
        for v in squared_singular_values(qa, qb):
            z = _twisted(qa, qb, v)
            like = np.array([u for w, u in mine if abs(w - v) <= close * max(w, v) or max(w, v) <= (EPS * size) ** 2])
            if len(like):
                z = _apart(z, like)
                if z is None:
                    z = _inverse(t, v, like, len(mine))
            mine.append((v, z))
        for v, z in mine:
            full = np.zeros(n)
            full[start:end] = z
            values.append(v)
            columns.append(full)
        start = end
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(columns)[order].T


def _apart(z: np.ndarray, like: np.ndarray) -> np.ndarray | None:
    for _ in range(2):
        z = z - like.T @ (like @ z)
        size = np.linalg.norm(z)
        if size < 1e-3:
            return None
        z = z / size
    return z


def _inverse(t: np.ndarray, value: float, like: np.ndarray, seed: int) -> np.ndarray:
    """Inverse iteration within the space orthogonal to `like`."""
    n = len(t)
    z = _apart(np.random.default_rng(seed).normal(size=n), like)
    shifted = t - (value + 4 * EPS * max(np.abs(t).max(), TINY)) * np.eye(n)
    for _ in range(4):
        try:
            new = _apart(np.linalg.solve(shifted, z), like)
        except np.linalg.LinAlgError:
            break
        if new is None:
            break
        z = new
    return z


def right_singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling squared singular values of r and its right singular vectors as columns."""
    size = np.abs(r).max(initial=0)
    if size == 0:
        return np.zeros(r.shape[1]), np.eye(r.shape[1])
    a, b, w = bidiagonalise(r / size)
    values, z = right_vectors(a, b)
    return values * size * size, w @ z
