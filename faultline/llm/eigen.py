"""Eigenvectors of a symmetric matrix: Householder reduction to tridiagonal form, then divide and conquer.

The tridiagonal matrix is cut in two by a change of rank one. The halves are solved, and the change is
undone by the roots of the secular equation, each bracketed between two poles and found from the
nearer one, so that differences to the poles keep their digits. Weights are then recomputed from the roots
(so that vectors are orthogonal to working precision); equal poles and weights of zero are split off first.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(np.float64).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, subdiagonal, q) with a = q t q'."""
    a, n = a.astype(np.float64).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        if not x[1:].any():
            continue
        v = x / np.abs(x).max()
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        v /= np.sqrt(v @ v)
        edge = x[0] - 2 * v[0] * (v @ x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (p @ v) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = edge
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def _roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Of 1 + rho * sum(z**2 / (d - x)) with rising d: the pole each root is told from, and its distance to it."""
    n = len(d)
    gap = np.append(np.diff(d), rho * (z @ z))
    w = rho * z * z

    def value(origin: np.ndarray, mu: np.ndarray) -> np.ndarray:
        return 1 + (w / ((d - d[origin][:, None]) - mu[:, None])).sum(1)

    k = np.arange(n)
    # the function rises between its poles: a negative value at the middle puts the root into the right half
    right = (value(k, gap / 2) < 0) & (k < n - 1)
    origin = np.where(right, k + 1, k)
    lo, hi = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, np.where(k < n - 1, gap / 2, gap))
    for _ in range(120):
        mid = (lo + hi) / 2
        up = value(origin, mid) < 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    # never on a pole: the end away from it
    return origin, np.where(right, lo, hi)


def _joined(d: np.ndarray, q: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of q (diag(d) + rho z z') q'; rho is positive."""
    order = np.argsort(d, kind="stable")
    d, z, q = d[order], z[order], q[:, order]
    size = np.sqrt(z @ z)
    z, rho = z / size, rho * size * size
    tiny = 8 * _EPS * max(np.abs(d).max(), rho)
    live = rho * np.abs(z) > tiny
    last = -1
    for i in np.flatnonzero(live):
        if last >= 0:
            r = np.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            if abs((d[i] - d[last]) * c * s) <= tiny:
                z[last], z[i] = 0.0, r
                q[:, [last, i]] = np.stack([c * q[:, last] - s * q[:, i], s * q[:, last] + c * q[:, i]], axis=1)
                d[last], d[i] = c * c * d[last] + s * s * d[i], s * s * d[last] + c * c * d[i]
                live[last] = False
        last = i
    k = np.flatnonzero(live)
    if len(k):
        dk, zk = d[k], z[k]
        origin, mu = _roots(dk, zk, rho)
        apart = (dk - dk[origin][:, None]) - mu[:, None]  # row: root, column: pole minus root
        m, at = len(k), np.arange(len(k))
        poles = dk[None, :] - dk[:, None]  # [i, j] = d[j] - d[i]
        ratio = np.ones((m, m))  # for pole j the roots below pair with the poles below, the others with the poles above
        for j in range(m):
            ratio[:j, j] = apart[:j, j] / poles[:j, j]
            ratio[j : m - 1, j] = apart[j : m - 1, j] / poles[j + 1 :, j]
        weight = np.sqrt(np.abs(ratio.prod(0) * apart[m - 1, at] / rho))
        u = np.copysign(weight, zk) / apart
        u /= np.sqrt((u * u).sum(1, keepdims=True))
        q[:, k] = q[:, k] @ u.T
        d[k] = dk[origin] + mu
    return d, q


def divide(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the tridiagonal matrix with this diagonal and subdiagonal."""
    n = len(d)
    if n == 1:
        return d.copy(), np.ones((1, 1))
    m = n // 2
    rho, sign = abs(e[m - 1]), np.sign(e[m - 1])
    upper, lower = d[:m].copy(), d[m:].copy()
    upper[-1] -= rho
    lower[0] -= rho
    d1, q1 = divide(upper, e[: m - 1])
    d2, q2 = divide(lower, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    both = np.concatenate([d1, d2])
    return (both, q) if rho == 0 else _joined(both, q, np.concatenate([q1[-1], sign * q2[0]]), rho)


def symmetric(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors, as columns, of a symmetric matrix."""
    scale = float(np.abs(a).max(initial=0))
    if scale == 0:
        return np.zeros(len(a)), np.eye(len(a))
    d, e, q = tridiagonal(a / scale)
    values, vectors = divide(d, e)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, q @ vectors[:, order]
