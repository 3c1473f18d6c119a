"""Singular values and right directions of a small triangular factor: bidiagonal reduction, dqds, twisted factorisations."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
TINY = float(np.finfo(np.float64).tiny)


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """``v, tau, beta``: (I - tau v v') x = beta e1, with v[0] = 1."""
    v = x.astype(np.float64, copy=True)
    rest = float(np.linalg.norm(v[1:]))
    if rest == 0.0:
        v[0] = 1.0
        return v, 0.0, float(x[0])
    beta = -float(np.copysign(np.hypot(x[0], rest), x[0]))
    v[1:] /= x[0] - beta
    v[0] = 1.0
    return v, (beta - float(x[0])) / beta, beta


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a, b, v``: the upper bidiagonal (diagonal a, next to it b) of U' r v by Householder reflections, and v."""
    a = r.astype(np.float64, copy=True)
    n = a.shape[0]
    right = np.eye(n)
    for k in range(n):
        v, tau, beta = _reflector(a[k:, k])
        if tau:
            a[k:, k:] -= tau * np.outer(v, v @ a[k:, k:])
        a[k, k], a[k + 1:, k] = beta, 0.0
        if k < n - 2:
            v, tau, beta = _reflector(a[k, k + 1:])
            if tau:
                a[k:, k + 1:] -= tau * np.outer(a[k:, k + 1:] @ v, v)
                right[:, k + 1:] -= tau * np.outer(right[:, k + 1:] @ v, v)
            a[k, k + 1], a[k, k + 2:] = beta, 0.0
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One dqds transform of a qd array, and its intermediate values d."""
    n = len(q)
    new_q, new_e, held = [0.0] * n, [0.0] * (n - 1), [0.0] * n
    d = q[0] - shift
    for i in range(n - 1):
        held[i] = d
        total = d + e[i]
        new_q[i] = total
        ratio = q[i + 1] / total if total else 0.0
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
    held[-1] = new_q[-1] = d
    return new_q, new_e, held


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, largest first, each to high relative accuracy.

    The shift of a step is 1 / sum(1 / d) of an unshifted transform: the d are the inverses of the
    diagonal of the inverse, so this is never more than the smallest value, and Newton's step
    towards it. A step that rounding makes negative is done again with a smaller shift.
    """
    scale = float(max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0)))
    if scale == 0.0:
        return np.zeros(len(a))
    found: list[float] = []
    todo = [([float(x) ** 2 for x in a / scale], [float(x) ** 2 for x in b / scale], 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + sigma)
                break
            # A link that cannot change a value any more splits the array.
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS * EPS * (sigma + min(q[i], q[i + 1])) or e[i] < TINY), None)
            if cut is not None:
                todo.append((q[:cut + 1], e[:cut], sigma))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            zero_q, zero_e, d = _sweep(q, e, 0.0)
            if min(d) <= TINY:
                # The smallest value is zero: the unshifted transform brings it to the end.
                q, e = zero_q, zero_e
                q[-1] = max(q[-1], 0.0)
                if e[-1] <= TINY or q[-1] <= TINY:
                    found.append(sigma)
                    q, e = q[:-1], e[:-1]
                continue
            shift = (1.0 - 4 * EPS) / sum(1.0 / x for x in d)
            if shift <= EPS * sigma:
                q, e = zero_q, zero_e
                if e[-1] <= EPS * EPS * (sigma + q[-1]) or q[-1] <= EPS * sigma:
                    found.append(q[-1] + sigma)
                    q, e = q[:-1], e[:-1]
                continue
            for _ in range(8):
                new_q, new_e, d = _sweep(q, e, shift)
                if min(d) >= 0.0:
                    sigma += shift
                    q, e = new_q, new_e
                    break
                shift /= 4
            else:
                q, e = zero_q, zero_e
    return np.sort(np.array(found))[::-1] * scale * scale


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """A vector z with B'B z = value z, and the residual at the twist.

    B'B - value is factored from the top (stationary) and from the bottom (progressive); the two
    meet where the pivot is smallest, and z is solved from there outwards without any subtraction.
    """
    n = len(a)
    square, link, off = a * a, b * b, a[:-1] * b
    floor = EPS * EPS * max(value, TINY) + TINY

    def safe(x: float) -> float:
        return x if abs(x) > floor else float(np.copysign(floor, x))

    s, upper = np.empty(n), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        pivot = safe(square[i] + s[i])
        upper[i] = off[i] / pivot
        s[i + 1] = link[i] * (s[i] / pivot) - value
    p, lower = np.empty(n), np.empty(max(n - 1, 0))
    p[-1] = square[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = safe(link[i] + p[i + 1])
        lower[i] = off[i] / pivot
        p[i] = square[i] * (p[i + 1] / pivot) - value
    gamma = s + p + value
    twist = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -upper[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -lower[i] * z[i]
    size = float(np.linalg.norm(z))
    return z / size, abs(float(gamma[twist])) / size


def _blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Ranges between links that are zero to rounding."""
    largest = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    cuts = np.flatnonzero(np.abs(b) <= EPS * largest) + 1
    edges = [0, *cuts.tolist(), len(a)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``values, vectors``: squares of the largest singular values of ``r`` that are not zero to rounding, and unit right vectors as columns.

    Values that are close share a cluster: their vectors are made orthogonal to those before. Where
    nothing of a vector is left (equal values), it is found by inverse iteration beside the others.
    """
    a, b, right = bidiagonal(r)
    found = []
    for start, stop in _blocks(a, b):
        own_a, own_b = a[start:stop], b[start:stop - 1]
        found += [(value, start, stop) for value in dqds(own_a, own_b).tolist()]
    found.sort(key=lambda x: (-x[0], x[1]))
    top = found[0][0] if found else 0.0
    found = [x for x in found if x[0] > (len(a) * EPS) ** 2 * top * 16 and x[0] > 0.0][:most]
    vectors: list[np.ndarray] = []
    for value, start, stop in found:
        own_a, own_b = a[start:stop], b[start:stop - 1]
        z = np.zeros(len(a))
        z[start:stop] = twisted(own_a, own_b, value)[0]
        left = _beside(z, vectors)
        if np.linalg.norm(left) < 0.5:
            left = _again(own_a, own_b, value, start, vectors, len(a))
        vectors.append(left / np.linalg.norm(left))
    z = np.array(vectors).T if vectors else np.zeros((len(a), 0))
    return np.array([x[0] for x in found]), right @ z


def _beside(z: np.ndarray, vectors: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for v in vectors:
            z = z - v * (v @ z)
    return z


def _again(a: np.ndarray, b: np.ndarray, value: float, start: int, vectors: list[np.ndarray], size: int) -> np.ndarray:
    """Inverse iteration kept orthogonal to the vectors already found; for values that agree to rounding."""
    n = len(a)
    matrix = np.diag(a * a)
    matrix[1:, 1:] += np.diag(b * b)
    matrix += np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    shifted = matrix - (value * (1 + 8 * EPS) + TINY) * np.eye(n)
    z = np.random.default_rng(size + len(vectors)).standard_normal(n)
    for _ in range(4):
        whole = np.zeros(size)
        whole[start:start + n] = z
        whole = _beside(whole, vectors)
        z = np.linalg.solve(shifted, whole[start:start + n] / np.linalg.norm(whole))
        z /= np.linalg.norm(z)
    whole = np.zeros(size)
    whole[start:start + n] = z
    whole = _beside(whole, vectors)
    return whole / np.linalg.norm(whole)
