"""Dense linear algebra for matrices that a plan has already made small (d x d moments), and an exact nearest-neighbour tree for a bounded table."""

from __future__ import annotations

import heapq

import numpy as np


def project(a: np.ndarray) -> np.ndarray:
    """The matrix that projects onto the columns of a."""
    q = gram_schmidt(a)
    return q @ q.T


def gram_schmidt(a: np.ndarray, modified: bool = True) -> np.ndarray:
    """Orthonormal columns that span those of a; dependent columns become zero. The classical form takes all coefficients from the column as it came."""
    q = np.zeros_like(a, dtype=float)
    for j in range(a.shape[1]):
        v = a[:, j].astype(float)
        if modified:
            for i in range(j):
                v = v - (q[:, i] @ v) * q[:, i]
        else:
            v = v - q[:, :j] @ (q[:, :j].T @ v)
        n = np.linalg.norm(v)
        q[:, j] = v / n if n > 1e-12 * max(1.0, np.linalg.norm(a[:, j])) else 0.0
    return q


def eliminate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solves a x = b by elimination with the largest pivot of each column, then substitution from below."""
    m = np.concatenate([a.astype(float), b.reshape(len(a), -1).astype(float)], 1)
    n = len(a)
    for k in range(n):
        p = k + int(np.abs(m[k:, k]).argmax())
        if abs(m[p, k]) < 1e-300:
            raise ValueError("singular matrix")
        m[[k, p]] = m[[p, k]]
        m[k + 1 :] -= np.outer(m[k + 1 :, k] / m[k, k], m[k])
    x = np.zeros((n, m.shape[1] - n))
    for k in range(n - 1, -1, -1):
        x[k] = (m[k, n:] - m[k, k + 1 : n] @ x[k + 1 :]) / m[k, k]
    return x.reshape(b.shape)


def cholesky(a: np.ndarray) -> np.ndarray:
    """Lower triangle whose product with its transpose is a."""
    low = np.zeros_like(a, dtype=float)
    for j in range(len(a)):
        rest = a[j:, j] - low[j:, :j] @ low[j, :j]
        if rest[0] <= 0:
            raise ValueError("matrix is not positive definite")
        low[j:, j] = rest / np.sqrt(rest[0])
    return low


def symmetric_eig(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and eigenvectors (columns, largest entry positive) of a symmetric matrix, by rotations that clear one
    off-diagonal pair at a time."""
    d, v = a.astype(float).copy(), np.eye(len(a))
    scale = max(np.abs(d).max(initial=0.0), 1e-300)
    for _ in range(sweeps):
        if np.sqrt(((d - np.diag(np.diag(d))) ** 2).sum()) <= 1e-14 * scale * len(d):
            break
        for p in range(len(d)):
            for q in range(p + 1, len(d)):
                if abs(d[p, q]) > 1e-18 * scale:
                    angle = 0.5 * np.arctan2(2 * d[p, q], d[q, q] - d[p, p])
                    c, s = np.cos(angle), np.sin(angle)
                    turn = np.array([[c, s], [-s, c]])
                    d[:, [p, q]] = d[:, [p, q]] @ turn
                    d[[p, q]] = turn.T @ d[[p, q]]
                    v[:, [p, q]] = v[:, [p, q]] @ turn
    order = np.argsort(-np.diag(d), kind="stable")
    v = v[:, order]
    return np.diag(d)[order], v * np.where(v[np.abs(v).argmax(0), range(len(v))] < 0, -1.0, 1.0)


def svd(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, s, vt by the eigenvectors of the smaller Gram matrix; singular values under 1e-8 of the largest count as zero and are left out."""
    tall = a if a.shape[0] >= a.shape[1] else a.T
    values, v = symmetric_eig(tall.T @ tall)
    s = np.sqrt(np.maximum(values, 0))
    keep = s > 1e-8 * max(s.max(initial=0.0), 1e-300)
    s, v = s[keep], v[:, keep]
    u = tall @ v / s
    return (u, s, v.T) if tall is a else (v, s, u.T)


def pinv(a: np.ndarray) -> np.ndarray:
    u, s, vt = svd(a)
    return vt.T / s @ u.T


def low_rank(a: np.ndarray, k: int) -> np.ndarray:
    u, s, vt = svd(a)
    return u[:, :k] * s[:k] @ vt[:k]


def matrix_rank(a: np.ndarray) -> int:
    return len(svd(a)[1])


def condition_number(a: np.ndarray) -> float:
    s = svd(a)[1]
    return float(s[0] / s[-1]) if len(s) == min(a.shape) else float("inf")


def conditional_normal(mean: np.ndarray, cov: np.ndarray, known: list[int], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the other coordinates of a normal vector, given the known ones."""
    rest = [i for i in range(len(mean)) if i not in known]
    gain = eliminate(cov[np.ix_(known, known)], cov[np.ix_(known, rest)]).T
    return mean[rest] + gain @ (at - mean[known]), cov[np.ix_(rest, rest)] - gain @ cov[np.ix_(known, rest)]


class NeighbourTree:
    """Exact nearest neighbours: cells are halved at the median of their widest axis down to `leaf` points; a search leaves out cells beyond the worst kept."""

    def __init__(self, points: np.ndarray, leaf: int = 16):
        self.points, self.leaf = points, leaf
        self.root = self.grow(np.arange(len(points)))

    def grow(self, ids: np.ndarray):
        own = self.points[ids]
        axis = int(np.ptp(own, axis=0).argmax()) if len(ids) else 0
        if len(ids) <= self.leaf or np.ptp(own[:, axis]) == 0:
            return ids
        cut = np.median(own[:, axis])
        left = own[:, axis] < cut if (own[:, axis] < cut).any() else own[:, axis] <= cut
        return axis, cut, self.grow(ids[left]), self.grow(ids[~left])

    def search(self, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(distance, place) of the k nearest, smaller places first on ties."""
        best: list[tuple[float, int]] = []
        todo = [(0.0, 0, self.root)]
        turn = 1
        while todo:
            bound, _, node = heapq.heappop(todo)
            if len(best) == k and bound > -best[0][0]:
                break
            if isinstance(node, tuple):
                axis, cut, low, high = node
                gap = q[axis] - cut
                for side, far in ((low, gap > 0), (high, gap < 0)):
                    heapq.heappush(todo, (max(bound, abs(gap)) if far else bound, turn, side))
                    turn += 1
                continue
            for i in node:
                item = (-float(np.linalg.norm(self.points[i] - q)), -int(i))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return sorted((-d, -i) for d, i in best)
