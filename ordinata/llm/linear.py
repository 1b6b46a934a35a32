"""Linear models over sparse rows, fitted in numpy on bounded samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Rows:
    """Binary sparse rows: column numbers and offsets."""

    def __init__(self, columns: np.ndarray, offsets: np.ndarray, width: int):
        self.columns, self.offsets, self.width = columns, offsets, width
        self.owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=w[self.columns], minlength=len(self))

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=g[self.owner], minlength=self.width)

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.offsets)[rows]
        to = np.append(0, np.cumsum(n))
        return Rows(self.columns[np.repeat(self.offsets[rows] - to[:-1], n) + np.arange(to[-1])], to, self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 150, memory: int = 8) -> np.ndarray:
    """Minimise a smooth function that returns its value and gradient."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(grad).max(initial=0) < 1e-6:
            break
        q, alphas = grad.copy(), []
        for s, y, rho in reversed(past):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(past, reversed(alphas), strict=True):
            q += (a - rho * (y @ q)) * s
        slope, t = -(grad @ q), 1.0 if past else 1 / max(1.0, np.abs(grad).sum())
        while t > 1e-12:
            new = x - t * q
            v, g = f(new)
            if v <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = new - x, g - grad
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y, 1 / (s @ y))]
        done = value - v < 1e-9 * max(1.0, abs(value))
        x, value, grad = new, v, g
        if done:
            break
    return x


def logistic(rows: Rows, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression with ridge penalty."""
    weight = np.ones(len(rows)) if weight is None else weight

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        z = rows.dot(p[:-1]) + p[-1]
        r = weight * (sigmoid(z) - y)
        value = (weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (p[:-1] @ p[:-1])
        return value, np.append(rows.back(r) + ridge * p[:-1], r.sum())

    return lbfgs(loss, np.zeros(rows.width + 1))


def softmax(rows: Rows, y: np.ndarray, classes: int, ridge: float = 1.0) -> np.ndarray:
    """(width + 1) x classes weights, the intercepts in the last row, of a multinomial logistic regression."""
    truth = np.eye(classes)[y]

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w = p.reshape(rows.width + 1, classes)
        z = np.stack([rows.dot(w[:-1, c]) for c in range(classes)], 1) + w[-1]
        z -= z.max(1, keepdims=True)
        logp = z - np.log(np.exp(z).sum(1, keepdims=True))
        r = np.exp(logp) - truth
        g = np.stack([np.append(rows.back(r[:, c]) + ridge * w[:-1, c], r[:, c].sum()) for c in range(classes)], 1)
        return -(truth * logp).sum() + ridge / 2 * (w[:-1] ** 2).sum(), g.ravel()

    return lbfgs(loss, np.zeros((rows.width + 1) * classes)).reshape(rows.width + 1, classes)


def ordinal(rows: Rows, y: np.ndarray, grades: int, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and the rising thresholds t of P(grade <= k) = sigmoid(t_k - w x): one weight vector for all thresholds."""

    def parts(p: np.ndarray) -> np.ndarray:
        first, gaps = p[rows.width], np.exp(np.clip(p[rows.width + 1 :], -20, 20))
        return first + np.append(0, np.cumsum(gaps))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, t = p[: rows.width], parts(p)
        s = rows.dot(w)
        ends = np.concatenate(([-np.inf], t, [np.inf]))
        hi, lo = ends[y + 1] - s, ends[y] - s
        a, b = sigmoid(np.where(np.isinf(hi), 60, hi)), sigmoid(np.where(np.isinf(lo), -60, lo))
        a, b = np.where(np.isinf(hi), 1.0, a), np.where(np.isinf(lo), 0.0, b)
        pr = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / pr, b * (1 - b) / pr
        gs = da - db  # of -log pr with respect to s
        gt = np.zeros(grades + 1)
        np.add.at(gt, y + 1, -da)
        np.add.at(gt, y, db)
        gt = gt[1:-1]
        gaps = np.exp(np.clip(p[rows.width + 1 :], -20, 20))
        tail = np.cumsum(gt[::-1])[::-1]
        return -np.log(pr).sum() + ridge / 2 * (w @ w), np.concatenate([rows.back(gs) + ridge * w, [tail[0]], tail[1:] * gaps])

    start = np.zeros(rows.width + grades - 1)
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / max(len(y), 1), 1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    start[rows.width] = t[0]
    start[rows.width + 1 :] = np.log(np.maximum(np.diff(t), 0.1))
    p = lbfgs(loss, start)
    return p[: rows.width], parts(p)
