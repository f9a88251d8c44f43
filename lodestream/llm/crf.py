"""A linear-chain conditional random field in numpy, vectorised over chains.

Chains are rows of one feature matrix plus offsets; every step of the recursions
handles all chains that are that long at once."""

from __future__ import annotations

import numpy as np


def _steps(off: np.ndarray) -> list[np.ndarray]:
    """Row numbers at each position of the chains, longest chains first."""
    n = np.diff(off)
    order = np.argsort(-n, kind="stable")
    start, lens = off[:-1][order], n[order]
    alive = np.searchsorted(-lens, -np.arange(1, (lens[0] if len(lens) else 0) + 1), "right")
    return [start[:k] + t for t, k in enumerate(alive)]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class LinearChainCRF:
    """Weights W (features x states), transitions T (from x to) and scaling of the features."""

    def __init__(self, states: int = 2, l2: float = 1e-3):
        self.k, self.l2 = states, l2
        self.w = self.t = self.mean = self.scale = None

    def _x(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.ones((len(z), 1))])

    def _forward_backward(self, e: np.ndarray, off: np.ndarray):
        a, b = e.copy(), np.zeros_like(e)
        steps = _steps(off)
        for rows in steps[1:]:
            a[rows] += _lse(a[rows - 1][:, :, None] + self.t, 1)
        for rows in steps[:0:-1]:
            b[rows - 1] = _lse(self.t + (e[rows] + b[rows])[:, None, :], 2)
        return a, b

    def fit(self, x: np.ndarray, y: np.ndarray, off: np.ndarray, rounds: int = 80, weight: np.ndarray | None = None) -> LinearChainCRF:
        """Maximum conditional likelihood by limited-memory quasi-Newton steps. weight: of each chain."""
        off = off[np.r_[True, np.diff(off) > 0]]
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z, k = self._x(x), self.k
        f, n = z.shape[1], max(1, len(off) - 1)
        lens = np.diff(off)
        cw = np.ones(n) if weight is None else weight
        rw = np.repeat(cw, lens)
        onehot = np.eye(k)[y]
        inner = np.ones(len(x), bool)
        inner[off[:-1]] = False
        at = np.flatnonzero(inner)
        total = cw.sum()

        def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
            w, self.t = p[: f * k].reshape(f, k), p[f * k :].reshape(k, k)
            e = z @ w
            a, b = self._forward_backward(e, off)
            logz = _lse(a[off[1:] - 1], 1)
            zr = np.repeat(logz, lens)
            marg = np.exp(a + b - zr[:, None])
            pair = np.exp(a[at - 1][:, :, None] + self.t + (e[at] + b[at])[:, None, :] - zr[at][:, None, None]) * rw[at][:, None, None]
            seen = np.zeros((k, k))
            np.add.at(seen, (y[at - 1], y[at]), rw[at])
            gold = (rw * e[np.arange(len(y)), y]).sum() + (seen * self.t).sum()
            gw = z.T @ ((marg - onehot) * rw[:, None])
            return ((cw * logz).sum() - gold) / total + self.l2 * (p @ p) / 2, np.r_[gw.ravel(), (pair.sum(0) - seen).ravel()] / total + self.l2 * p

        p = np.zeros(f * k + k * k)
        v, g = loss(p)
        mem: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(rounds):
            q, al = g.copy(), []
            for s, d in reversed(mem):
                al.append(c := (s @ q) / (s @ d))
                q -= c * d
            if mem:
                s, d = mem[-1]
                q *= (s @ d) / (d @ d)
            else:
                q /= max(1.0, np.linalg.norm(q))
            for (s, d), c in zip(mem, reversed(al), strict=True):
                q += s * (c - (d @ q) / (s @ d))
            step = 1.0
            while step > 1e-6:
                v2, g2 = loss(p - step * q)
                if v2 <= v - 1e-4 * step * (g @ q):
                    break
                step /= 2
            else:
                break
            s, d = -step * q, g2 - g
            p, done, v, g = p + s, abs(v - v2) < 1e-7 * max(1, abs(v)), v2, g2
            if s @ d > 1e-12:
                mem = [*mem, (s, d)][-8:]
            if done:
                break
        self.w, self.t = p[: f * k].reshape(f, k), p[f * k :].reshape(k, k)
        return self

    def marginals(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Posterior of each state at each row, by forward-backward."""
        if not len(x):
            return np.zeros((0, self.k))
        e = self._x(x) @ self.w
        a, b = self._forward_backward(e, off)
        s = a + b
        s -= s.max(1, keepdims=True)
        s = np.exp(s)
        return s / s.sum(1, keepdims=True)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """What each row's features say for each state."""
        return self._x(x) @ self.w

    def viterbi(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The likeliest state sequence of each chain."""
        return self.decode(self.scores(x) if len(x) else np.zeros((0, self.k)), off)

    def decode(self, d: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The same from scores(), which are overwritten."""
        if not len(d):
            return np.zeros(0, np.int64)
        back = np.zeros((len(d), self.k), np.int8)
        steps = _steps(off)
        for rows in steps[1:]:
            c = d[rows - 1][:, :, None] + self.t
            back[rows] = c.argmax(1)
            d[rows] += c.max(1)
        out = np.zeros(len(d), np.int64)
        full = off[1:][np.diff(off) > 0] - 1
        out[full] = d[full].argmax(1)
        for rows in steps[:0:-1]:
            out[rows - 1] = back[rows, out[rows]]
        return out
