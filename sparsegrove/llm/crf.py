"""A linear-chain conditional random field in numpy batches.

Tokens carry a fixed number of hashed features.  A label's emission is the sum of its features' weights; the
chain adds transition, start and end weights.  Training maximises the likelihood of labelled chains with
Adagrad on exact forward-backward gradients; decoding is by Viterbi or by forward-backward marginals.  All
chains of a batch advance together, one token a step.
"""

from __future__ import annotations

import numpy as np


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Chain:
    """weights: (features, labels); step: (labels, labels) from row to column; begin, end: (labels,)."""

    def __init__(self, features: int, labels: int):
        self.weights = np.zeros((features, labels), np.float32)
        self.step = np.zeros((labels, labels))
        self.begin, self.end = np.zeros(labels), np.zeros(labels)

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """(..., labels) of hashed features (..., k)."""
        return self.weights[features].sum(axis=-2, dtype=np.float64)

    def forward_backward(self, emit: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log partition (chains,), alpha and beta (chains, tokens, labels).

        live: which tokens are there; chains start at the first token and are padded behind.
        """
        n, t, labels = emit.shape
        alpha, beta = np.zeros((n, t, labels)), np.zeros((n, t, labels))
        alpha[:, 0] = self.begin + emit[:, 0]
        for i in range(1, t):
            new = logsum(alpha[:, i - 1, :, None] + self.step, 1) + emit[:, i]
            alpha[:, i] = np.where(live[:, i, None], new, alpha[:, i - 1])
        beta[:, t - 1] = self.end
        for i in range(t - 2, -1, -1):
            new = logsum(self.step + (emit[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(live[:, i + 1, None], new, self.end)
        return logsum(alpha[:, -1] + self.end, 1), alpha, beta

    def marginals(self, emit: np.ndarray, live: np.ndarray) -> np.ndarray:
        total, alpha, beta = self.forward_backward(emit, live)
        return np.exp(alpha + beta - total[:, None, None])

    def viterbi(self, emit: np.ndarray, live: np.ndarray) -> np.ndarray:
        """The best labels (chains, tokens)."""
        n, t, labels = emit.shape
        best, back = self.begin + emit[:, 0], np.zeros((n, t, labels), np.int16)
        for i in range(1, t):
            ways = best[:, :, None] + self.step
            back[:, i] = np.where(live[:, i, None], ways.argmax(axis=1), np.arange(labels))
            best = np.where(live[:, i, None], ways.max(axis=1) + emit[:, i], best)
        out = np.zeros((n, t), np.int64)
        out[:, -1] = (best + self.end).argmax(axis=1)
        for i in range(t - 1, 0, -1):
            out[:, i - 1] = back[np.arange(n), i, out[:, i]]
        return out

    def fit(self, features: np.ndarray, labels: np.ndarray, live: np.ndarray, epochs: int = 60, rate: float = 0.5, decay: float = 1e-4, size: int = 1024, seed: int = 0) -> Chain:
        """features (chains, tokens, k), labels and live (chains, tokens)."""
        n, t, k = features.shape
        kinds = len(self.begin)
        own = np.eye(kinds)[labels] * live[..., None]
        squares = [np.full_like(x, 1e-3, dtype=np.float64) for x in (self.weights, self.step, self.begin, self.end)]
        random = np.random.default_rng(seed)
        for _ in range(epochs):
            for rows in np.array_split(random.permutation(n), max(1, n // size)):
                f, alive, gold = features[rows], live[rows], own[rows]
                emit = self.emissions(f)
                total, alpha, beta = self.forward_backward(emit, alive)
                p = np.exp(alpha + beta - total[:, None, None]) * alive[..., None]
                over = p - gold
                flat = f.reshape(-1)
                each = np.repeat(over.reshape(-1, kinds), k, axis=0)
                grad_w = np.stack([np.bincount(flat, weights=each[:, j], minlength=len(self.weights)) for j in range(kinds)], axis=1)
                both = alive[:, 1:]
                pair = alpha[:, :-1, :, None] + self.step + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
                grad_s = (np.exp(pair) * both[..., None, None]).sum(axis=(0, 1)) - np.einsum("nti,ntj->ij", gold[:, :-1] * both[..., None], gold[:, 1:])
                last = alive.sum(axis=1) - 1
                at = np.arange(len(rows))
                grads = (grad_w, grad_s, over[:, 0].sum(axis=0), over[at, last].sum(axis=0))
                for x, g, s in zip((self.weights, self.step, self.begin, self.end), grads, squares):
                    g = g / len(rows) + decay * x
                    s += g * g
                    x -= rate * g / np.sqrt(s)
        return self


def padded(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For chains of these sizes laid out flat: the flat index of each (chain, token), and which are there."""
    t = int(sizes.max()) if len(sizes) else 1
    live = np.arange(t) < sizes[:, None]
    starts = np.cumsum(sizes) - sizes
    return np.where(live, starts[:, None] + np.arange(t), 0), live


def by_size(sizes: np.ndarray, tokens: int = 1 << 15):
    """Chains in groups of like size whose padded tokens stay under a bound (or one chain)."""
    order = np.argsort(sizes, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * sizes[order[stop]] <= tokens:
            stop += 1
        yield order[start:stop]
        start = stop
