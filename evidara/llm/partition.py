"""Learned partitions of a vector space: a balanced partition of the neighbour graph
of a bounded sample, and a small classifier that routes any vector to the parts its
neighbours are likely to be in. Plain NumPy; everything here is bounded by the sample.
"""

from __future__ import annotations

import numpy as np


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k most similar rows of each row, in blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), max(k, 0)), dtype=np.int32)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        if k > 0:
            out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _fill(scores: np.ndarray, cap: int) -> np.ndarray:
    """Each row to its best column that has room; the rows surest of their choice first."""
    n, b = scores.shape
    order = np.argsort(-scores, axis=1)
    part = np.full(n, -1)
    room = np.full(b, cap)
    todo = np.argsort(-(np.take_along_axis(scores, order[:, :1], 1)[:, 0]))
    for c in range(b):
        rest = []
        for i in todo:
            p = order[i, c]
            if room[p]:
                part[i] = p
                room[p] -= 1
            else:
                rest.append(i)
        todo = rest
        if not rest:
            break
    return part


def balanced_partition(x: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.15, passes: int = 12) -> np.ndarray:
    """Parts of nearly equal size that cut few edges of the neighbour graph."""
    n = len(x)
    cap = int(np.ceil(slack * n / parts))
    center = x[rng.choice(n, parts, replace=False)]
    for _ in range(8):
        part = np.argmax(x @ center.T, axis=1)
        total = np.zeros_like(center)
        np.add.at(total, part, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        center = np.where(norm > 0, total / np.maximum(norm, 1e-9), x[rng.choice(n, parts)])
    part = _fill(x @ center.T, cap)
    size = np.bincount(part, minlength=parts)
    # moves that bring a row to where most of its neighbours are, as far as there is room
    back = [[] for _ in range(n)]
    for i, row in enumerate(near):
        for j in row:
            back[j].append(i)
    for _ in range(passes):
        moved = 0
        for i in rng.permutation(n):
            mates = part[np.concatenate([near[i], np.array(back[i][:64], dtype=np.int32)])] if len(back[i]) else part[near[i]]
            votes = np.bincount(mates, minlength=parts)
            votes[(size >= cap) & (np.arange(parts) != part[i])] = -1
            best = int(votes.argmax())
            if best != part[i] and votes[best] > votes[part[i]]:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


def train_router(x: np.ndarray, part: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator, steps: int = 600) -> np.ndarray:
    """Weights (dims + 1, parts) of a softmax classifier; its targets are where a row and its neighbours are."""
    target = np.zeros((len(x), parts), dtype=np.float32)
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0)
    target[np.arange(len(x)), part] += max(1, near.shape[1])
    target /= target.sum(axis=1, keepdims=True)
    xb = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w = np.zeros((xb.shape[1], parts), dtype=np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        i = rng.integers(0, len(x), min(1024, len(x)))
        z = xb[i] @ w
        z = np.exp(z - z.max(axis=1, keepdims=True))
        g = xb[i].T @ (z / z.sum(axis=1, keepdims=True) - target[i]) / len(i) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def fit(x: np.ndarray, parts: int, neighbours: int = 10, seed: int = 7) -> np.ndarray:
    """Router weights for ``parts`` parts; one part needs no learning."""
    parts = max(1, min(parts, len(x) // 8))
    if parts == 1:
        return np.zeros((x.shape[1] + 1, 1), dtype=np.float32)
    rng = np.random.default_rng(seed)
    near = neighbour_graph(x, neighbours)
    return train_router(x, balanced_partition(x, near, parts, rng), near, parts, rng)


def route(x: np.ndarray, w: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` most probable parts of each row, best first."""
    z = x @ w[:-1] + w[-1]
    probes = min(probes, z.shape[1])
    if probes == z.shape[1]:
        return np.argsort(-z, axis=1)
    top = np.argpartition(-z, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(z, top, 1), axis=1), 1)
