"""Array kernels over batches of texts: words, their hashes, and hashed n-gram counts."""

from __future__ import annotations

import numpy as np

from .tokens import SliceHasher, byte_values, mixed

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing A-Z.
WORD = np.zeros(256, bool)
WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def words(lowered: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of every word."""
    inside = np.zeros(len(lowered) + 2, np.int8)
    inside[1:-1] = WORD[lowered]
    cut = np.diff(inside)
    starts, ends = np.flatnonzero(cut == 1), np.flatnonzero(cut == -1)
    inner = np.unique(offsets[(offsets > 0) & (offsets < len(lowered))])
    inner = inner[WORD[lowered[inner]] & WORD[lowered[inner - 1]]] if len(inner) else inner
    if len(inner):  # words that touch across two texts
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def ngram_counts(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """(texts, 2 ** bits): how often each hashed byte n-gram occurs in each text."""
    n, size = len(offsets) - 1, 1 << bits
    owner = np.repeat(np.arange(n, dtype=np.int64) << bits, np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    out, values, h = np.zeros(n * size, np.int64), byte_values(11)[data], np.zeros(len(data), np.uint64)
    for k in range(1, max(orders) + 1):
        h = h[: len(data) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + values[k - 1 :]
        if k in orders and len(h):
            some = left[: len(h)] >= k
            out += np.bincount(owner[: len(h)][some] + (mixed(h[some] + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64), minlength=n * size)
    return out.reshape(n, size)


def normalized(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, with rows of length 1 (empty rows stay zero)."""
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text index and 64-bit hash (as signed) of every word, in texts that are lower-cased (A-Z) first."""
    lowered = LOWER[data]
    starts, ends, owner = words(lowered, offsets)
    return owner, SliceHasher(lowered)(starts, ends).view(np.int64)


def linear_fit(x: np.ndarray, target: np.ndarray, weight: np.ndarray, loss: str, l2: float, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of linear models, one for each column of target, by accelerated gradient descent.

    loss 'softmax': target rows are class probabilities. 'hinge': squared hinge, target in -1, 1. 'logistic': target in 0..1."""
    w, b = np.zeros((x.shape[1], target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
    vw, vb, t = w.copy(), b.copy(), 1.0
    weight = (weight / weight.sum())[:, None].astype(np.float32)
    step = 1 / ({"softmax": 1.0, "hinge": 4.0, "logistic": 0.5}[loss] * float((weight[:, 0] * (1 + (x * x).sum(1))).sum()) + l2)
    for _ in range(rounds):
        z = x @ vw + vb
        if loss == "softmax":
            z = np.exp(z - z.max(1, keepdims=True))
            g = z / z.sum(1, keepdims=True) - target
        elif loss == "logistic":
            g = 1 / (1 + np.exp(-z)) - target
        else:
            g = -2 * target * np.maximum(0, 1 - target * z)
        g = (g * weight).astype(np.float32)
        nw, nb, nt = vw - step * (x.T @ g + l2 * vw), vb - step * g.sum(0), (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b
