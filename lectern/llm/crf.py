"""Linear-chain conditional random fields in NumPy, for use inside tasks.

Sequences lie one behind the other in flat arrays. All sequences of a batch
advance together, position by position, longest first, so the work per position
is a few vector operations over the sequences that are still running.

A sequence longer than ``longest`` is cut into pieces that advance side by side, too.
The matrix products of the pieces, made first, give what comes into each piece from its
left and from its right, so that the marginals are those of the whole sequence.
"""

from __future__ import annotations

import numpy as np


class Chains:
    """Layout of sequences of given lengths in a flat array."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        first = np.cumsum(lengths) - lengths
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths, self.first = lengths[self.order], first[self.order]
        self.steps = int(lengths.max()) if len(lengths) else 0
        # sequences longer than t, for each t
        self.running = np.searchsorted(-self.lengths, -np.arange(self.steps), side="left")


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row over its sum."""
    return x / x.sum(axis=-1, keepdims=True)


def _edges(e: np.ndarray, chains: Chains, t_matrix: np.ndarray, start: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What comes into each piece: (forward vector before its first position, backward vector behind its last one).

    ``owner`` is the sequence of each piece, in the order of the text; the vectors are in the order of ``chains``.
    """
    n, k = len(owner), e.shape[1]
    product = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(chains.steps):
        m = chains.running[t]
        # a sequence's first position is entered by the start scores
        step = product[:m] @ t_matrix if t else np.where((np.arange(n) == np.searchsorted(owner, owner))[chains.order[:m], None, None], np.eye(k), t_matrix)
        product[:m] = step * e[chains.first[:m] + t][:, None, :]
        product[:m] /= product[:m].max(axis=(1, 2), keepdims=True)
    placed = np.empty_like(product)
    placed[chains.order] = product
    left, right = np.empty((n, k)), np.ones((n, k))
    for i in range(n):
        left[i] = start if i == 0 or owner[i] != owner[i - 1] else _scaled(left[i - 1] @ placed[i - 1])
    for i in range(n - 2, -1, -1):
        if owner[i] == owner[i + 1]:
            right[i] = _scaled(placed[i + 1] @ right[i + 1])
    return left[chains.order], right[chains.order]


def marginals(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray, pairs: bool = False, longest: int = 1024) -> tuple[np.ndarray, float, np.ndarray | None]:
    """Label marginals of every position, the summed log partition function, and,
    if asked for, expected counts of label pairs. All scores are logarithms."""
    lengths = np.asarray(lengths, np.int64)
    n, k = emission.shape
    if not n:
        return np.empty((0, k)), 0.0, np.zeros((k, k)) if pairs else None
    count = np.maximum(1, -(-lengths // longest))
    owner = np.repeat(np.arange(len(lengths)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    chains = Chains(np.where(lengths[owner] > 0, np.minimum(longest, lengths[owner] - longest * place), 0))
    top = emission.max(axis=1, keepdims=True)
    e = np.exp(emission - top)
    shift = transition.max()
    t_matrix, begin = np.exp(transition - shift), np.exp(start - start.max())
    is_first = (place == 0)[chains.order]
    if len(owner) > len(lengths):
        left, right = _edges(e, chains, t_matrix, begin, owner)
    else:
        left, right = np.broadcast_to(begin, (len(owner), k)), np.ones((len(owner), k))
    alpha, scale = np.empty((n, k)), np.ones(n)
    current = np.where(is_first[:, None], left, left @ t_matrix)
    for t in range(chains.steps):
        at = chains.first[: chains.running[t]] + t
        a = e[at] * (current[: len(at)] if t == 0 else current[: len(at)] @ t_matrix)
        s = a.sum(axis=1)
        current = a / s[:, None]
        alpha[at], scale[at] = current, s
    some = int((lengths > 0).sum())
    total = float(np.log(scale).sum() + top.sum() + shift * (n - some) + start.max() * some)
    gamma = np.empty((n, k))
    counts = np.zeros((k, k)) if pairs else None
    beta = right.copy()

    def count_pairs(before: np.ndarray, behind: np.ndarray, later: np.ndarray) -> None:
        both = alpha[before][:, :, None] * t_matrix * (e[behind] * later)[:, None, :]
        counts[:] += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)

    for t in range(chains.steps - 1, -1, -1):
        m = chains.running[t]
        at = chains.first[:m] + t
        going = chains.running[t + 1] if t + 1 < chains.steps else 0
        if going:
            after = at[:going] + 1
            if pairs:
                count_pairs(at[:going], after, beta[:going])
            beta[:going] = _scaled((e[after] * beta[:going]) @ t_matrix.T)
        gamma[at] = _scaled(alpha[at] * beta[:m])
    if pairs and not is_first.all():
        # from a piece's last position to the next one's first, whose backward vector is its marginal over its forward vector
        entered = chains.first[~is_first]
        count_pairs(entered - 1, entered, gamma[entered] / np.maximum(alpha[entered], 1e-300))
    return gamma, total, counts


def adam(params: list[np.ndarray], gradient, steps: int, rate: float) -> list[np.ndarray]:
    """Ascend along ``gradient(params)``; the same steps for the same data."""
    params = [p.astype(np.float64).copy() for p in params]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for i in range(1, steps + 1):
        for p, g, m, v in zip(params, gradient(params), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (1 - 0.9 * i / steps) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    return params
