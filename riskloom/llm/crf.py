"""Linear-chain conditional random field with two labels: training by gradient on a bounded set of sequences, Viterbi decoding.

A sequence is a matrix of one feature row per item. Its score under labels y is the sum of row @ emission[y_i] and of
transition[y_i, y_i+1].
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class LinearChain:
    emission: np.ndarray  # features x 2
    transition: np.ndarray  # 2 x 2


def _padded(sequences: list[np.ndarray], labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longest, width = max(map(len, sequences)), sequences[0].shape[1]
    x, y, mask = np.zeros((len(sequences), longest, width)), np.zeros((len(sequences), longest), np.int64), np.zeros((len(sequences), longest), bool)
    for i, (s, l) in enumerate(zip(sequences, labels, strict=True)):
        x[i, : len(s)], y[i, : len(s)], mask[i, : len(s)] = s, l, True
    return x, y, mask


def train(sequences: list[np.ndarray], labels: list[np.ndarray], weights: tuple[float, float] = (1.0, 1.0), rounds: int = 150, decay: float = 1e-3, rate: float = 0.1, times: list[int] | None = None) -> LinearChain:
    """Most likely parameters by Adam on the log-likelihood. An item's emission counts by the weight of its label, and a sequence as
    often as times says; sequences are batched as one padded block."""
    times = times or [1] * len(sequences)
    often = np.array([n for s, n in zip(sequences, times, strict=True) if len(s)], float)
    kept = [(s, l) for s, l in zip(sequences, labels, strict=True) if len(s)]
    if not kept:
        return LinearChain(np.zeros((sequences[0].shape[1] if sequences else 1, 2)), np.zeros((2, 2)))
    x, y, mask = _padded(*map(list, zip(*kept, strict=True)))
    n, steps, width = x.shape
    model = LinearChain(np.zeros((width, 2)), np.zeros((2, 2)))
    first = [np.zeros((width, 2)), np.zeros((2, 2))]
    second = [np.zeros((width, 2)), np.zeros((2, 2))]
    truth = np.eye(2)[y] * mask[..., None]
    item = np.asarray(weights)[y] * mask * often[:, None]
    total = (mask * often[:, None]).sum()
    for step in range(1, rounds + 1):
        e = x @ model.emission
        forward, backward = np.zeros((steps, n, 2)), np.zeros((steps, n, 2))
        forward[0] = e[:, 0]
        for t in range(1, steps):
            moved = np.logaddexp(forward[t - 1][:, :1] + model.transition[0], forward[t - 1][:, 1:] + model.transition[1]) + e[:, t]
            forward[t] = np.where(mask[:, t, None], moved, forward[t - 1])
        for t in range(steps - 2, -1, -1):
            ahead = e[:, t + 1] + backward[t + 1]
            moved = np.logaddexp(ahead[:, :1] + model.transition[:, 0], ahead[:, 1:] + model.transition[:, 1])
            backward[t] = np.where(mask[:, t + 1, None], moved, 0)
        norm = np.logaddexp(forward[-1][:, 0], forward[-1][:, 1])
        marginal = np.exp(np.swapaxes(forward + backward, 0, 1) - norm[:, None, None]) * mask[..., None]
        slope_e = np.einsum("ntf,ntl->fl", x, (truth - marginal) * item[..., None]) / total - decay * model.emission
        slope_t = np.zeros((2, 2))
        for a in range(2):
            for b in range(2):
                pair = forward[:-1, :, a] + model.transition[a, b] + e[:, 1:, b].T + backward[1:, :, b] - norm
                both = mask[:, 1:].T
                slope_t[a, b] = (((truth[:, :-1, a] * truth[:, 1:, b]).T * both - np.exp(np.where(both, pair, -np.inf))) @ often).sum() / total
        slope_t -= decay * model.transition
        for i, (p, g) in enumerate(((model.emission, slope_e), (model.transition, slope_t))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            p += rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return model


def viterbi(model: LinearChain, features: np.ndarray) -> list[int]:
    """The best label sequence; a tie goes to label 0."""
    if not len(features):
        return []
    e = (features @ model.emission).tolist()
    (t00, t01), (t10, t11) = model.transition.tolist()
    s0, s1 = e[0]
    back = []
    for e0, e1 in e[1:]:
        from0 = (0, s0 + t00) if s0 + t00 >= s1 + t10 else (1, s1 + t10)
        from1 = (0, s0 + t01) if s0 + t01 >= s1 + t11 else (1, s1 + t11)
        back.append((from0[0], from1[0]))
        s0, s1 = from0[1] + e0, from1[1] + e1
    path = [0 if s0 >= s1 else 1]
    for pair in reversed(back):
        path.append(pair[path[-1]])
    return path[::-1]
