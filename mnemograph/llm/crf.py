"""A linear-chain conditional random field in numpy: a small model, trained on the driver."""

from __future__ import annotations

import numpy as np
from numpy.typing import NDArray


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class CRF:
    """Label scores are linear in a clause's features, label pairs have scores of their own."""

    def __init__(self, weights: NDArray, pairs: NDArray):
        self.weights, self.pairs = weights, pairs

    @staticmethod
    def _forward_backward(scores: np.ndarray, pairs: np.ndarray, lengths: np.ndarray):
        """log Z, marginals and pair marginals of padded sequences (rows x steps x labels), the longest first.

        A step is worked out for the sequences that reach it only.
        """
        n, steps, labels = scores.shape
        active = [int((lengths > t).sum()) for t in range(steps)]
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        alpha[:, 0] = scores[:, 0]
        for t in range(1, steps):
            a = active[t]
            alpha[:a, t] = _logsumexp(alpha[:a, t - 1, :, None] + pairs, 1) + scores[:a, t]
        for t in range(steps - 2, -1, -1):
            a = active[t + 1]
            beta[:a, t] = _logsumexp(pairs + (scores[:a, t + 1] + beta[:a, t + 1])[:, None, :], 2)
        log_z = _logsumexp(alpha[np.arange(n), lengths - 1], 1)
        marginal = np.exp(np.minimum(0, alpha + beta - log_z[:, None, None]))
        both = np.zeros((labels, labels))
        for t in range(1, steps):
            a = active[t]
            step = alpha[:a, t - 1, :, None] + pairs + (scores[:a, t] + beta[:a, t])[:, None, :] - log_z[:a, None, None]
            both += np.exp(np.minimum(0, step)).sum(axis=0)
        return log_z, marginal, both

    @classmethod
    def fit(cls, sequences: list[NDArray], labels: list[NDArray], n_labels: int, rounds: int = 200, penalty: float = 2e-3, rate: float = 0.08) -> CRF:
        """Maximum likelihood with an L2 penalty, by Adam over all sequences."""
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        sequences, labels = [sequences[i] for i in order], [labels[i] for i in order]
        lengths = np.array([len(s) for s in sequences])
        n, steps, width = len(sequences), max(map(len, sequences)), sequences[0].shape[1]
        x = np.concatenate(sequences).astype(np.float32)  # the features are held without padding, in the order of the mask
        y = np.zeros((n, steps), np.int64)
        mask = np.zeros((n, steps), bool)
        for i, l in enumerate(labels):
            y[i, : len(l)], mask[i, : len(l)] = l, True
        gold = np.eye(n_labels)[y] * mask[:, :, None]
        turned = np.ascontiguousarray(x.T)
        gold_x = turned @ gold[mask].astype(np.float32)
        scores = np.zeros((n, steps, n_labels))
        gold_pairs = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
        theta = np.zeros(width * n_labels + n_labels * n_labels)
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):
            w, p = theta[: width * n_labels].reshape(width, n_labels), theta[width * n_labels :].reshape(n_labels, n_labels)
            scores[mask] = x @ w.astype(np.float32)
            _, marginal, both = cls._forward_backward(scores, p, lengths)
            slope = np.concatenate([(turned @ marginal[mask].astype(np.float32) - gold_x).ravel(), (both - gold_pairs).ravel()]) / n + penalty * theta
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope**2
            theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        return cls(theta[: width * n_labels].reshape(width, n_labels), theta[width * n_labels :].reshape(n_labels, n_labels))

    def best(self, sequence: NDArray) -> NDArray:
        """The most likely labels of one sequence (Viterbi)."""
        scores = sequence @ self.weights
        back = np.zeros(scores.shape, np.int64)
        now = scores[0]
        for t in range(1, len(scores)):
            reach = now[:, None] + self.pairs
            back[t] = reach.argmax(axis=0)
            now = reach.max(axis=0) + scores[t]
        labels = [int(now.argmax())]
        for t in range(len(scores) - 1, 0, -1):
            labels.append(int(back[t, labels[-1]]))
        return np.array(labels[::-1])
