"""Linear-chain conditional random fields over sparse node features.

A chain is a list of nodes, a node a list of feature indices; a label's score at
a node is the sum of its features' weights, and each step between nodes adds a
transition score.
"""

from __future__ import annotations

import numpy as np

Chain = tuple[list[list[int]], list[int]]


def forward_backward(potentials: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Marginals of chains walked in step.

    potentials: (nodes, labels), chain after chain, longest first; lengths: of
    the chains. Every step normalises, so nothing under- or overflows.
    """
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    longest = int(lengths[0])
    going = np.searchsorted(-lengths, -np.arange(longest), "left")  # chains with more than t nodes
    alpha = np.empty_like(potentials)
    now = potentials[first]
    now = now / now.sum(1, keepdims=True)
    alpha[first] = now
    for t in range(1, longest):
        at = first[: going[t]] + t
        now = (now[: going[t]] @ transition) * potentials[at]
        now /= now.sum(1, keepdims=True)
        alpha[at] = now
    beta = np.full((len(lengths), potentials.shape[1]), 1.0 / potentials.shape[1])
    for t in range(longest - 1, 0, -1):
        at = first[: going[t]] + t
        now = (beta[: going[t]] * potentials[at]) @ transition.T
        now /= now.sum(1, keepdims=True)
        beta[: going[t]] = now
        alpha[at - 1] *= now
    return alpha / alpha.sum(1, keepdims=True)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best labels of one chain; ties go to the lower label."""
    best, back = scores[0], []
    for row in scores[1:]:
        through = best[:, None] + moves
        back.append(through.argmax(0))
        best = through.max(0) + row
    label = int(best.argmax())
    out = [label]
    for came in reversed(back):
        label = int(came[label])
        out.append(label)
    return out[::-1]


class Trainer:
    """AdaGrad ascent on the conditional likelihood, a small batch of chains at a time."""

    def __init__(self, width: int, labels: int, rate: float = 0.5, decay: float = 1e-3):
        self.labels, self.rate, self.decay = labels, rate, decay
        self.weights, self.moves = np.zeros((width, labels)), np.eye(labels)
        self._seen_w, self._seen_m = np.full((width, labels), 1e-6), np.full((labels, labels), 1e-6)

    def step(self, chains: list[Chain]) -> None:
        chains = sorted(chains, key=lambda c: -len(c[0]))
        lengths = np.array([len(nodes) for nodes, _ in chains])
        nodes = [n for c, _ in chains for n in c]
        index = np.array([x for n in nodes for x in n], np.int64)
        of = np.repeat(np.arange(len(nodes)), [len(n) for n in nodes])
        truth = np.array([y for _, ys in chains for y in ys])
        scores = np.stack([np.bincount(of, self.weights[index, c], len(nodes)) for c in range(self.labels)], 1)
        transition = np.exp(self.moves - self.moves.max())
        marginal = forward_backward(np.exp(scores - scores.max(1, keepdims=True)), lengths, transition)
        error = -marginal
        error[np.arange(len(nodes)), truth] += 1
        touched, inverse = np.unique(index, return_inverse=True)
        grad = np.stack([np.bincount(inverse, error[of, c], len(touched)) for c in range(self.labels)], 1) - self.decay * self.weights[touched]
        self._seen_w[touched] += grad**2
        self.weights[touched] += self.rate * grad / np.sqrt(self._seen_w[touched])
        # Expected moves from the marginals on both sides of a step: close to exact where nodes are clear.
        inner = np.setdiff1d(np.arange(len(nodes)), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        if len(inner):
            pair = marginal[inner - 1][:, :, None] * transition[None] * marginal[inner][:, None, :]
            grad = -(pair / pair.sum((1, 2), keepdims=True)).sum(0) - 1e-2 * self.moves
            np.add.at(grad, (truth[inner - 1], truth[inner]), 1)
            self._seen_m += grad**2
            self.moves += 0.2 * self.rate * grad / np.sqrt(self._seen_m)
