"""Recursive graph bisection of documents by the terms that they share.

Each node splits its documents into halves and exchanges those that shorten the logarithmic gaps between documents of
the same term most, until no pair gains. What is kept of a node is a weight for each hashed term and a threshold, so
that documents which were not fitted find their way down the tree as well.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """``weights[node]`` and ``cuts[node]`` in heap order, the root at 1; a document goes right where its weights add up to more than the cut."""

    depth: int
    weights: np.ndarray
    cuts: np.ndarray

    def leaves(self, starts: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The leaf of each document; ``terms[starts[i]:starts[i + 1]]`` are its hashed terms."""
        n = len(starts) - 1
        at = np.ones(n, dtype=np.int64)
        owner = np.repeat(np.arange(n), np.diff(starts))
        for _ in range(self.depth):
            score = np.bincount(owner, weights=self.weights[at[owner], terms], minlength=n)
            at = 2 * at + (score > self.cuts[at])
        return at - (1 << self.depth)


def _log_cost(degree: np.ndarray, size: int) -> np.ndarray:
    """Bits for the gaps of a term that so many of ``size`` documents have."""
    return degree * np.log2(max(size, 1) / (degree + 1.0))


def _halves(docs: np.ndarray, starts: np.ndarray, terms: np.ndarray, n_terms: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a node and each document's sum of them, after the exchanges."""
    pieces = [terms[starts[d] : starts[d + 1]] for d in docs]
    owner = np.repeat(np.arange(len(docs)), [len(p) for p in pieces])
    own = np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.int64)
    right = np.arange(len(docs)) >= len(docs) // 2
    sizes = len(docs) // 2, len(docs) - len(docs) // 2
    for _ in range(rounds):
        degrees = [np.bincount(own[right[owner] == side], minlength=n_terms).astype(float) for side in (False, True)]
        now = _log_cost(degrees[0], sizes[0]) + _log_cost(degrees[1], sizes[1])
        to_right = now - _log_cost(np.maximum(degrees[0] - 1, 0), sizes[0]) - _log_cost(degrees[1] + 1, sizes[1])
        to_left = now - _log_cost(degrees[0] + 1, sizes[0]) - _log_cost(np.maximum(degrees[1] - 1, 0), sizes[1])
        gain = np.bincount(owner, weights=np.where(right[owner], to_left[own], to_right[own]), minlength=len(docs))
        lefts, rights = np.flatnonzero(~right), np.flatnonzero(right)
        lefts, rights = lefts[np.argsort(-gain[lefts], kind="stable")], rights[np.argsort(-gain[rights], kind="stable")]
        k = min(len(lefts), len(rights))
        pairs = int((gain[lefts[:k]] + gain[rights[:k]] > 1e-9).sum())
        if not pairs:
            break
        right[lefts[:pairs]], right[rights[:pairs]] = True, False
    degrees = [np.bincount(own[right[owner] == side], minlength=n_terms).astype(float) for side in (False, True)]
    weights = np.log2((degrees[1] + 1) / (sizes[1] + 1)) - np.log2((degrees[0] + 1) / (sizes[0] + 1))
    return weights, np.bincount(owner, weights=weights[own], minlength=len(docs))


def fit(starts: np.ndarray, terms: np.ndarray, n_terms: int, depth: int, rounds: int = 12) -> Tree:
    """A tree with ``2 ** depth`` leaves of about equally many of the documents given."""
    weights, cuts = np.zeros((1 << depth, n_terms), dtype=np.float32), np.zeros(1 << depth)
    parts = {1: np.arange(len(starts) - 1)}
    for node in range(1, 1 << depth):
        docs = parts.pop(node)
        w, score = _halves(docs, starts, terms, n_terms, rounds)
        weights[node] = w
        owner_score = score.astype(np.float32)
        cuts[node] = float(np.median(owner_score)) if len(docs) else 0.0
        goes = owner_score > cuts[node]
        parts[2 * node], parts[2 * node + 1] = docs[~goes], docs[goes]
    return Tree(depth, weights, cuts)
