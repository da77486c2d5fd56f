"""A generative model of weak labels: class-conditional vote tables and the correlations between voters."""

from __future__ import annotations

import numpy as np


class LabelModel:
    """Class-conditional vote tables with correlation weights, by expectation-maximisation over pattern counts."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, speaks: np.ndarray, prior: float = 0.1, steps: int = 60):
        """patterns: (p, voters) of 0..2; counts: (p, 3), rows of unknown label, labelled 0, labelled 1.

        speaks: what a vote of a voter counts for the first guess; prior: of class 1 where no labels tell.
        """
        p, v = patterns.shape
        one_hot = np.eye(3)[patterns]
        total = counts.sum()
        known = counts[:, 1:].sum(0)
        self.prior = (known[1] + 1) / (known.sum() + 2) if known.sum() else prior
        strong = patterns @ speaks / 2
        post = np.where(strong >= 1, 0.9, 0.02)
        self.weight = np.ones(v)
        for step in range(steps):
            mass = np.stack([counts[:, 0] * (1 - post) + counts[:, 1], counts[:, 0] * post + counts[:, 2]])
            self.table = np.einsum("cp,pvk->cvk", mass, one_hot) + 0.1
            self.table /= self.table.sum(2, keepdims=True)
            self.prior = (mass[1].sum() + 0.5) / (total + 1) if total else self.prior
            if step in (10, 20, 30):
                self.weight = self.news(patterns, mass)
            post = self.posterior(patterns)
        self.post = post

    def news(self, patterns: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """1 / (1 + sum of a voter's positive residual correlations with the others within the classes)."""
        v = patterns.shape[1]
        cov = np.zeros((v, v))
        for c in (0, 1):
            if mass[c].sum() > 0:
                x = patterns - np.average(patterns, axis=0, weights=mass[c])
                cov += (x * mass[c][:, None]).T @ x
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        rho = np.clip(cov / scale[:, None] / scale[None], 0, 1)
        np.fill_diagonal(rho, 0)
        return 1 / (1 + rho.sum(1))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        at = np.arange(patterns.shape[1])
        gain = np.log(self.table[1][at, patterns]) - np.log(self.table[0][at, patterns])
        z = np.log(self.prior / (1 - self.prior)) + gain @ self.weight
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
