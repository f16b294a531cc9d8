"""Logistic regression on sparse rows, with a calibrated probability; fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

import numpy as np

#: Rows that are worked on at a time.
BLOCK = 128


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Rows:
    """Sparse rows, given as (columns, values) of each; kept and worked through in blocks, so that steps copy little."""

    def __init__(self, rows: Iterable[tuple[np.ndarray, np.ndarray]], width: int):
        self.n, self.width, self.blocks = 0, width, []
        rows = iter(rows)
        while block := list(islice(rows, BLOCK)):
            index = np.repeat(np.arange(len(block), dtype=np.int32), [len(columns) for columns, _ in block])
            columns, values = (np.concatenate(parts) for parts in zip(*block))
            self.blocks.append((slice(self.n, self.n + len(block)), index, columns, values))
            self.n += len(block)

    def times(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for rows, index, columns, values in self.blocks:
            out[rows] = np.bincount(index, values * weights[columns], rows.stop - rows.start)
        return out

    def back(self, errors: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for rows, index, columns, values in self.blocks:
            np.add.at(out, columns, values * errors[rows][index])
        return out


def fit(rows: Rows, labels: np.ndarray, steps: int = 200, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam, both classes with equal total weight."""
    weights, bias = np.zeros(rows.width), 0.0
    share = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    first, second = np.zeros(rows.width + 1), np.zeros(rows.width + 1)
    for step in range(1, steps + 1):
        errors = (sigmoid(rows.times(weights) + bias) - labels) * share
        slope = np.append(rows.back(errors) + decay * weights, errors.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, bias


def calibrate(scores: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Platt scaling: slope and offset with P(label 1) = sigmoid(slope * score + offset), by Newton's method.

    Targets are pulled towards one half by one row of each class, so that a clean separation stays finite.
    """
    ones, zeros = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([scores, np.ones(len(scores))])
    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(at @ x)
        slope = x @ (p - target)
        bend = (x * np.maximum(p * (1 - p), 1e-6)) @ x.T + 1e-9 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        at = at - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(at[0]), float(at[1])
