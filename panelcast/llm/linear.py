"""Logistic models over hashed n-grams, fitted in numpy on a bounded sample and scored in tasks.

A document's features are shares: its n-gram counts by hash slot, divided by their number. A score is
then a mean over the document of per-word numbers, so tasks compute n-grams once per distinct word
of a slice and add numbers up by document.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def adam(
    parameters: dict[str, np.ndarray],
    gradient: Callable[[int], dict[str, np.ndarray]],
    steps: int,
    rate: float,
) -> None:
    """Changes the parameters in place; ``gradient(step)`` reads their present values."""
    first = {k: np.zeros_like(v) for k, v in parameters.items()}
    second = {k: np.zeros_like(v) for k, v in parameters.items()}
    for step in range(1, steps + 1):
        for k, g in gradient(step).items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            scale = np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8
            parameters[k] -= (rate / (1 - 0.9**step)) * first[k] / scale


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(
    x: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.02, decay: float = 1e-3
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x outputs) and intercepts of independent logistic models.

    ``x`` holds shares by row; ``y`` 0 or 1 per row and output. Classes weigh alike, columns are
    scaled to unit spread during the fit, and weights decay towards zero. ``x`` (single precision) is
    scaled in place: its values are lost.
    """
    y = y.reshape(len(y), -1).astype(np.float32)
    mean = x.mean(axis=0)
    square = np.einsum("ij,ij->j", x, x) / len(x)
    spread = np.sqrt(np.maximum(square - mean * mean, 0)) + np.float32(1e-4)
    x -= mean
    x /= spread
    z = x
    ones = np.maximum(y.mean(axis=0), 1e-6)
    weight = np.where(y > 0, 0.5 / ones, 0.5 / np.maximum(1 - ones, 1e-6)) / len(y)
    p = {
        "w": np.zeros((x.shape[1], y.shape[1]), np.float32),
        "b": np.zeros(y.shape[1], np.float32),
    }

    def gradient(step: int) -> dict[str, np.ndarray]:
        error = ((sigmoid(z @ p["w"] + p["b"]) - y) * weight).astype(np.float32)
        return {"w": z.T @ error + decay * p["w"], "b": error.sum(axis=0)}

    adam(p, gradient, steps, rate)
    w = p["w"] / spread[:, None]
    return w.astype(np.float64), (p["b"] - mean @ w).astype(np.float64)


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities (logistic, targets kept off 0 and 1)."""
    ones = y.sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    centre, spread = margin.mean(), margin.std() + 1e-9
    z = (margin - centre) / spread
    p = {"a": np.ones(1), "c": np.zeros(1)}

    def gradient(step: int) -> dict[str, np.ndarray]:
        error = sigmoid(p["a"] * z + p["c"]) - target
        return {"a": np.array([(error * z).mean()]), "c": np.array([error.mean()])}

    adam(p, gradient, steps, 0.05)
    slope = max(float(p["a"][0]), 0.0) / spread
    return slope, float(p["c"][0]) - slope * centre
