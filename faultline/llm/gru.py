"""A gated recurrent network in NumPy: forward, backpropagation through time, and Adam.

Inputs come projected: an array (steps, rows, 3 * hidden) with the update, reset and candidate
parts.  The recurrent weights are one matrix (hidden, 3 * hidden).
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(inputs: np.ndarray, recurrent: np.ndarray, keep: bool = False):
    """Hidden states of all steps; with ``keep`` also what ``backward`` needs."""
    steps, rows, _ = inputs.shape
    hidden = len(recurrent)
    states = np.empty((steps, rows, hidden), inputs.dtype)
    h = np.zeros((rows, hidden), inputs.dtype)
    kept = []
    for t in range(steps):
        a = h @ recurrent
        gates = sigmoid(inputs[t, :, : 2 * hidden] + a[:, : 2 * hidden])
        update, reset = gates[:, :hidden], gates[:, hidden:]
        new = np.tanh(inputs[t, :, 2 * hidden :] + reset * a[:, 2 * hidden :])
        before, h = h, new + update * (h - new)
        states[t] = h
        if keep:
            kept.append((before, update, reset, new, a[:, 2 * hidden :]))
    return (states, kept) if keep else states


def backward(grad_states: np.ndarray, recurrent: np.ndarray, kept: list):
    """Gradients of the inputs and of the recurrent weights."""
    steps, rows, hidden = grad_states.shape
    grad_inputs = np.empty((steps, rows, 3 * hidden), grad_states.dtype)
    grad_recurrent = np.zeros_like(recurrent)
    carried = np.zeros((rows, hidden), grad_states.dtype)
    for t in reversed(range(steps)):
        before, update, reset, new, inner = kept[t]
        d = grad_states[t] + carried
        d_new = d * (1 - update) * (1 - new * new)
        d_update = d * (before - new) * update * (1 - update)
        d_reset = d_new * inner * reset * (1 - reset)
        d_a = np.concatenate([d_update, d_reset, d_new * reset], 1)
        grad_inputs[t] = np.concatenate([d_update, d_reset, d_new], 1)
        grad_recurrent += before.T @ d_a
        carried = d * update + d_a @ recurrent.T
    return grad_inputs, grad_recurrent


def sum_rows(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the rows of ``values`` that share an index."""
    return np.stack(
        [np.bincount(index, weights=values[:, j], minlength=rows) for j in range(values.shape[1])], 1
    ).astype(values.dtype)


class Adam:
    def __init__(self, parameters: dict[str, np.ndarray], rate: float):
        self.parameters, self.rate, self.step = parameters, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.second = {k: np.zeros_like(v) for k, v in parameters.items()}

    def update(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in gradients.items():
            norm = np.sqrt((g * g).sum())
            if norm > 5:
                g = g * (5 / norm)
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            self.parameters[k] -= (scale * self.first[k] / (np.sqrt(self.second[k]) + 1e-8)).astype(g.dtype)


def initial(rng: np.random.Generator, *shape: int, scale: float | None = None) -> np.ndarray:
    spread = scale if scale is not None else 1 / np.sqrt(shape[0])
    return (rng.standard_normal(shape) * spread).astype(np.float32)
