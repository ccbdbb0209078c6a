"""Online learners over ordered sequences: mixers with weight sets, calibration chains, least squares and sign-normalised filters.

Each is a loop over one sequence with numpy vectors at every step; sequences are a key's chunks of bounded length, and what one chunk has
learned can start the next (state in, state out).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd

LOGIT = 8.0


def stretch(p: np.ndarray | float) -> np.ndarray | float:
    return np.clip(np.log(p / (1 - p)), -LOGIT, LOGIT)


def squash(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -LOGIT, LOGIT)))


@dataclass
class Mixer:
    """Sets of weights over the same inputs, one set of each group chosen by a context; their outputs are mixed once more."""

    inputs: int
    sizes: tuple[int, ...] = (1,)
    rate: float = 0.02
    weights: list[np.ndarray] = field(init=False)
    last: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.weights = [np.full((n, self.inputs), 1 / self.inputs) for n in self.sizes]
        self.last = np.full(len(self.sizes), 1 / len(self.sizes))

    def step(self, p: np.ndarray, contexts: tuple[int, ...], y: float) -> float:
        """The mixed probability of 1, then learning from y."""
        x = stretch(p)
        each = np.array([w[c] @ x for w, c in zip(self.weights, contexts, strict=True)])
        first = squash(each)
        z = stretch(np.clip(first, 1e-6, 1 - 1e-6))
        out = float(squash(self.last @ z))
        for w, c, q in zip(self.weights, contexts, first, strict=True):
            w[c] += self.rate * (y - q) * x
        self.last += self.rate / 4 * (y - out) * z
        return out


@dataclass
class Calibration:
    """A probability refined by context: a table of NODES logits for each context, read between two of them and moved towards y."""

    contexts: int = 1
    nodes: int = 24
    rate: float = 0.02
    table: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.table = np.tile(squash(np.linspace(-LOGIT, LOGIT, self.nodes)), (self.contexts, 1))

    def step(self, p: float, context: int, y: float) -> float:
        at = (float(stretch(p)) + LOGIT) * (self.nodes - 1) / (2 * LOGIT)
        low = min(int(at), self.nodes - 2)
        part = at - low
        row = self.table[context]
        out = row[low] * (1 - part) + row[low + 1] * part
        near = low + (part >= 0.5)
        row[near] += self.rate * (y - row[near])
        return float(out)


def chain(p: float, stages: list[Calibration], contexts: tuple[int, ...], y: float) -> float:
    """Calibrations one after the other, each averaged with what went in, as logits."""
    for s, c in zip(stages, contexts, strict=True):
        q = s.step(float(np.clip(p, 1e-6, 1 - 1e-6)), c, y)
        p = float(squash((stretch(np.clip(p, 1e-6, 1 - 1e-6)) + stretch(np.clip(q, 1e-6, 1 - 1e-6))) / 2))
    return p


def mix(p: np.ndarray, y: np.ndarray, rate: float = 0.02, contexts: np.ndarray | None = None) -> np.ndarray:
    """Mixed probabilities of a sequence: a column for each input, and a context for each row."""
    c = np.zeros(len(p), np.int64) if contexts is None else contexts
    mixer = Mixer(p.shape[1], (int(c.max(initial=0)) + 1,), rate)
    return np.array([mixer.step(row, (k,), v) for row, k, v in zip(p, c.tolist(), y, strict=True)])


def least_squares(x: np.ndarray, y: np.ndarray, keep: float = 0.998, ridge: float = 1.0) -> np.ndarray:
    """Predictions before each value is seen, with exponential forgetting (recursive form)."""
    n = x.shape[1]
    w, inverse, out = np.zeros(n), np.eye(n) / ridge, np.empty(len(y))
    for k in range(len(y)):
        out[k] = x[k] @ w
        gain = inverse @ x[k] / (keep + x[k] @ inverse @ x[k])
        w = w + gain * (y[k] - out[k])
        inverse = (inverse - np.outer(gain, x[k] @ inverse)) / keep
    return out


def batch_least_squares(x: np.ndarray, y: np.ndarray, keep: float = 0.998, ridge: float = 1.0, every: int = 1) -> np.ndarray:
    """The same by running normal equations, solved by a Cholesky factor after every so many values; equal to the recursive form at every = 1."""
    n = x.shape[1]
    a, b, w, out = np.eye(n) * ridge, np.zeros(n), np.zeros(n), np.empty(len(y))
    for k in range(len(y)):
        out[k] = x[k] @ w
        a = keep * a + np.outer(x[k], x[k])
        b = keep * b + x[k] * y[k]
        if (k + 1) % every == 0:
            root = np.linalg.cholesky(a)
            w = np.linalg.solve(root.T, np.linalg.solve(root, b))
    return out


def normalised_filter(x: np.ndarray, y: np.ndarray, rate: float = 0.002, keep: float = 0.97) -> np.ndarray:
    """Predictions of a linear filter whose steps are the error times each input over the root of that input's running gradient power."""
    w, power, out = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.empty(len(y))
    for k in range(len(y)):
        out[k] = x[k] @ w
        step = (y[k] - out[k]) * x[k]
        power = keep * power + (1 - keep) * step * step
        w += rate * step / (np.sqrt(power) + 1e-8)
    return out


def taps(values: np.ndarray, n: int, stride: int = 1) -> np.ndarray:
    """The n values before each, every stride-th; zero before the first."""
    out = np.zeros((len(values), n))
    for k in range(n):
        back = (k + 1) * stride
        out[back:, k] = values[: len(values) - back]
    return out


def linear_predictions(values: np.ndarray, n: int = 32, strides: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """A column of one-ahead predictions for each stride: least squares over the n values before, every stride-th."""
    return np.stack([least_squares(taps(values, n, s), values) for s in strides], axis=1)


def mixed_loss(group: pd.DataFrame) -> pd.DataFrame:
    """block, n, bits, bits_calibrated: mean costs of y under a mix of two running estimates, and after two calibrations."""
    group = group.sort_values("event_id")
    y, kind = group["y"].to_numpy(float), group["kind"].to_numpy(np.int64)
    fast, slow, before = 0.5, 0.5, 0
    mixer, stages = Mixer(2, (int(kind.max(initial=0)) + 1, 4)), [Calibration(4), Calibration(int(kind.max(initial=0)) + 1)]
    cost = np.zeros(2)
    for v, k in zip(y, kind.tolist(), strict=True):
        p = mixer.step(np.clip((fast, slow), 1e-3, 1 - 1e-3), (k, before), v)
        q = chain(p, stages, (before, k), v)
        cost -= np.log2(np.clip([p if v else 1 - p, q if v else 1 - q], 1e-9, 1))
        fast, slow, before = fast + (v - fast) / 8, slow + (v - slow) / 64, (before * 2 + int(v)) % 4
    mean = cost / max(1, len(y))
    return pd.DataFrame({"block": group["block"].iloc[:1], "n": [len(y)], "bits": [round(float(mean[0]), 6)], "bits_calibrated": [round(float(mean[1]), 6)]})


def online_fit(group: pd.DataFrame) -> pd.DataFrame:
    """block, n, error, error_filter: root mean square errors of predicting a value from those before it, by least squares over 32 and by the filter over 16."""
    v = group.sort_values("event_id")["value"].to_numpy(float)
    fitted = linear_predictions(v - v.mean(), 32, (1, 2, 3)).mean(axis=1)
    filtered = normalised_filter(taps(v - v.mean(), 16), v - v.mean())
    error = lambda p: round(float(np.sqrt(np.mean((p - (v - v.mean())) ** 2))), 6)
    return pd.DataFrame({"block": group["block"].iloc[:1], "n": [len(v)], "error": [error(fitted)], "error_filter": [error(filtered)]})
