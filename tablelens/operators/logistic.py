"""How near a fitted logistic regression is to its optimum, and the rest of the way there.

One pass over the rows sums up the objective, its gradient and its Hessian at
given coefficients (Newton's ingredients; their size is that of the model).
The objective is the mean logistic loss plus ``reg`` / 2 times the squared
coefficients, without intercepts, as MLlib has it with ``standardization=False``.

The certificate: the loss is self-concordant in Bach's sense ("Self-concordant
analysis for logistic regression", 2010, proposition 2).  With the Newton
decrement v, the least eigenvalue e of the Hessian and rows no longer than R, if
v <= sqrt(e) / (2 R) then the optimum lies within 4 v / sqrt(e).  For more than
two classes the third derivative is bounded by sqrt(2) R instead of R, and
intercepts are compared up to a common shift, which changes no probability.

Edge cases: rows with a missing value are left out (NaN counts as missing);
labels other than 0 to k - 1 are an error; an empty table is a ValueError.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dense import complete_rows, fold


@dataclass(frozen=True)
class Certificate:
    n: int
    objective: float
    gradient: np.ndarray              # by class and feature, the intercept last; one row for two classes
    newton_step: np.ndarray           # what Newton's method would add
    decrement: float
    distance: float                   # bound on the distance from the optimum; infinite if none can be given

    @property
    def largest_gradient(self) -> float:
        return float(np.abs(self.gradient).max())


def _sums(width: int, classes: int, weights: np.ndarray):
    """add and merge of ``fold``: n, loss, largest squared row, gradient and Hessian, flat."""
    k = 1 if classes == 2 else classes
    d = k * width

    def add(state: np.ndarray | None, block: np.ndarray) -> np.ndarray:
        x, y = np.column_stack([block[:, :-1], np.ones(len(block))]), block[:, -1].astype(int)
        z = x @ weights.T
        if k == 1:
            z = np.column_stack([np.zeros(len(x)), z[:, 0]])
        top = z.max(axis=1, keepdims=True)
        e = np.exp(z - top)
        p = e / e.sum(axis=1, keepdims=True)
        loss = (top[:, 0] + np.log(e.sum(axis=1)) - z[np.arange(len(x)), y]).sum()
        miss = p.copy()
        miss[np.arange(len(x)), y] -= 1
        p, miss = (p[:, 1:], miss[:, 1:]) if k == 1 else (p, miss)
        hessian = np.empty((k, width, k, width))
        for a in range(k):
            for b in range(a, k):
                h = (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
                hessian[a, :, b], hessian[b, :, a] = h, h.T
        own = np.concatenate([[len(x), loss, (x * x).sum(axis=1).max()], (miss.T @ x).ravel(), hessian.ravel()])
        return own if state is None else merge(state, own)

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = a + b
        out[2] = max(a[2], b[2])
        return out

    return add, merge, k, d


def _rows(df: DataFrame, features: list[str], label: str, classes: int) -> DataFrame:
    rows = complete_rows(df, features, label)
    bad = ~F.col("y").isin([float(c) for c in range(classes)])
    return rows.withColumn("y", F.when(bad, F.raise_error(F.concat(F.lit("not a class number: "), F.col("y"))).cast("double"))
                           .otherwise(F.col("y")))


def certify(df: DataFrame, features: list[str], label: str, weights: np.ndarray, classes: int = 2,
            reg: float | None = None) -> Certificate:
    """The certificate of ``weights`` (a row per class, one for two classes; the intercept last) on ``df``, in one pass.

    ``reg`` None is one over the number of rows, which is C = 1 in the summed form.
    """
    weights = np.atleast_2d(np.asarray(weights, dtype=float))
    width = len(features) + 1
    add, merge, k, d = _sums(width, classes, weights)
    if weights.shape != (k, width):
        raise ValueError(f"weights must have {k} rows of {width} numbers")
    total = fold(_rows(df, features, label, classes), add, merge)
    if total is None:
        raise ValueError("there are no complete rows")
    n, loss, longest = total[0], total[1], math.sqrt(total[2])
    reg = 1 / n if reg is None else reg
    penalty = np.ones((k, width))
    penalty[:, -1] = 0
    gradient = total[3:3 + d].reshape(k, width) / n + reg * penalty * weights
    hessian = total[3 + d:].reshape(d, d) / n + np.diag(reg * penalty.ravel())
    values, vectors = np.linalg.eigh(hessian)
    live = np.ones(d, dtype=bool)
    if k > 1:  # a common shift of all intercepts changes nothing: the direction of eigenvalue 0
        shift = np.zeros((k, width))
        shift[:, -1] = 1 / math.sqrt(k)
        live = np.abs(vectors.T @ shift.ravel()) < 0.5
    least = float(values[live].min(initial=math.inf))
    along = vectors.T @ gradient.ravel()
    if least > 0:
        step = -(vectors[:, live] @ (along[live] / values[live])).reshape(k, width)
        decrement = math.sqrt(float((along[live] ** 2 / values[live]).sum()))
        bound = longest * (math.sqrt(2) if k > 1 else 1)
        distance = 4 * decrement / math.sqrt(least) if decrement <= math.sqrt(least) / (2 * bound) else math.inf
    else:
        step, decrement, distance = np.zeros((k, width)), math.inf, math.inf
    objective = loss / n + reg / 2 * float((penalty * weights ** 2).sum())
    return Certificate(int(n), float(objective), gradient, step, decrement, distance)


def optimum(df: DataFrame, features: list[str], label: str, weights: np.ndarray | None = None, classes: int = 2,
            reg: float | None = None, distance: float = 1e-9, rounds: int = 50) -> tuple[np.ndarray, Certificate]:
    """Newton's method from ``weights`` (default: zeros) until the certificate is within ``distance``; a pass a step.

    A step that does not lower the objective is halved.  Ends early when
    rounding errors allow no further step.
    """
    k = 1 if classes == 2 else classes
    at = np.zeros((k, len(features) + 1)) if weights is None else np.atleast_2d(np.asarray(weights, dtype=float))
    now = certify(df, features, label, at, classes, reg)
    for _ in range(rounds):
        if now.distance <= distance or not np.abs(now.newton_step).max() > 1e-15:
            break
        size = 1.0
        while True:
            new = certify(df, features, label, at + size * now.newton_step, classes, reg)
            if new.objective <= now.objective or size < 1e-3:
                break
            size /= 2
        if not (new.objective < now.objective or new.decrement < now.decrement):
            break
        at, now = at + size * now.newton_step, new
    return at, now
