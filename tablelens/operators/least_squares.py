"""Least squares for any features, collinear ones included: tree-merged QR, solution of least norm.

One pass takes the means, a second one reduces the centred rows of every task
to a triangular factor; factors are merged in groups, level by level (TSQR).
The last one has the size of the features, whatever the rows.  Normal equations
would square the condition number, and fail where dummies add up to one,
a column repeats, or products repeat their factors.

Among all solutions the one of least norm (without the intercept) is
taken, in the units of the features.  How many directions carry information is
judged on columns scaled to equal length, so it does not depend on units.

Edge cases: rows with a missing value are left out (NaN counts as missing);
without rows there is no solution (ValueError); constant features get 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layout import aggregate_in_passes
from ..functions.typing_rules import qcol
from .dense import complete_rows, fold

#: Directions shorter than this share of the longest one, on columns of equal length, carry no information.
TOLERANCE = 1e-10


@dataclass(frozen=True)
class LeastSquares:
    features: list[str]
    coefficients: list[float]
    intercept: float
    rank: int                         # independent directions among the centred features
    n: int
    residual: float                   # sum of squared residuals

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """``df`` with the fitted value; NULL for a row that lacks a feature."""
        value = F.lit(self.intercept)
        for f, w in zip(self.features, self.coefficients):
            value = value + F.lit(w) * F.nanvl(qcol(f).cast("double"), F.lit(None).cast("double"))
        return df.withColumn(output, value)


def _triangle(rows: np.ndarray, width: int) -> np.ndarray:
    """The triangular factor of some rows, filled up with zero rows, as a flat array."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((width - len(r), width))]).ravel() if len(r) < width else r.ravel()


def fit(df: DataFrame, features: list[str], label: str = "label", tolerance: float = TOLERANCE) -> LeastSquares:
    """Fit ``label`` on ``features`` over the complete rows of ``df``, which are read twice."""
    if not features:
        raise ValueError("select at least one feature")
    rows = complete_rows(df, features, label)
    width = len(features) + 1
    found = aggregate_in_passes(rows, [("n", F.count(F.lit(1)))] + [(c, F.avg(c)) for c in rows.columns])
    n = found["n"]
    if not n:
        raise ValueError("there are no complete rows to fit")
    means = np.array([found[c] for c in rows.columns])

    def add(state: np.ndarray | None, block: np.ndarray) -> np.ndarray:
        centred = block - means
        return _triangle(centred if state is None else np.vstack([state.reshape(width, width), centred]), width)

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _triangle(np.vstack([a.reshape(width, width), b.reshape(width, width)]), width)

    r = fold(rows, add, merge).reshape(width, width)
    w, rank = least_norm(r[:-1, :-1], r[:-1, -1], tolerance, np.abs(means[:-1]) * np.sqrt(n))
    rest = r[:, -1] - r[:, :-1] @ w
    return LeastSquares(list(features), w.tolist(), float(means[-1] - means[:-1] @ w), rank, n, float(rest @ rest))


def least_norm(r: np.ndarray, y: np.ndarray, tolerance: float, sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """The shortest w among those with least |r w - y|, and the rank of r.

    ``sizes`` are the lengths of the columns before centring: a column that centring
    leaves as rounding errors of those is constant.
    """
    length = np.linalg.norm(r, axis=0)
    live = length > 1e-12 * sizes
    live &= length > 0
    w = np.zeros(r.shape[1])
    if not live.any():
        return w, 0
    scale = length[live]
    u, s, v = np.linalg.svd(r[:, live] / scale, full_matrices=True)
    rank = int((s > tolerance * s[0]).sum())
    some = (v[:rank].T @ ((u[:, :rank].T @ y) / s[:rank])) / scale
    free = v[rank:].T / scale[:, None]                      # directions that change nothing
    if free.shape[1]:
        q = np.linalg.qr(free)[0]
        some = some - q @ (q.T @ some)
    w[live] = some
    return w, rank
