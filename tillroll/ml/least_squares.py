"""Least squares on a DataFrame, with collinear columns found and left out.

One aggregate gives each column's mean and deviation, a second the Gram
matrix of the standardised columns (and their products with the target).
Both are a handful of sums with a partial aggregate, whatever the number of
rows. A Cholesky factorisation with pivoting takes the column with the
largest part not explained by those taken before, until what is left of every other
column is below ``tolerance`` of its variance: those are combinations of the
taken ones. Constant columns are left out before. A last pass over the rows
sums the residuals against the columns and corrects the coefficients, so
rounding in the Gram matrix does not stay in the predictions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LeastSquares:
    """A fit: coefficients of the used columns, and why the others were left out."""

    centre: dict[str, float]              # mean of each used column
    slope: dict[str, float]
    level: float                          # prediction at the centre
    dropped: dict[str, str]

    def predict(self) -> Column:
        out = F.lit(self.level)
        for c, b in self.slope.items():
            out = out + F.lit(b) * (F.col(c).cast("double") - F.lit(self.centre[c]))
        return out

    @property
    def intercept(self) -> float:
        return self.level - sum(b * self.centre[c] for c, b in self.slope.items())


def pivoted_cholesky(gram: np.ndarray, tolerance: float) -> list[int]:
    """Columns of a Gram matrix with unit diagonal that are independent, in the order taken; ties go to the first."""
    left = np.diag(gram).astype(float).copy()
    factor = np.zeros((0, len(left)))
    taken: list[int] = []
    while len(taken) < len(left):
        best = int(np.argmax(np.where(np.isin(np.arange(len(left)), taken), -1.0, np.round(left, 12))))
        if left[best] <= tolerance:
            break
        row = (gram[best] - factor[:, best] @ factor) / np.sqrt(left[best])
        factor = np.vstack([factor, row])
        left = left - row ** 2
        taken.append(best)
    return taken


def _means(rows: DataFrame, products: dict[str, Column]) -> dict[str, float]:
    return rows.agg(*[F.avg(c).alias(name) for name, c in products.items()]).first().asDict()


def fit(rows: DataFrame, columns, target: str, tolerance: float = 1e-10) -> LeastSquares | None:
    """Fit ``target`` on ``columns``; None without rows. ``rows`` is read three times: materialise it."""
    x = {c: F.col(c).cast("double") for c in (*columns, target)}
    first = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"m_{c}") for c, v in x.items()],
                     *[F.stddev_pop(v).alias(f"s_{c}") for c, v in x.items()]).first()
    if not first["n"]:
        return None
    mean = {c: first[f"m_{c}"] for c in x}
    spread = {c: first[f"s_{c}"] for c in x}
    dropped = {c: "constant" for c in columns if spread[c] <= 1e-12 * max(1.0, abs(mean[c]))}
    used = [c for c in columns if c not in dropped]
    if not used:
        return LeastSquares({}, {}, mean[target], dropped)
    z = {c: (x[c] - F.lit(mean[c])) / F.lit(spread[c]) for c in used}
    y = x[target] - F.lit(mean[target])
    sums = _means(rows, {f"{i}_{j}": z[a] * z[b] for i, a in enumerate(used) for j, b in enumerate(used) if j >= i}
                  | {f"y_{i}": z[c] * y for i, c in enumerate(used)})
    gram = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] for j in range(len(used))] for i in range(len(used))])
    scale = np.sqrt(np.diag(gram))
    taken = sorted(pivoted_cholesky(gram / np.outer(scale, scale), tolerance))
    dropped |= {c: "collinear" for i, c in enumerate(used) if i not in taken}
    names, part = [used[i] for i in taken], gram[np.ix_(taken, taken)]
    beta = np.linalg.solve(part, np.array([sums[f"y_{i}"] for i in taken]))
    level = mean[target]

    def model() -> LeastSquares:
        return LeastSquares({c: mean[c] for c in names}, {c: float(b) / spread[c] for c, b in zip(names, beta)},
                            float(level), dropped)

    rest = x[target] - model().predict()
    off = _means(rows, {"level": rest} | {f"y_{i}": z[c] * rest for i, c in enumerate(names)})
    beta = beta + np.linalg.solve(part, np.array([off[f"y_{i}"] for i in range(len(names))]))
    level = level + off["level"]
    return model()
